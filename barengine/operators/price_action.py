"""Row-wise price-action features (F1, F2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wick_upper() -> Column:
    """high - max(open, close); greatest skips a missing side like fmax."""
    return F.col("high") - F.greatest("open", "close")


def wick_lower() -> Column:
    return F.least("open", "close") - F.col("low")


def bar_range() -> Column:
    """high - low, NULL when zero (ratios on a flat bar are missing)."""
    return F.nullif(F.col("high") - F.col("low"), F.lit(0.0))


def wick_ratio_upper() -> Column:
    """upper wick / range; NULL if the range is 0."""
    return wick_upper() / bar_range()


def wick_ratio_lower() -> Column:
    return wick_lower() / bar_range()


def price_action_columns() -> dict[str, Column]:
    return {
        "wick_upper": wick_upper(),
        "wick_lower": wick_lower(),
        "wick_ratio_upper": wick_ratio_upper(),
        "wick_ratio_lower": wick_ratio_lower(),
    }
