"""Cumulative indicators (I9): AD, OBV.

Both are running sums from the first bar, computed with ``series.running``
(per-block sums + a prefix over the small block table), so no task holds a
whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..series import RN



def ad_term() -> Column:
    """Close location value × volume; 0 on a flat bar."""
    return F.when(F.col("high") != F.col("low"), ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / (F.col("high") - F.col("low")) * F.col("volume")).otherwise(F.lit(0.0))


def obv_term(w: Window) -> Column:
    """+V on an up close, -V on a down close, 0 when equal; first bar +V."""
    c1 = F.lag("close").over(w)
    return (F.when(F.col(RN) == 0, F.col("volume")).when(F.col("close") > c1, F.col("volume")).when(F.col("close") < c1, -F.col("volume")).otherwise(F.lit(0.0)))


NAMES = ("ad", "obv")
