"""Next-step labels and returns.

Every function takes a window spec ``w`` ordered by series position and
returns Column expressions, so callers can put any number of them into one
``select`` over one sort. ``add_labels`` / ``add_returns`` run them on the
blocked series layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series


def next_close(w: Window, close: str = "close") -> Column:
    return F.lead(close, 1).over(w)


def label_b1(w: Window, close: str = "close") -> Column:
    """1 if the next close is higher, else 0 (last row 0)."""
    return F.when(next_close(w, close) > F.col(close), 1).otherwise(0)


def label_t3(w: Window, thresh: float = 0.002, close: str = "close") -> Column:
    """Next return above +thresh → 1, below -thresh → -1, else 0."""
    ret = F.try_divide(next_close(w, close), F.col(close)) - 1
    return (F.when(ret > thresh, 1).when(ret < -thresh, -1).otherwise(0))


def label_r(w: Window, close: str = "close") -> Column:
    """100 * ln(next/close); missing (last row, bad ratio) → 0."""
    ratio = F.try_divide(next_close(w, close), F.col(close))
    return F.coalesce(F.when(ratio > 0, F.ln(ratio)) * 100, F.lit(0.0))


def next_up(w: Window, close: str = "close") -> Column:
    """Next close above this close (NULL on the last row)."""
    return next_close(w, close) > F.col(close)


def simple_return(w: Window, close: str = "close") -> Column:
    """Close / previous close - 1; first row and bad ratios → 0."""
    prev = F.lag(close, 1).over(w)
    return F.coalesce(F.try_divide(F.col(close), prev) - 1, F.lit(0.0))


def lagged(col: str, n: int, w: Window, prefix: str = "lag_") -> dict[str, Column]:
    """lag_0..lag_{n-1} of ``col``, missing → 0."""
    return {f"{prefix}{i}": F.coalesce(F.lag(col, i).over(w), F.lit(0.0)) if i else F.col(col)
            for i in range(n)}


def add_labels(bars: DataFrame, keys: Sequence[str] = ("symbol",), thresh: float = 0.002) -> DataFrame:
    """label_b1, label_t3, label_r on every bar, one sort."""
    def build(w):
        return {"label_b1": label_b1(w), "label_t3": label_t3(w, thresh), "label_r": label_r(w)}
    return series.with_series_columns(bars, keys, build, back=0, fwd=1).drop(series.RN)


def add_returns(bars: DataFrame, keys: Sequence[str] = ("symbol",), n_lags: int = 0,
                pad: bool = False) -> DataFrame:
    """ret (W5) and optionally lag_0..lag_{n-1} of it.

    ``pad=True`` first fills missing closes with the last known close, as
    pandas' pct_change does (rule N8); this adds one cumulative pass.
    """
    keys = list(keys)
    d = series.number_rows(bars, keys)
    close = "close"
    if pad:
        d = series.running(d, keys, {"_close_pad": ("last", F.col("close"))})
        close = "_close_pad"
    stages = [lambda w: {"ret": simple_return(w, close)}]
    if n_lags:
        stages.append(lambda w: lagged("ret", n_lags, w))
    out = series.staged(d, keys, stages, back=1 + max(n_lags - 1, 0), numbered=True)
    return out.drop("_close_pad") if pad else out
