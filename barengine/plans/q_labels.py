"""Registered label and return queries: W2-W6."""

from __future__ import annotations

from ..operators import labels as L
from ..operators import series
from . import sql as S
from .inputs import event_bars
from .output import r6
from .registry import register

_H = S.hour_bars()


@register("label_b1", f"""
SELECT symbol, ts, CAST(CASE WHEN lead(close) OVER w > close THEN 1 ELSE 0 END AS BIGINT) AS label_b1
FROM ({_H}) b WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def label_b1(spark, sf):
    def build(w):
        return {"label_b1": L.label_b1(w)}
    b = event_bars(spark, sf).select("symbol", "ts", "close")
    return series.with_series_columns(b, ["symbol"], build, back=0, fwd=1).select("symbol", "ts", "label_b1")


# A larger threshold as well: with the default 0.002 almost no bar is class 0.
@register("label_t3", f"""
SELECT symbol, ts,
  CAST(CASE WHEN r > 0.002 THEN 1 WHEN r < -0.002 THEN -1 ELSE 0 END AS BIGINT) AS label_t3,
  CAST(CASE WHEN r > 0.05 THEN 1 WHEN r < -0.05 THEN -1 ELSE 0 END AS BIGINT) AS label_t3_5pct
FROM (SELECT symbol, ts, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1 AS r
      FROM ({_H}) b) x""")
def label_t3(spark, sf):
    def build(w):
        return {"label_t3": L.label_t3(w), "label_t3_5pct": L.label_t3(w, 0.05)}
    b = event_bars(spark, sf).select("symbol", "ts", "close")
    return (series.with_series_columns(b, ["symbol"], build, back=0, fwd=1)
            .select("symbol", "ts", "label_t3", "label_t3_5pct"))


@register("label_r", f"""
SELECT symbol, ts, {r6("coalesce(CASE WHEN q > 0 THEN ln(q) END * 100, 0)")} AS label_r
FROM (SELECT symbol, ts, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) AS q
      FROM ({_H}) b) x""")
def label_r(spark, sf):
    def build(w):
        return {"label_r": L.label_r(w)}
    b = event_bars(spark, sf).select("symbol", "ts", "close")
    return series.with_series_columns(b, ["symbol"], build, back=0, fwd=1).select("symbol", "ts", "label_r")


_RET = f"""SELECT symbol, ts, close,
  coalesce(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1, 0) AS ret
FROM ({_H}) b"""


@register("simple_return", f"SELECT symbol, ts, {r6('ret')} AS ret FROM ({_RET}) r")
def simple_return(spark, sf):
    b = event_bars(spark, sf).select("symbol", "ts", "close")
    return L.add_returns(b).select("symbol", "ts", "ret")


_LAGS = 5


@register("lagged_returns", "SELECT symbol, ts, " + ", ".join(
    [r6("ret") + " AS lag_0"] +
    [r6(f"coalesce(lag(ret, {i}) OVER (PARTITION BY symbol ORDER BY ts), 0)") + f" AS lag_{i}"
     for i in range(1, _LAGS)]) + f" FROM ({_RET}) r")
def lagged_returns(spark, sf):
    """Lag matrix of returns, 5 columns (the backtest's feature matrix)."""
    b = event_bars(spark, sf).select("symbol", "ts", "close")
    return L.add_returns(b, n_lags=_LAGS).select("symbol", "ts", *[f"lag_{i}" for i in range(_LAGS)])
