"""Registered candle pattern queries (I13) with window-SQL oracles (12 patterns).

The oracle restates each pattern in SQL from the definitions in
``operators/indicators/candles.py`` (settings table, candle k bars back).
"""

from __future__ import annotations

from ..operators.indicators.candles import SETTINGS
from .q_indicators import BASE, _spark
from .registry import register

W = "OVER (PARTITION BY symbol ORDER BY rn)"
_MEAS = {"body": "body", "range": "rng", "shadows": "sh"}


class K:
    def __init__(self, k: int):
        self.k = k

    def v(self, name: str) -> str:
        return name if self.k == 0 else f"lag({name}, {self.k}) {W}"

    def __getattr__(self, n):
        m = {"o": "open", "h": "high", "l": "low", "c": "close", "body": "body", "up": "up", "lo": "lo",
             "col": "col"}
        if n in m:
            return self.v(m[n])
        if n == "top":
            return f"greatest({self.o}, {self.c})"
        if n == "bot":
            return f"least({self.o}, {self.c})"
        raise AttributeError(n)

    def avg(self, setting: str) -> str:
        meas, n, factor = SETTINGS[setting]
        if n == 0:
            return f"({self.body} * {factor!r})"
        a = (f"(avg({_MEAS[meas]}) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {self.k + n} PRECEDING "
             f"AND {self.k + 1} PRECEDING) * {factor!r})")
        return f"({a} / 2)" if meas == "shadows" else a


PARTS = """p AS (SELECT *, abs(close - open) AS body, high - low AS rng, high - greatest(open, close) AS up,
  least(open, close) - low AS lo, CASE WHEN close >= open THEN 1 ELSE -1 END AS col,
  (high - greatest(open, close)) + (least(open, close) - low) AS sh FROM b)"""


def pat(lookback: int, expr: str) -> str:
    return f"CAST(CASE WHEN rn >= {lookback} THEN coalesce({expr}, 0) ELSE 0 END AS BIGINT)"


a, b, m = K(1), K(0), K(2)
_SQL = {
    "cdldoji": (10, f"CASE WHEN {b.body} <= {b.avg('body_doji')} THEN 100 ELSE 0 END"),
    "cdlmarubozu": (10, f"CASE WHEN {b.body} > {b.avg('body_long')} AND {b.up} < {b.avg('shadow_very_short')} "
                        f"AND {b.lo} < {b.avg('shadow_very_short')} THEN {b.col} * 100 ELSE 0 END"),
    "cdlspinningtop": (10, f"CASE WHEN {b.body} < {b.avg('body_short')} AND {b.up} > {b.body} AND {b.lo} > {b.body} "
                           f"THEN {b.col} * 100 ELSE 0 END"),
    "cdlengulfing": (1, f"CASE WHEN {b.col} = 1 AND {a.col} = -1 AND {b.c} > {a.o} AND {b.o} < {a.c} THEN 100 "
                        f"WHEN {b.col} = -1 AND {a.col} = 1 AND {b.o} > {a.c} AND {b.c} < {a.o} THEN -100 ELSE 0 END"),
    "cdlhammer": (11, f"CASE WHEN {b.body} < {b.avg('body_short')} AND {b.lo} > {b.avg('shadow_long')} "
                      f"AND {b.up} < {b.avg('shadow_very_short')} AND {b.bot} <= {a.l} + {a.avg('near')} "
                      f"THEN 100 ELSE 0 END"),
    "cdlharami": (11, f"CASE WHEN {a.body} > {a.avg('body_long')} AND {b.body} <= {b.avg('body_short')} "
                      f"AND {b.top} < {a.top} AND {b.bot} > {a.bot} THEN -{a.col} * 100 ELSE 0 END"),
    "cdlmorningstar": (12, f"CASE WHEN {m.col} = -1 AND {m.body} > {m.avg('body_long')} "
                           f"AND {a.body} <= {a.avg('body_short')} AND {a.top} < {m.bot} AND {b.col} = 1 "
                           f"AND {b.body} > {b.avg('body_short')} AND {b.c} > {m.c} + {m.body} * 0.3 "
                           f"THEN 100 ELSE 0 END"),
    "cdllongline": (10, f"CASE WHEN {b.body} > {b.avg('body_long')} AND {b.up} < {b.avg('shadow_short')} "
                        f"AND {b.lo} < {b.avg('shadow_short')} THEN {b.col} * 100 ELSE 0 END"),
    "cdlbelthold": (10, f"CASE WHEN {b.body} > {b.avg('body_long')} AND CASE WHEN {b.col} = 1 THEN {b.lo} "
                        f"ELSE {b.up} END < {b.avg('shadow_very_short')} THEN {b.col} * 100 ELSE 0 END"),
    "cdldojistar": (11, f"CASE WHEN {a.body} > {a.avg('body_long')} AND {b.body} <= {b.avg('body_doji')} "
                        f"AND {a.col} = 1 AND {b.bot} > {a.top} THEN -100 "
                        f"WHEN {a.body} > {a.avg('body_long')} AND {b.body} <= {b.avg('body_doji')} "
                        f"AND {a.col} = -1 AND {b.top} < {a.bot} THEN 100 ELSE 0 END"),
    "cdl3outside": (2, f"CASE WHEN {a.col} = 1 AND {m.col} = -1 AND {a.c} > {m.o} AND {a.o} < {m.c} AND {b.c} > {a.c} "
                       f"THEN 100 WHEN {a.col} = -1 AND {m.col} = 1 AND {a.o} > {m.c} AND {a.c} < {m.o} "
                       f"AND {b.c} < {a.c} THEN -100 ELSE 0 END"),
    "cdlmatchinglow": (6, f"CASE WHEN {a.col} = -1 AND {b.col} = -1 AND {b.c} <= {a.c} + {a.avg('equal')} "
                          f"AND {b.c} >= {a.c} - {a.avg('equal')} THEN 100 ELSE 0 END"),
}

reg_names = list(_SQL)
register("candles", "WITH " + BASE + ", " + PARTS + " SELECT symbol, ts, " + ", ".join(
    f"{pat(lb, e)} AS {n}" for n, (lb, e) in _SQL.items()) + " FROM p")(_spark(reg_names))


@register("candles_all")
def candles_all(spark, sf):
    """Every implemented pattern; rows-only (the SQL twin covers a subset)."""
    from ..operators.indicators import candles
    return _spark([c.name for c in candles.ALL])(spark, sf)
