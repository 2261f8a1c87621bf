"""SQL building blocks for the DuckDB oracles (views = the driver's tables).

The oracle SQL is written from the operator definitions, not generated from
the Spark plans; these helpers only share the adapters' table mapping.
"""

from __future__ import annotations

from .output import r6

TICKS_EVENTS = ("SELECT event_type AS symbol, ts AS tick_ts, event_id AS seq, "
                "CAST(value AS DOUBLE) AS price, CAST(1 AS DOUBLE) AS size FROM events")
TICKS_USERS = ("SELECT CAST(user_id AS VARCHAR) AS symbol, ts AS tick_ts, event_id AS seq, "
               "CAST(value AS DOUBLE) AS price, CAST(1 AS DOUBLE) AS size FROM events")
TICKS_ORDERS = ("SELECT o_orderpriority AS symbol, o_orderdate AS tick_ts, o_orderkey AS seq, "
                "CAST(o_totalprice AS DOUBLE) AS price, CAST(1 AS DOUBLE) AS size FROM orders")


def bars(width: str, ticks: str = TICKS_EVENTS) -> str:
    """Unrounded bars (symbol, ts, open, high, low, close, volume)."""
    return f"""SELECT symbol, time_bucket(INTERVAL '{width}', tick_ts) AS ts,
  arg_min(price, (tick_ts, seq)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (tick_ts, seq)) AS close, coalesce(sum(size), 0) AS volume
FROM ({ticks}) t WHERE price IS NOT NULL GROUP BY symbol, time_bucket(INTERVAL '{width}', tick_ts)"""


def hour_bars() -> str:
    return bars("1 hour")


def rounded_bars_select(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return (f"{p}symbol, {p}ts, {r6(p + 'open')} AS open, {r6(p + 'high')} AS high, "
            f"{r6(p + 'low')} AS low, {r6(p + 'close')} AS close, {r6(p + 'volume')} AS volume")
