"""Registered bar queries: A1-A3, A18, W1, U4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..sources import adapters
from . import sql as S
from .inputs import event_bars, order_bars, user_bars
from .output import r6
from .registry import register

_BAR_SELECT = S.rounded_bars_select()


@register("bars_5m", f"SELECT {_BAR_SELECT} FROM ({S.bars('5 minutes')}) b")
def bars_5m(spark, sf):
    """5-minute bars per event type (A2)."""
    return event_bars(spark, sf, "5 minutes")


@register("bars_1h", f"SELECT {_BAR_SELECT} FROM ({S.bars('1 hour')}) b")
def bars_1h(spark, sf):
    return event_bars(spark, sf, "1 hour")


@register("bars_1d", f"SELECT {_BAR_SELECT} FROM ({S.bars('1 day', S.TICKS_ORDERS)}) b")
def bars_1d(spark, sf):
    """Daily bars of order prices per priority (ties inside a day)."""
    return order_bars(spark, sf)


@register("bars_users_1h", f"SELECT {_BAR_SELECT} FROM ({S.bars('1 hour', S.TICKS_USERS)}) b")
def bars_users_1h(spark, sf):
    """Hour bars of 150+ short series (one per user)."""
    return user_bars(spark, sf, "1 hour")


_RESAMPLE_SQL = f"""
WITH b AS ({S.bars('5 minutes')})
SELECT symbol, ts, {r6('open')} AS open, {r6('high')} AS high, {r6('low')} AS low,
       {r6('close')} AS close, {r6('volume')} AS volume FROM (
  SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts,
    arg_min(open, ts) FILTER (WHERE open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, ts) FILTER (WHERE close IS NOT NULL) AS close, coalesce(sum(volume), 0) AS volume
  FROM b GROUP BY symbol, time_bucket(INTERVAL '1 hour', ts)) r
WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL"""


@register("bars_1h_from_5m", _RESAMPLE_SQL)
def bars_1h_from_5m(spark, sf):
    """A1 on A2: hour bars resampled from 5-minute bars."""
    return B.resample_bars(event_bars(spark, sf, "5 minutes"), "1 hour")


# Fixed parameter: 'now' for compaction; cutoff = now - 90 days = 2024-01-15.
COMPACT_NOW = "2024-04-14 00:00:00"

_COMPACT_SQL = f"""
WITH m AS ({S.bars('1 minute')}),
old AS (
  SELECT symbol, time_bucket(INTERVAL '5 minutes', ts) AS ts,
    arg_min(open, ts) FILTER (WHERE open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, ts) FILTER (WHERE close IS NOT NULL) AS close, coalesce(sum(volume), 0) AS volume
  FROM m WHERE ts < TIMESTAMP '{COMPACT_NOW}' - INTERVAL 90 DAY
  GROUP BY symbol, time_bucket(INTERVAL '5 minutes', ts)),
recent AS (SELECT * FROM m WHERE ts >= TIMESTAMP '{COMPACT_NOW}' - INTERVAL 90 DAY)
SELECT {_BAR_SELECT} FROM (SELECT * FROM old UNION ALL SELECT * FROM recent) b"""


@register("compact_old_bars", _COMPACT_SQL)
def compact_old_bars(spark, sf):
    """A3: minute bars older than 90 days (fixed now) become 5-minute bars."""
    minute = event_bars(spark, sf, "1 minute")
    return B.compact_old(minute, COMPACT_NOW)


_DEDUP_SQL = f"""
SELECT symbol, tick_ts AS ts, seq, {r6('price')} AS price FROM ({S.TICKS_ORDERS}) t
QUALIFY row_number() OVER (PARTITION BY symbol, tick_ts ORDER BY seq DESC) = 1"""


@register("dedup_keep_last", _DEDUP_SQL)
def dedup_keep_last(spark, sf):
    """One order tick per (priority, day); the latest load (highest key) wins."""
    t = adapters.ticks_orders(spark, sf).select("symbol", "ts", "seq", "price")
    return B.dedup_keep_last(t, ("symbol", "ts"), ("seq",))


# Two overlapping loads: the first sees ticks before 2024-01-20 12:30 (its last
# hour bar is partial), the second ticks from 2024-01-18 on.
MERGE_CUT_OLD = "2024-01-20 12:30:00"
MERGE_CUT_NEW = "2024-01-18 00:00:00"

_MERGE_SQL = f"""
WITH e AS ({S.bars('1 hour', S.TICKS_EVENTS + f" WHERE ts < TIMESTAMP '{MERGE_CUT_OLD}'")}),
n AS ({S.bars('1 hour', S.TICKS_EVENTS + f" WHERE ts >= TIMESTAMP '{MERGE_CUT_NEW}'")}),
u AS (SELECT *, 0 AS load_seq FROM e UNION ALL SELECT *, 1 AS load_seq FROM n)
SELECT {_BAR_SELECT} FROM u
QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY load_seq DESC) = 1"""


@register("incremental_merge", _MERGE_SQL)
def incremental_merge(spark, sf):
    """U4: existing ∪ new hour bars, the newer load wins per (symbol, ts)."""
    t = adapters.ticks_events(spark, sf)
    existing = B.bars_from_ticks(t.where(F.col("ts") < F.lit(MERGE_CUT_OLD).cast("timestamp")), "1 hour")
    new = B.bars_from_ticks(t.where(F.col("ts") >= F.lit(MERGE_CUT_NEW).cast("timestamp")), "1 hour")
    return B.incremental_merge(existing, new)


_HWM_SQL = f"""
SELECT symbol, max(ts) AS last_ts, max(ts) + INTERVAL 1 MINUTE AS next_start
FROM ({S.bars('1 minute')}) b GROUP BY symbol"""


@register("high_water_mark", _HWM_SQL)
def high_water_mark(spark, sf):
    """Newest stored minute bar per symbol and the next load start."""
    return B.high_water_mark(event_bars(spark, sf, "1 minute"))
