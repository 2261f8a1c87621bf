"""Registered streaming queries (T1-T7); each runs the stream with ``availableNow``
over the events, some in several deliveries on one checkpoint, and returns the sink as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import bars_stream as ST
from . import sql as S
from .output import r6
from .registry import register

DELAY_MIN = 10


@register("stream_bars_5m", f"""
WITH b AS ({S.bars('5 minutes')})
SELECT {S.rounded_bars_select()} FROM b
WHERE ts + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL {DELAY_MIN} MINUTE""")
def stream_bars_5m(spark, sf):
    """Streamed 5-minute bars; windows still open at the end are not emitted."""
    ticks = ST.read_event_stream(spark, sf)
    path, _ = ST.run_available_now(ST.stream_bars(ticks, "5 minutes", f"{DELAY_MIN} minutes"), "bars5m")
    return spark.read.parquet(path)


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def _halves(ev):
    """The events before and from the middle of their time range on."""
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    mid = lo + (hi - lo) / 2
    return ev.where(F.col("ts") < F.lit(mid)), ev.where(F.col("ts") >= F.lit(mid))


def _land(df, folder):
    """One more delivery of files into a stream's input folder."""
    df.write.mode("append").parquet(folder)


@register("stream_resume", f"""
WITH b AS ({S.bars('5 minutes')})
SELECT {S.rounded_bars_select()} FROM b
WHERE ts + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL {DELAY_MIN} MINUTE""")
def stream_resume(spark, sf):
    """Two runs on one checkpoint. The first sees half of the events and keeps the windows that are
    open; the second, on files that arrived since, goes on with them. Neither run alone gives these bars."""
    base = ST.scratch(spark, "resume")
    for part in _halves(_events(spark, sf)):
        _land(part, f"{base}/in")
        ticks = ST.read_event_stream(spark, f"{base}/in", "*.parquet")
        path, _ = ST.run_available_now(ST.stream_bars(ticks, "5 minutes", f"{DELAY_MIN} minutes"), "resume", base=base)
    return spark.read.parquet(path)


@register("stream_dedup", f"""
SELECT event_type AS symbol, ts, event_id AS seq, {r6('value')} AS price FROM events""")
def stream_dedup(spark, sf):
    """Every third tick is delivered twice at once, and the second delivery brings the whole first half
    again (what is older than the watermark is late, the rest repeated): each tick comes out once."""
    base = ST.scratch(spark, "dedup")
    first, second = _halves(_events(spark, sf))
    for part in (first.union(first.where("event_id % 3 = 0")), second.union(first)):
        _land(part, f"{base}/in")
        ticks = ST.read_event_stream(spark, f"{base}/in", "*.parquet")
        out = ST.stream_dedup(ticks, delay="1 day").select("symbol", "ts", "seq", "price")
        path, _ = ST.run_available_now(out, "dedup", base=base)
    return spark.read.parquet(path)


@register("stream_latest_signal", f"""
SELECT event_type AS symbol, max(ts) AS ts, {r6('arg_max(value, (ts, event_id))')} AS price,
  CAST(sign(arg_max(value, (ts, event_id)) - avg(value)) AS BIGINT) AS signal,
  CASE WHEN arg_max(value, (ts, event_id)) > avg(value) THEN 'BUY'
       WHEN arg_max(value, (ts, event_id)) < avg(value) THEN 'SELL' ELSE 'HOLD' END AS side
FROM events GROUP BY event_type""")
def stream_latest_signal(spark, sf):
    """T4 + P12: newest price and BUY/SELL side per symbol (complete mode)."""
    ticks = ST.read_event_stream(spark, sf)
    target = ST.scratch(spark, "latest_snapshot")
    ST.run_available_now(ST.latest_signal(ticks), "latest", mode="complete", foreach_batch=ST.snapshot_batch(target))
    return spark.read.parquet(target)


@register("stream_returns", f"""
SELECT event_type AS symbol, ts, event_id AS seq, {r6('value')} AS price,
  {r6('coalesce(value / nullif(lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 0) - 1, 0)')} AS ret
FROM events""")
def stream_returns(spark, sf):
    """T5: tick returns over two deliveries, in blocks of 128 ticks; the price before a batch comes from the carry table."""
    base = ST.scratch(spark, "returns")
    for part in _halves(_events(spark, sf)):
        _land(part, f"{base}/in")
        ST.run_available_now(ST.read_event_stream(spark, f"{base}/in", "*.parquet"), "returns", base=base,
                             foreach_batch=ST.returns_batch(f"{base}/table", block_rows=128))
    return ST.read_returns(spark, f"{base}/table").select("symbol", "ts", "seq", "price", "ret")


@register("stream_upsert", f"""
SELECT event_type AS symbol, event_id AS seq, ts, {r6('CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END')} AS price FROM events""")
def stream_upsert(spark, sf):
    """T3 + U4: the second delivery corrects every fifth tick of the first half and is run again after its
    commit; the newest load wins per (symbol, seq), and only the dates of a delivery are read and written."""
    base = ST.scratch(spark, "upsert")
    first, second = _halves(_events(spark, sf))
    fixed = lambda d: d.withColumn("value", F.when(F.col("event_id") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")))
    merge = ST.upsert_batch(f"{base}/table", key=("symbol", "seq"), order="seq")

    def twice(batch, epoch):
        merge(batch, epoch)
        merge(batch, epoch)
    for part, how in ((first, merge), (fixed(second).union(fixed(first).where("event_id % 5 = 0")), twice)):
        _land(part, f"{base}/in")
        ticks = ST.read_event_stream(spark, f"{base}/in", "*.parquet").drop("size")
        ST.run_available_now(ticks, "upsert", base=base, foreach_batch=how)
    return ST.read_upserted(spark, f"{base}/table").select("symbol", "seq", "ts", "price")


@register("late_data_report", f"""
WITH e AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'early' WHEN ts < TIMESTAMP '2024-01-21' THEN 'mid' ELSE 'late' END AS slice
  FROM events),
k AS (SELECT * FROM e WHERE slice <> 'early'),
b AS (SELECT DISTINCT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS w FROM k)
SELECT (SELECT count(*) FROM e) AS rows_read,
  (SELECT count(*) FROM (SELECT DISTINCT event_type, time_bucket(INTERVAL 5 MINUTE, ts) FROM e WHERE slice = 'early'
    AND time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM k) - INTERVAL {DELAY_MIN} MINUTE)) AS groups_dropped,
  (SELECT count(*) FROM b WHERE w + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM k) - INTERVAL {DELAY_MIN} MINUTE) AS bars_emitted""")
def late_data_report(spark, sf):
    """Three time slices delivered in the order mid, late, early on one checkpoint, so the order holds on any
    storage: all of 'early' is behind the watermark. Rows that are dropped are (symbol, window) groups."""
    base = ST.scratch(spark, "late")
    ev = _events(spark, sf)
    early, late = F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"), F.col("ts") >= F.lit("2024-01-21").cast("timestamp_ntz")
    read = dropped = 0
    for part in (ev.where(~early & ~late), ev.where(late), ev.where(early)):
        _land(part, f"{base}/in")
        ticks = ST.read_event_stream(spark, f"{base}/in", "*.parquet")
        path, run = ST.run_available_now(ST.stream_bars(ticks, "5 minutes", f"{DELAY_MIN} minutes"), "late", base=base)
        read, dropped = read + run.input_rows, dropped + run.dropped
    emitted = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("bars_emitted"))
    return emitted.select(F.lit(read).cast("long").alias("rows_read"), F.lit(dropped).cast("long").alias("groups_dropped"), "bars_emitted")
