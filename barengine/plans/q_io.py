"""Registered source/sink and maintenance queries.

Round trips write under the shared checkpoint folder and read back, so
what is compared is what a later job would read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import maintenance as MT
from ..session import app_dir
from ..sources import files as FS
from . import q_backtest as QB
from . import sql as S
from .inputs import event_bars
from .output import r6
from .q_features import CONFIGURED
from .registry import register


def _scratch(spark, name):
    return f"{app_dir(spark, 'io')}/{name}-{uuid.uuid4().hex}"


@register("bar_store_roundtrip", f"SELECT {S.rounded_bars_select()} FROM ({S.hour_bars()}) b")
def bar_store_roundtrip(spark, sf):
    """S4 + S1/S2: hour and 5-minute bars into one store partitioned by
    (freq, symbol), read back with partition pruning on freq = '1h'."""
    path = _scratch(spark, "bars")
    h = event_bars(spark, sf, "1 hour").withColumn("freq", F.lit("1h"))
    m = event_bars(spark, sf, "5 minutes").withColumn("freq", F.lit("5m"))
    FS.write_bars(h.unionByName(m), path)
    return FS.read_bars(spark, path, freq="1h").drop("freq")


_METRIC_COLS = ["n_periods", "total_return", "cagr", "sharpe", "sortino", "max_drawdown"]
_METRIC_SCHEMA = ("symbol string, n_periods long, total_return double, cagr double, sharpe double, "
                  "sortino double, max_drawdown double, model string")


@register("metrics_roundtrip", f"""WITH {QB.BT_CTES}
SELECT model, symbol, {QB._msel(_METRIC_COLS)} FROM riskm""")
def metrics_roundtrip(spark, sf):
    """S8 + S10 + U2: metrics written as CSV per model, read back as one table."""
    path = _scratch(spark, "metrics")
    m = QB._bt(spark, sf)["metrics"].select("model", "symbol", *_METRIC_COLS)
    FS.write_metrics(m, path)
    return FS.read_metrics(spark, path, _METRIC_SCHEMA).select("model", "symbol", *_METRIC_COLS)


@register("equity_roundtrip", f"""WITH {QB.BT_CTES}
SELECT model || '/' || symbol AS label, period, {r6('cum')} AS cum FROM pd""")
def equity_roundtrip(spark, sf):
    """S9 + S11: equity curves as header-less CSV per model and series, read
    back with a label from the folders."""
    path = _scratch(spark, "equity")
    p = QB._bt(spark, sf)["periods"].select("model", "symbol", "period", "cum")
    FS.write_equity(p, path)
    e = FS.read_equity(spark, path, "period timestamp, cum double, model string, symbol string")
    return e.select("label", "period", "cum")


# Fixed configuration of the load plan (the reference's data config shape).
PLAN_NOW = "2024-02-01 00:00:00"
PLAN_RANGES = MT.resolve_ranges(("2023-12-01", "2024-02-15"),
                                {"minute": ("2024-01-10", "2024-02-15"), "hour": ("2023-12-15", None)},
                                ["minute", "hour", "day"])
_PR = " UNION ALL ".join(f"SELECT '{f}' AS freq, TIMESTAMP '{s}' AS st, TIMESTAMP '{e}' AS en"
                         for f, (s, e) in PLAN_RANGES.items())
_TK = " UNION ALL ".join(f"SELECT '{t}' AS symbol" for t in CONFIGURED)


@register("download_plan", f"""
WITH r AS ({_PR}), t AS ({_TK}),
h AS (SELECT event_type AS symbol, 'minute' AS freq, max(time_bucket(INTERVAL '1 minute', ts)) + INTERVAL 1 MINUTE AS nxt
      FROM events GROUP BY event_type),
p AS (SELECT t.symbol, r.freq, r.st, r.en, h.nxt FROM t, r LEFT JOIN h ON h.symbol = t.symbol AND h.freq = r.freq),
q AS (SELECT symbol, freq, en, CASE WHEN freq = 'minute'
        THEN coalesce(nxt, greatest(st, TIMESTAMP '{PLAN_NOW}' - INTERVAL 30 DAY)) ELSE st END AS ls FROM p),
m AS (SELECT symbol, freq, unnest(generate_series(ls, en - INTERVAL 1 MICROSECOND, INTERVAL 8 DAY)) AS cs, en
      FROM q WHERE freq = 'minute' AND ls < en)
SELECT symbol, freq, CASE freq WHEN 'minute' THEN '1m' WHEN 'hour' THEN '1h' ELSE '1d' END AS interval,
       cs AS chunk_start, least(cs + INTERVAL 8 DAY, en) AS chunk_end FROM m
UNION ALL
SELECT symbol, freq, CASE freq WHEN 'minute' THEN '1m' WHEN 'hour' THEN '1h' ELSE '1d' END, ls, en
FROM q WHERE freq <> 'minute' AND ls < en""")
def download_plan(spark, sf):
    """P2 + P3 + A18 + F14: what each configured ticker still needs, given the
    minute bars already stored (from the events table)."""
    stored = event_bars(spark, sf, "1 minute").withColumn("freq", F.lit("minute"))
    tickers = spark.createDataFrame([(t,) for t in CONFIGURED], "symbol string")
    return MT.download_plan(tickers, PLAN_RANGES, stored, PLAN_NOW)


@register("file_inventory")
def file_inventory(spark, sf):
    """The Parquet files of the data folder with size and age (metadata only)."""
    inv = FS.file_inventory(spark, sf)
    return inv.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


@register("unreferenced_files")
def unreferenced_files(spark, sf):
    """Files not referenced by the bar pipeline (which reads events and orders)."""
    inv = FS.file_inventory(spark, sf)
    refs = inv.where(F.col("path").rlike(r"/(events|orders)\.parquet$")).select("path")
    return MT.unreferenced_files(inv, refs).select(F.element_at(F.split("path", "/"), -1).alias("file"))


@register("compact_by_file_age", f"SELECT {S.rounded_bars_select()} FROM ({S.bars('5 minutes')}) b")
def compact_by_file_age(spark, sf):
    """A4: tick files older than 90 days (at a fixed 'now' after all of them)
    become 5-minute bars."""
    inv = FS.file_inventory(spark, sf, "events.parquet")

    def reader(paths):
        e = spark.read.parquet(*paths)
        return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
                        F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("size"))
    return MT.compact_tick_files(spark, inv, "2100-01-01 00:00:00", 90, reader)

