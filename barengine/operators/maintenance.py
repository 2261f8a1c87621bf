"""Load planning and store maintenance.

The download client itself is not rebuilt (files are landed); what remains
is the plan of what to load and the upkeep of the bar store, all as small
Spark jobs over the store's own metadata.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import age_days, interval_code, time_chunks
from ..schema import MAX_MINUTE_SPAN_DAYS, MINUTE_LOOKBACK_DAYS
from .bars import bars_from_ticks, high_water_mark, resample_bars


def resolve_ranges(global_range: tuple[str, str], per_freq: dict[str, tuple[str | None, str | None]],
                   freqs: Sequence[str]) -> dict[str, tuple[str, str]]:
    """Each frequency's own range, else the global one (configuration)."""
    out = {}
    for f in freqs:
        s, e = per_freq.get(f, (None, None))
        out[f] = (s or global_range[0], e or global_range[1])
    return out


def download_plan(tickers: DataFrame, ranges: dict[str, tuple[str, str]], stored: DataFrame | None, now: str,
                  span_days: int = MAX_MINUTE_SPAN_DAYS) -> DataFrame:
    """P2 + P3 + A18 + F14: per (symbol, freq) the pieces still to load.

    Minute loads start no earlier than now - 30 days (P3) unless bars are
    stored, in which case they continue one minute after the newest stored
    bar (A18, which overrides the clamp, as in the reference); minute spans
    longer than ``span_days`` are cut into pieces (F14). Hour/day loads are
    one piece over the configured range.
    """
    # Every configured ticker × every configured frequency: the ranges are
    # a literal array exploded per ticker row (no join).
    cfg = F.array(*[F.struct(F.lit(f).alias("freq"), F.lit(s).cast("timestamp").alias("start"),
                             F.lit(e).cast("timestamp").alias("end")) for f, (s, e) in ranges.items()])
    plan = tickers.select("symbol", F.explode(cfg).alias("r")).select("symbol", "r.freq", "r.start", "r.end")
    nowc = F.lit(now).cast("timestamp")
    clamp = F.greatest(F.col("start"), nowc - F.make_dt_interval(F.lit(MINUTE_LOOKBACK_DAYS)))
    if stored is not None:
        hwm = high_water_mark(stored, ["symbol", "freq"]).select("symbol", "freq", "next_start")
        plan = plan.join(hwm, ["symbol", "freq"], "left")
    else:
        plan = plan.withColumn("next_start", F.lit(None).cast("timestamp"))
    minute = F.col("freq") == "minute"
    start = F.when(minute, F.coalesce("next_start", clamp)).otherwise(F.col("start"))
    plan = plan.withColumn("load_start", start).withColumn("interval", interval_code("freq"))
    pieces = F.when(minute, time_chunks("load_start", "end", span_days)).otherwise(
        F.when(F.col("load_start") < F.col("end"),
               F.array(F.struct(F.col("load_start").alias("chunk_start"), F.col("end").alias("chunk_end")))))
    return (plan.select("symbol", "freq", "interval", F.explode_outer(pieces).alias("c"))
            .where(F.col("c").isNotNull())
            .select("symbol", "freq", "interval", F.col("c.chunk_start").alias("chunk_start"),
                    F.col("c.chunk_end").alias("chunk_end")))


def unreferenced_files(inventory: DataFrame, referenced: DataFrame) -> DataFrame:
    """Files of the store not in the referenced set (anti join on path)."""
    return inventory.join(referenced.select("path"), "path", "left_anti")


def old_files(inventory: DataFrame, now: str, days: int) -> DataFrame:
    """S13 + F15: files at least ``days`` old at ``now``."""
    return inventory.withColumn("age_days", age_days("modificationTime", now)).where(F.col("age_days") >= days)


def compact_files(spark: SparkSession, paths: Sequence[str], width: str = "5 minutes",
                  keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """A4: bars of the given minute files resampled to ``width`` bars (the
    caller rewrites those partitions with dynamic overwrite)."""
    if not paths:
        raise ValueError("no files to compact")
    return resample_bars(spark.read.parquet(*paths), width, keys)


def compact_tick_files(spark: SparkSession, inventory: DataFrame, now: str, days: int, reader,
                       width: str = "5 minutes") -> DataFrame:
    """A4 for landed tick files: every file older than ``days`` becomes
    ``width`` bars. ``reader(paths)`` maps the files to ticks."""
    paths = [r["path"] for r in old_files(inventory, now, days).select("path").collect()]
    if not paths:
        return None
    return bars_from_ticks(reader(paths), width)
