"""Bars: resample, build from ticks, compact, merge, deduplicate.

All of these are hash aggregations on (symbol, bucket) or (symbol, ts):
Spark aggregates partially on the map side, so a hot symbol is reduced
before the shuffle and no task ever holds a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COMPACT_AFTER_DAYS


def bucket(ts: str | Column, width: str) -> Column:
    """Left-closed, left-labelled bucket start of ``width`` (e.g. '5 minutes')."""
    return F.window(ts, width).start


_D38 = "decimal(38,0)"


def order_key(ts: str = "ts", seq: str = "seq") -> Column:
    """The total order (ts, seq) as one DECIMAL(38,0): µs × 10^19 + (seq + 2^63).

    ``min_by``/``max_by`` ordered by a struct need a sort-based aggregate
    (struct buffers are not fixed-width); a decimal key keeps the
    aggregation hash-based with map-side partial aggregation, with the
    same result for every seq in the signed 64-bit range.
    """
    return (F.unix_micros(F.col(ts)).cast(_D38) * F.expr(f"CAST('{10 ** 19}' AS {_D38})")
            + (F.col(seq).cast(_D38) + F.expr(f"CAST('{2 ** 63}' AS {_D38})")))


def _present(df: DataFrame, name: str) -> bool:
    return name in df.columns


def bars_from_ticks(ticks: DataFrame, width: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """A2: OHLCV bars from ticks (symbol, ts, seq, price, size).

    open/close are the first/last price by (ts, seq); empty buckets do not
    exist; ticks without price are not trades and are skipped.
    """
    keys = list(keys)
    order = order_key()
    t = ticks.where(F.col("price").isNotNull())
    return (t.groupBy(*keys, bucket("ts", width).alias("ts"))
            .agg(F.min_by("price", order).alias("open"),
                 F.max("price").alias("high"),
                 F.min("price").alias("low"),
                 F.max_by("price", order).alias("close"),
                 F.coalesce(F.sum("size"), F.lit(0.0)).alias("volume")))


def resample_bars(bars: DataFrame, width: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """A1: coarser bars. Open first, high max, low min, close last (each
    skipping missing values), volume sum when present (0 if all missing),
    buckets with any missing value dropped; other columns dropped."""
    keys = list(keys)
    ts = F.col("ts")

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), ts))

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), ts))

    aggs = [first("open").alias("open"), F.max("high").alias("high"),
            F.min("low").alias("low"), last("close").alias("close")]
    if _present(bars, "volume"):
        aggs.append(F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"))
    out = bars.groupBy(*keys, bucket("ts", width).alias("ts")).agg(*aggs)
    return drop_incomplete(out)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """P5: drop rows with any missing value."""
    return df.dropna(how="any")


def split_by_age(bars: DataFrame, cutoff: Column | str) -> tuple[DataFrame, DataFrame]:
    """(older, recent) around ``cutoff`` (older: ts < cutoff)."""
    c = F.lit(cutoff).cast("timestamp") if isinstance(cutoff, str) else cutoff
    return bars.where(F.col("ts") < c), bars.where(F.col("ts") >= c)


def append_bars(*parts: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side become NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def dedup_keep_last(df: DataFrame, key: Sequence[str] = ("symbol", "ts"),
                    order: Sequence[str] = ("load_seq",)) -> DataFrame:
    """One row per key, the row with the greatest ``order`` wins.

    Written as ``max_by(struct(row), order)``: a partial aggregation, so a key
    with millions of copies is reduced on the map side instead of being
    sorted in one window partition.
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    o = F.struct(*order) if len(order) > 1 else F.col(order[0])
    agg = df.groupBy(*key).agg(F.max_by(F.struct(*rest), o).alias("_row"))
    return agg.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def compact_old(bars: DataFrame, now: str, days: int = COMPACT_AFTER_DAYS,
                width: str = "5 minutes", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """A3: bars older than now - days become ``width`` bars; recent ones stay.

    The old part keeps only OHLCV (extra columns become NULL after the union);
    old bucket labels are always before the cutoff, so the union has no
    duplicate key.
    """
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    older, recent = split_by_age(bars, cutoff)
    return append_bars(resample_bars(older, width, keys), recent)


def incremental_merge(existing: DataFrame, new: DataFrame,
                      key: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """U4: existing ∪ new, the newer load wins per key."""
    e = existing.withColumn("load_seq", F.lit(0))
    n = new.withColumn("load_seq", F.lit(1))
    return dedup_keep_last(append_bars(e, n), key, ("load_seq",)).drop("load_seq")


def high_water_mark(bars: DataFrame, keys: Sequence[str] = ("symbol",),
                    step: str = "1 minute") -> DataFrame:
    """Newest stored ts per series and the start of the next load."""
    return (bars.groupBy(*keys).agg(F.max("ts").alias("last_ts"))
            .withColumn("next_start", F.col("last_ts") + F.expr(f"INTERVAL {step}")))
