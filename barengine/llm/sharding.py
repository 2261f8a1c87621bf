"""Sharding by jump consistent hashing (DataFrame operations only).

The shard of a row is a function of its key and the number of shards, without
a ring table. When one shard is appended, a row either stays or moves into the
new shard. The generator is the 64-bit linear congruential one of the published
algorithm (Lamping and Veach, 2014), seeded with the first 64 bits of the key's
MD5; its products are held in DECIMAL(38, 0), where they cannot overflow.

Defined results
* null key: the key is the text ``null``; null text: no bytes;
* rows equal in all returned columns get the slots of one run, in any order;
* equal keys go to one shard, whatever their texts;
* empty table: empty result; columns besides key, text and ``carry`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc, key_text, md5_number

#: Fixed values of the published generator.
MULTIPLIER = 2862933555777941757
TWO_64 = 18446744073709551616
TWO_33 = 8589934592
TWO_31 = 2147483648.0

#: A step is taken ln(shards) times on average; steps beyond this many are put
#: in a second expression that is evaluated only for rows that need them.
FIRST_STEPS = 24
ROW_BYTES = 16
SLOT_BUCKETS = 256
RUN = 4096


def _dec(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def _advance(k: Column) -> Column:
    return ((k * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) % _dec(TWO_64)
            ).cast("decimal(20,0)")


def _next(state: Column) -> Column:
    """The next jump: floor((b + 1) * 2^31 / ((k >> 33) + 1))."""
    high = F.call_function("div", state["k"], F.lit(TWO_33).cast("decimal(20,0)"))
    return F.floor((state["b"] + 1) * (F.lit(TWO_31) / (high + 1).cast("double"))).cast("long")


def _state(b: Column, k: Column) -> Column:
    return F.struct(b.cast("long").alias("b"), k.alias("k"))


def _jump(start: Column, n: int, steps: int) -> Column:
    def step(s, _):
        j = _next(s)
        return F.when(j < n, _state(j, _advance(s["k"]))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def jump_state(key: Column, n_shards: int) -> Column:
    """Struct (b: the shard of ``key`` among ``n_shards``, k: state of the generator)."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    first = _state(F.lit(0), _advance(md5_number(key_text(key), 1, 16)))
    done = _jump(first, n_shards, min(n_shards, FIRST_STEPS))
    if n_shards <= FIRST_STEPS:
        return done
    # b grows with each step, so n_shards steps always end; few rows need more than the first ones.
    return F.transform(F.array(done), lambda s: F.when(_next(s) >= n_shards, s).otherwise(
        _jump(s, n_shards, n_shards - FIRST_STEPS)))[0]


def with_shard(df: DataFrame, key: str, n_shards: int, shard: str = "shard", grown: str | None = None) -> DataFrame:
    """Adds the shard (and with ``grown`` the shard among one more). No shuffle."""
    out = df.withColumn("__jump", jump_state(F.col(key), n_shards))
    if grown:
        out = out.withColumn(grown, F.when(_next(F.col("__jump")) == n_shards, F.lit(n_shards))
                             .otherwise(F.col("__jump.b")).cast("int"))
    return out.withColumn(shard, F.col("__jump.b").cast("int")).drop("__jump")


def shard_table(df: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 40,
                carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``df``: key, carried columns, size, text_crc32, law, shard, slot, grown_shard.

    Slots count from 0 within a shard without gaps. No shard is sorted as a
    whole: rows are numbered in 256 buckets of each shard and the buckets' row
    counts (at most 256 per shard) give each bucket's first slot. Equal rows are
    counted before the shuffle and spread in runs of 4,096 afterwards, so a key
    that holds a third of all rows fills no task.
    """
    keep = [key, *carry]
    slim = df.select(*[F.col(c) for c in keep],
                     (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + ROW_BYTES).cast("long").alias("__size"),
                     crc(F.col(text)).alias("__crc"))
    rows = slim.groupBy(*keep, "__size", "__crc").agg(F.count(F.lit(1)).alias("__n"))
    rows = with_shard(rows, key, n_shards, "__shard", "__grown")
    rows = rows.withColumn("__bucket", F.pmod(
        F.pmod(md5_number(key_text(F.col(key)), 17, 4), F.lit(65536).cast("decimal(20,0)")).cast("long")
        + F.col("__crc"), F.lit(SLOT_BUCKETS)))
    per_bucket = Window.partitionBy("__shard", "__bucket").orderBy(
        F.col(key).asc_nulls_first(), "__crc", "__size", *[F.col(c) for c in carry])
    counts = rows.groupBy("__shard", "__bucket").agg(F.sum("__n").alias("__total"))
    # at most 256 rows per shard, whatever the input
    firsts = counts.withColumn("__first", F.sum("__total").over(
        Window.partitionBy("__shard").orderBy("__bucket")) - F.col("__total")).drop("__total")
    numbered = (rows.withColumn("__before", F.sum("__n").over(per_bucket.rowsBetween(Window.unboundedPreceding, 0))
                                - F.col("__n"))
                .join(firsts, ["__shard", "__bucket"]))
    runs = numbered.withColumn("__from", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(RUN).cast("long"))))
    runs = runs.repartition("__shard", "__bucket", "__from", key)
    each = runs.withColumn("__i", F.explode(F.sequence(
        F.col("__from"), F.least(F.col("__from") + (RUN - 1), F.col("__n") - 1))))
    return each.select(*keep, F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"),
                       F.lit("key").alias("law"), F.col("__shard").alias("shard"),
                       (F.col("__first") + F.col("__before") + F.col("__i")).cast("long").alias("slot"),
                       F.col("__grown").alias("grown_shard"))
