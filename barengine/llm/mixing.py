"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only).

Every source is shuffled (by MD5 of key, text checksum and seed). A document's virtual finish
time in pass ``e`` over its source is (e * source tokens + tokens of its source
up to and including it) / target of its source. All passes of all documents are
range-sorted by finish time and truncated at the total budget, so at any point
of the mix the sources stand in proportion to their targets.

Targets share the budget by weight; a target stops at ``max_repeat`` times its
source's tokens and the excess is reshared by weight until none is above.

Defined results
* null text: size 0; a document of size 0 is never taken and costs nothing;
* a null source is a source of its own, last in order;
* rows equal in key, source and text finish together and are taken equally often;
* equal finish times across sources are taken or left together;
* empty table or no tokens: targets 0, nothing taken; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc, key_text, materialize, md5_number, n_words, partitions

WEIGHTS = (5, 2, 1)
ORDER_BUCKETS = 1024


def _order_keys(key: str, text: str, seed: int) -> list[Column]:
    """The shuffled order of the documents of a source: 32 bits of MD5, then key and text checksum.

    The checksum is part of the MD5, so the rows of one hot or null key lie all over the order.
    """
    k, c = key_text(F.col(key)), crc(F.col(text))
    mixed = F.concat(k, F.lit("|"), c.cast("string"), F.lit(f"|{seed}"))
    return [md5_number(mixed, 1, 8).cast("long").alias("__h"), k.alias("__key"), c.alias("__crc")]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = 3,
                   budget: float = 1.0) -> DataFrame:
    """sizes (source, source_size) -> source, source_size, weight, target.

    One row per source. The windows run over this table of sources alone, never over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = (sizes.withColumn("__i", F.row_number().over(order) - 1)
         .withColumn("weight", F.element_at(cycle, (F.col("__i") % len(weights) + 1).cast("int")))
         .withColumn("__cap", (F.col("source_size") * max_repeat).cast("double"))
         .withColumn("__ratio", F.col("__cap") / F.col("weight")))
    whole = Window.orderBy("__ratio", "__i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("__ratio", "__i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # all sources before this one in order of cap / weight are full; the first source whose own share
    # of what they leave fits under its cap fixes the share per unit of weight
    s = s.withColumn("__level", (F.sum("source_size").over(whole) * budget
                                 - (F.sum("__cap").over(upto) - F.col("__cap")))
                     / (F.sum("weight").over(whole) - (F.sum("weight").over(upto) - F.col("weight"))))
    s = s.withColumn("__fit", F.min(F.when(F.col("__level") <= F.col("__ratio"),
                                           F.struct("__ratio", "__i", "__level"))).over(whole))
    target = F.coalesce(F.least(F.col("__cap"), F.col("__fit.__level") * F.col("weight")), F.col("__cap"))
    return s.select("source", F.col("source_size").cast("long").alias("source_size"), "weight",
                    target.alias("target"))


def queue(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
          weights: tuple[float, ...] = WEIGHTS, max_repeat: int = 3, budget: float = 1.0,
          seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The queue and its cut.

    Returns (one row per different document: key, order keys, size, __m (its equal rows), source_size,
    target, copies; one row per source: where in the source's order each pass stops).
    Texts are read once and never shuffled; equal rows are one entry of the queue, counted before
    the shuffle. A source is cumulated in 1,024
    buckets of its shuffled order, so a source with a third of all rows fills
    no task.
    """
    spark = docs.sparkSession
    src = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    slim = docs.select(F.col(key), *_order_keys(key, text, seed), F.col(source).cast("string").alias("source"),
                       n_words(F.col(text)).alias("size"))
    slim = slim.withColumn("__b", F.shiftright(F.col("__h"), 32 - ORDER_BUCKETS.bit_length() + 1).cast("int"))
    slim = slim.withColumn("__src", src)
    slim = materialize(slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("__m")), "mix-sizes")
    words_ = F.col("size") * F.col("__m")
    buckets = slim.groupBy("__src", "__b").agg(F.sum(words_).alias("__total"), F.first("source").alias("source"))
    before = buckets.withColumn("__before", F.sum("__total").over(Window.partitionBy("__src").orderBy("__b"))
                                - F.col("__total"))
    sizes = before.groupBy("__src").agg(F.first("source").alias("source"), F.sum("__total").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights, max_repeat, budget)
    targets = targets.withColumn("__src", src).select("__src", "source_size", "target")
    offsets = before.select("__src", "__b", "__before").join(targets, "__src")
    # peers (rows equal in all order keys) share one running sum
    running = Window.partitionBy("__src", "__b").orderBy(F.struct("__h", "__key", "__crc"))
    timed = (slim.withColumn("__own", F.sum(words_).over(running)).join(offsets, ["__src", "__b"])
             .withColumn("__cum", F.col("__own") + F.col("__before")))

    def finish(e: int) -> Column:
        return (F.when(F.col("size") > 0, (F.col("__cum") + F.col("source_size") * e) / F.col("target"))
                .alias(f"__vt{e}"))
    timed = materialize(timed.select(key, "__src", "__h", "__key", "__crc", "size", "__m", "source_size", "target",
                                     *[finish(e) for e in range(max_repeat)]), "mix-queue")
    cut = cut_time(timed, [f"__vt{e}" for e in range(max_repeat)], words_,
                   float(sum_of(sizes, "source_size") * budget), partitions(spark))
    taken = [F.coalesce(F.col(f"__vt{e}") <= F.lit(cut), F.lit(False)) for e in range(max_repeat)]
    decided = timed.withColumn("copies", sum((t.cast("int") for t in taken), F.lit(0)))
    stops = decided.groupBy("__src").agg(*[
        F.max(F.when(t, F.struct("__h", "__key", "__crc"))).alias(f"__stop{e}") for e, t in enumerate(taken)])
    return decided, stops


def sum_of(df: DataFrame, col: str) -> int:
    return int(df.agg(F.sum(col)).first()[0] or 0)


def cut_time(queue_: DataFrame, times: list[str], size: Column, budget: float, parts: int) -> float:
    """The last finish time within the budget: the queue is range-sorted over all
    partitions, the partitions' token sums (one number each) show the partition
    in which the budget ends, and only that one is cumulated row by row."""
    items = (queue_.select(F.explode(F.array(*times)).alias("vt"), size.alias("n"))
             .where("vt IS NOT NULL AND n > 0").repartitionByRange(parts, "vt")
             .withColumn("part", F.spark_partition_id()))
    items = materialize(items, "mix-items")
    left, last = budget, -1.0
    for part, total, top in sorted((r.part, r.total, r.top) for r in items.groupBy("part").agg(
            F.sum("n").alias("total"), F.max("vt").alias("top")).collect()):
        if total <= left:
            left, last = left - total, top
            continue
        run = Window.orderBy("vt")
        got = (items.where(F.col("part") == part).withColumn("c", F.sum("n").over(run))
               .where(F.col("c") <= left).agg(F.max("vt")).first()[0])
        return last if got is None else got
    return last


def mix_report(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """Per document: size, its source's size and target, and the words the mix takes of it."""
    decided, _ = queue(docs, key, **how)
    decided = decided.withColumn("__each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m"))))
    return decided.select(key, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0,
        **how) -> DataFrame:
    """The mixed documents, a document taken twice in two rows.

    A document's number of copies follows from its place in its source's order
    and the source's stops, so texts meet only the table of sources (one row per
    source) and are not shuffled.
    """
    _, stops = queue(docs, key, text, source, seed=seed, **how)
    stops = materialize(stops, "mix-stops")
    names = [c for c in stops.columns if c.startswith("__stop")]
    h, k, c = _order_keys(key, text, seed)
    place = F.struct(h, k, c)
    out = (docs.withColumn("__src", F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")))
           .withColumn("__place", place).join(stops, "__src"))
    copies = sum((F.coalesce(F.col("__place") <= F.col(s), F.lit(False)).cast("int") for s in names), F.lit(0))
    copies = F.when(n_words(F.col(text)) > 0, copies).otherwise(0)
    return (out.withColumn("__copies", copies).where("__copies > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select(*docs.columns))
