"""Structured Streaming versions of the bar pipeline.

The reference re-downloads and recomputes every 60 seconds; here the same
work is an incremental stream: a file source of tick (or event) files,
a watermark on the event time, windowed OHLCV in append mode (only closed
windows are emitted), deduplication within the watermark, a per-symbol
latest-signal table, and per-symbol returns and upserts in ``foreachBatch`` with one committed
epoch per batch. Progress lives in the caller's checkpoint folder, so a restarted query resumes where it stopped
(T7); ``availableNow`` processes what is there and stops, a processing-time
trigger refreshes periodically (T8).

Late-data rule: a micro-batch is judged against the watermark of the batch
before it; rows older than that watermark are dropped and counted in
``numRowsDroppedByWatermark`` (T6). With an aggregation these are its rows per
(key, window) and batch, after partial aggregation.
"""

from __future__ import annotations

import threading
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from ..session import app_dir, materialize

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def read_event_stream(spark: SparkSession, directory: str, glob: str = "events.parquet",
                      max_files: int | None = None) -> DataFrame:
    """File source of event Parquet files as ticks (symbol, ts, seq, price, size).

    Test files hold naive timestamps; watermarks need TIMESTAMP, so ``ts``
    is cast under the UTC session (rule N5).
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    r = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    e = r.parquet(directory)
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
                    F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("size"))


def stream_bars(ticks: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Tumbling-window OHLCV per symbol; append mode emits closed windows."""
    from ..operators.bars import order_key
    order = order_key()
    return (ticks.where(F.col("price").isNotNull()).withWatermark("ts", delay)
            .groupBy("symbol", F.window("ts", width).alias("w"))
            .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", order).alias("close"),
                 F.sum("size").alias("volume"))
            .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume"))


def stream_dedup(ticks: DataFrame, key: str = "seq", delay: str = "10 minutes") -> DataFrame:
    """Drop repeated deliveries of the same tick within the watermark
    (keeps the first seen; keep-last across loads is ``upsert_batch``)."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def latest_signal(ticks: DataFrame) -> DataFrame:
    """T4: newest price per symbol and its side against the symbol's mean
    (BUY above, SELL below); a stateful aggregation in complete/update mode."""
    from ..operators.bars import order_key
    order = order_key()
    a = ticks.groupBy("symbol").agg(F.max_by("price", order).alias("price"), F.max("ts").alias("ts"),
                                    F.avg("price").alias("mean_price"))
    sig = F.signum(F.col("price") - F.col("mean_price"))
    return a.select("symbol", "ts", "price", sig.cast("int").alias("signal"),
                    F.when(sig > 0, "BUY").when(sig < 0, "SELL").otherwise("HOLD").alias("side"))


# ------------------------------------------------------------ epochs of a foreachBatch table
def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def committed_epoch(spark: SparkSession, folder: str, before: int | None = None) -> int | None:
    """Newest epoch committed under ``folder`` (below ``before`` if given); None if there is none."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    epochs = [int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch=")]
    return max([e for e in epochs if before is None or e < before], default=None)


def _commit(df: DataFrame, folder: str, epoch: int) -> None:
    """Writes a small table beside ``folder/epoch=N`` and renames it there: the epoch exists whole or not at all."""
    spark = df.sparkSession
    made = f"{folder}/_making-{uuid.uuid4().hex}"
    df.write.parquet(made)
    fs, p = _fs(spark, f"{folder}/epoch={epoch}")
    if fs.exists(p):  # the same epoch again, after a restart
        fs.delete(p, True)
    if not fs.rename(_fs(spark, made)[1], p):
        raise RuntimeError(f"could not commit {p}")


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def _same(a: DataFrame, b: DataFrame, cols) -> Column:
    return reduce(and_, [a[c].eqNullSafe(b[c]) for c in cols])


# ------------------------------------------------------------ T5
def returns_batch(target: str, block_rows: int | None = None, bucket_unit: str = "hour"):
    """T5: ``foreachBatch`` function that appends tick-to-tick returns (symbol, ts, seq, price, ret) to ``target``.

    A batch is numbered and windowed on the blocked layout, so a hot symbol is spread over blocks; the first
    tick of each symbol takes the price before it from a carry table (one row per symbol) that the epoch before left.
    An epoch that is run again replaces its own files. Batches arrive in time order; the first tick ever has return 0.
    """
    from ..operators import series
    data, carries = f"{target}/data", f"{target}/_carry"

    def fn(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = materialize(batch.select("symbol", "ts", "seq", "price"), "returns-batch")
        rows = series.number_rows(new, ["symbol"], ["ts", "seq"], bucket_unit)
        rows = series.with_series_columns(rows, ["symbol"], lambda w: {"_before": F.lag("price").over(w)}, back=1,
                                          block_rows=block_rows, numbered=True)
        last = new.groupBy("symbol").agg(F.max(F.struct("ts", "seq", "price")).alias("_last"))
        newest = committed_epoch(spark, carries, epoch)
        if newest is not None:
            old = spark.read.schema(last.schema).parquet(f"{carries}/epoch={newest}")
            first = old.select(F.col("symbol").alias("_s"), F.lit(0).cast("long").alias("_zero"), F.col("_last.price").alias("_carried"))
            rows = rows.join(first, rows["symbol"].eqNullSafe(first["_s"]) & (rows[series.RN] == first["_zero"]), "left")
            rows = rows.withColumn("_before", F.when(F.col(series.RN) == 0, F.col("_carried")).otherwise(F.col("_before")))
            last = last.unionByName(old.join(last, _same(old, last, ["symbol"]), "left_anti"))
        ret = F.coalesce(F.col("price") / F.nullif(F.col("_before"), F.lit(0.0)) - 1, F.lit(0.0))
        rows.select("symbol", "ts", "seq", "price", ret.alias("ret")).write.mode("overwrite").parquet(f"{data}/epoch={epoch}")
        _commit(last, carries, epoch)
    return fn


def read_returns(spark: SparkSession, target: str) -> DataFrame:
    """The returns of all committed epochs."""
    newest = committed_epoch(spark, f"{target}/_carry")
    return spark.read.parquet(f"{target}/data").where(F.col("epoch") <= F.lit(-1 if newest is None else newest)).drop("epoch")


# ------------------------------------------------------------ T3
def upsert_batch(target: str, key=("symbol", "ts"), order: str = "seq", time: str = "ts"):
    """``foreachBatch`` function merging each micro-batch into a table of bars, newest load wins per key (U4).

    Rows lie in partitions of (symbol, date of ``time``). A batch reads the current version of the partitions that it
    touches, no others, and writes their new version under its own epoch; then a manifest (one row per
    partition: the epoch that has its current version) is renamed into place. Readers go by the newest
    manifest. A batch that fails in between leaves the table as it was, and an epoch that is run again starts
    from the manifest of the epoch before and ends with the same table.
    """
    from ..operators.bars import dedup_keep_last
    part = ["symbol", "_date"]

    def fn(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fs, p = _fs(spark, target)
        strange = {s.getPath().getName() for s in fs.listStatus(p)} - {"data", "_manifest"} if fs.exists(p) else set()
        if strange:
            raise ValueError(f"{target} holds something else: {sorted(strange)[:5]}")
        day = F.to_date(F.col(time)) if time in batch.columns else F.lit(None).cast("date")
        new = materialize(batch.withColumn("_date", day), "upsert-batch")
        touched = new.select(*part).distinct().withColumn("epoch", F.lit(epoch).cast("long"))
        merged = new.withColumn("_load", F.lit(1))
        newest = committed_epoch(spark, f"{target}/_manifest", epoch)
        if newest is not None:
            manifest = _manifest(spark, target, newest, new.schema)
            span = new.agg(F.min("_date").alias("lo"), F.max("_date").alias("hi")).first()
            dates = F.col("_date").isNull() if span.lo is None else F.col("_date").isNull() | F.col("_date").between(span.lo, span.hi)
            current = manifest.join(touched, _same(manifest, touched, part), "left_semi").where(dates)
            old = _versions(spark, target, new.schema, newest).where(dates)
            old = old.join(current, _same(old, current, [*part, "epoch"]), "left_semi").drop("epoch")
            merged = merged.unionByName(old.withColumn("_load", F.lit(0)), allowMissingColumns=True)
            touched = touched.unionByName(manifest.join(touched, _same(manifest, touched, part), "left_anti"))
        out = dedup_keep_last(merged, key, ("_load", order)).drop("_load")
        out.write.mode("overwrite").partitionBy(*part).parquet(f"{target}/data/epoch={epoch}")
        _commit(touched, f"{target}/_manifest", epoch)
    return fn


def _manifest(spark: SparkSession, target: str, epoch: int, like: T.StructType) -> DataFrame:
    schema = T.StructType([like["symbol"], T.StructField("_date", T.DateType()), T.StructField("epoch", T.LongType())])
    return spark.read.schema(schema).parquet(f"{target}/_manifest/epoch={epoch}")


def _versions(spark: SparkSession, target: str, like: T.StructType | None, epoch: int) -> DataFrame:
    """All versions of all partitions, with the columns of the newest epoch's files and of ``like``."""
    have = {f.name: f for f in spark.read.parquet(f"{target}/data/epoch={epoch}").schema.fields}
    for f in like.fields if like is not None else []:
        have[f.name] = f
    have |= {"_date": T.StructField("_date", T.DateType()), "epoch": T.StructField("epoch", T.LongType())}
    if like is None:
        have["symbol"] = T.StructField("symbol", T.StringType())
    return spark.read.schema(T.StructType(list(have.values()))).option("basePath", f"{target}/data").parquet(f"{target}/data")


def read_upserted(spark: SparkSession, target: str) -> DataFrame:
    """The table as of the newest committed epoch (symbols are read as strings)."""
    newest = committed_epoch(spark, f"{target}/_manifest")
    if newest is None:
        raise ValueError(f"no epoch is committed under {target}")
    v = _versions(spark, target, None, newest)
    m = _manifest(spark, target, newest, v.schema)
    return v.join(m, _same(v, m, ["symbol", "_date", "epoch"]), "left_semi").drop("epoch", "_date")


def vacuum_upserted(spark: SparkSession, target: str) -> int:
    """Deletes epochs that no partition of the newest manifest refers to, and older manifests; returns how many."""
    newest = committed_epoch(spark, f"{target}/_manifest")
    fs, p = _fs(spark, f"{target}/data")
    if newest is None or not fs.exists(p):
        return 0
    used = {r.epoch for r in spark.read.parquet(f"{target}/_manifest/epoch={newest}").select("epoch").distinct().collect()}
    stale = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("epoch=")]
    stale = [x for x in stale if int(x.getName().removeprefix("epoch=")) not in used]
    for x in stale:
        fs.delete(x, True)
    for s in fs.listStatus(_fs(spark, f"{target}/_manifest")[1]):
        if s.getPath().getName() != f"epoch={newest}":
            fs.delete(s.getPath(), True)
    return len(stale)


def snapshot_batch(target: str):
    """``foreachBatch`` sink for complete-mode results: each epoch overwrites
    the snapshot table (one row per key), so nothing is held on the driver."""
    def fn(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(target)
    return fn


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (sinks and checkpoints)."""
    return f"{app_dir(spark, 'streams')}/{name}-{uuid.uuid4().hex}"


class RunTotals(StreamingQueryListener):
    """Sums over every progress report of one run, also of those that the query no longer keeps."""

    def __init__(self):
        self.run_id, self.query_id = None, None
        self.batches = self.input_rows = self.dropped = 0
        self._seen, self._done = [], threading.Event()

    def watch(self, query) -> None:
        self.run_id, self.query_id = str(query.runId), str(query.id)
        for e in self._seen:
            self._add(e)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        report = (str(p.runId), p.numInputRows, sum(o.numRowsDroppedByWatermark for o in p.stateOperators))
        self._add(report) if self.run_id else self._seen.append(report)

    def onQueryTerminated(self, event) -> None:
        if self.run_id in (None, str(event.runId)):
            self._done.set()

    def _add(self, report) -> None:
        if report[0] == self.run_id:
            self.batches += 1
            self.input_rows += report[1]
            self.dropped += report[2]

    def wait(self) -> None:
        """Until the last report has come: reports arrive in order, the end of the run after them."""
        if not self._done.wait(60):
            raise TimeoutError("the end of the stream was not reported")


def run_available_now(df: DataFrame, name: str, mode: str = "append", fmt: str = "parquet",
                      foreach_batch=None, base: str | None = None) -> tuple[str, RunTotals]:
    """Run a stream over everything available, then stop; returns the
    sink path (or memory table name) and the totals of the run.

    ``base`` is the caller's folder for this stream: its checkpoint (query identity, offsets, state) and sink. A later
    run with the same ``base`` goes on where this one stopped. Without it the run gets a fresh folder.
    """
    spark = df.sparkSession
    base = base or scratch(spark, name)
    w = df.writeStream.option("checkpointLocation", f"{base}/_checkpoint").outputMode(mode)
    if foreach_batch is not None:
        w = w.foreachBatch(foreach_batch)
        sink = None
    elif fmt == "memory":
        sink = f"mem_{name}_{uuid.uuid4().hex[:8]}"
        w = w.format("memory").queryName(sink)
    else:
        sink = f"{base}/out"
        w = w.format(fmt).option("path", sink)
    totals = RunTotals()
    spark.streams.addListener(totals)
    try:
        q = w.trigger(availableNow=True).start()
        totals.watch(q)
        q.awaitTermination()
        totals.wait()
    finally:
        spark.streams.removeListener(totals)
    return sink, totals


def refresh_every(df: DataFrame, name: str, seconds: int = 60, mode: str = "append", base: str | None = None):
    """The same query on a processing-time trigger (the dashboard's refresh); ``base`` as in ``run_available_now``."""
    base = base or scratch(df.sparkSession, name)
    return (df.writeStream.option("checkpointLocation", f"{base}/_checkpoint").outputMode(mode)
            .format("parquet").option("path", f"{base}/out")
            .trigger(processingTime=f"{seconds} seconds").start())
