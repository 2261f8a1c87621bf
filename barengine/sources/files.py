"""Bar store and report files (S1-S5, S8-S13; landing of files is in ``landing``).

One bar table for all tickers and frequencies, Parquet partitioned by
``freq`` and ``symbol`` (ticker and frequency are columns, not path parts of
separate files). Reads use a fixed schema; partition pruning on ``freq`` /
``symbol`` and filter pushdown on ``ts`` reach the scan. Reports (metrics,
equity curves, importances) are CSV as in the reference, written by Spark
(one folder per table, partitioned by model instead of one file per model).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BARS

INDEX_NAMES = ("ts", "__index_level_0__", "Date", "Datetime", "date", "datetime", "index")
_CASE = {"open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume",
         "adj close": "adj_close", "adj_close": "adj_close"}


def _bar_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    cols = {c.lower(): c for c in df.columns}
    ts = next((cols[n.lower()] for n in INDEX_NAMES if n.lower() in cols), None)
    if ts is None:
        raise ValueError(f"no time column among {df.columns}")
    out, seen = [*[F.col(k) for k in keep], F.col(ts).cast("timestamp").alias("ts")], set()
    for src, dst in _CASE.items():
        if src in cols and dst not in seen:
            seen.add(dst)
            out.append(F.col(cols[src]).cast("double").alias(dst))
    missing = {"open", "high", "low", "close"} - seen
    if missing:
        raise ValueError(f"missing bar columns {sorted(missing)}")
    d = df.select(*out)
    if "volume" not in seen:
        d = d.withColumn("volume", F.lit(None).cast("double"))
    return d


def normalize_bars(df: DataFrame, symbol: str | None = None, freq: str | None = None) -> DataFrame:
    """Map a landed frame to the bar schema: index column → ``ts``,
    Open/High/... → lower case; a missing Volume stays NULL; unknown columns
    are dropped. A missing OHLC column is an error."""
    d = _bar_columns(df)
    if symbol is not None:
        d = d.withColumn("symbol", F.lit(symbol))
    if freq is not None:
        d = d.withColumn("freq", F.lit(freq))
    return d


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write bars (or features) partitioned by freq and symbol.

    Dynamic partition overwrite replaces only the (freq, symbol) folders that
    appear in ``bars``. Writers are spread by (freq, symbol, day), so a hot
    symbol is written by many tasks (one file per day-slice, not one giant
    task); rows are sorted by time inside each file (O3) so readers get
    row-group statistics on ``ts``.
    """
    spark = bars.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    (bars.repartition("freq", "symbol", F.to_date("ts")).sortWithinPartitions("ts")
     .write.mode(mode).partitionBy("freq", "symbol").parquet(path))


def read_bars(spark: SparkSession, path: str, freq: str | None = None,
              symbols: list[str] | None = None) -> DataFrame:
    """The bar store as one DataFrame; ``freq="all"`` or None
    reads every frequency. Filters on the partition columns prune folders."""
    schema = T.StructType([f for f in BARS.fields if f.name != "symbol"] + [
        T.StructField("freq", T.StringType()), T.StructField("symbol", T.StringType())])
    d = spark.read.schema(schema).option("basePath", path).parquet(path)
    if freq and freq != "all":
        d = d.where(F.col("freq") == freq)
    if symbols:
        d = d.where(F.col("symbol").isin(symbols))
    return d.select("symbol", "freq", "ts", "open", "high", "low", "close", "volume")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics CSV with header, one folder per model (the reference
    writes one ``metrics.csv`` for all plus one per kept model)."""
    metrics.write.mode("overwrite").option("header", True).partitionBy("model").csv(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every metrics file below ``path`` as one table; the model
    name comes from its folder."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_equity(curves: DataFrame, path: str) -> None:
    """Equity curves as CSV without header, one folder per model and series."""
    curves.write.mode("overwrite").option("header", False).partitionBy("model", "symbol").csv(path)


def read_equity(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All equity curves with a label 'model/series' from their folders."""
    d = spark.read.option("header", False).schema(schema).csv(path)
    return d.withColumn("label", F.concat_ws("/", "model", "symbol"))


def write_importances(imp: DataFrame, path: str) -> None:
    """(feature, importance) CSV."""
    imp.write.mode("overwrite").option("header", True).csv(path)


def read_importances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("feature string, importance double").csv(path)


def file_inventory(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """Files with size and modification time; only metadata columns are
    selected, so the binary content is never read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
            .load(path).select("path", "modificationTime", "length"))
