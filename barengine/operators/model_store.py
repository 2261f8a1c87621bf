"""Versions of fitted models and of the best ones.

A store is a folder with ``models/version=N`` (the rows of one save) and ``best/version=N`` (what one promotion kept:
model rows, metrics and equity curves). A version is written beside its place and then renamed into it, so it is there
whole or not at all, never changes, and the newest number is the current one: publishing a version moves the pointer.
Two writers cannot take one number, as the rename fails where the place is taken (atomic on HDFS-like
file systems, not on plain object stores); the slower one takes the next.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SCORE_KEEP
from ..sources import files
from .backtest import promote_best

MODELS = "model string, freq string, label string, weights array<double>"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs, p, spark.sparkContext._jsc.hadoopConfiguration()


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The published versions in ``folder``, ascending."""
    _, p, conf = _hadoop(spark, folder)
    fs = p.getFileSystem(conf)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))


def _publish(spark: SparkSession, made: str, folder: str) -> int:
    """Renames the complete folder ``made`` to the next free version of ``folder``."""
    hfs, src, conf = _hadoop(spark, made)
    context = hfs.FileContext.getFileContext(src.getFileSystem(conf).getUri(), conf)
    gateway = spark.sparkContext._gateway
    plain = gateway.new_array(getattr(hfs, "Options$Rename"), 0)
    while True:
        n = max(versions(spark, folder), default=0) + 1
        try:
            context.rename(context.makeQualified(src), context.makeQualified(hfs.Path(f"{folder}/version={n}")), plain)
            return n
        except Py4JJavaError:
            if n not in versions(spark, folder):  # not taken by another writer: a real fault
                raise


def save_models(models: DataFrame, root: str) -> int:
    """The model rows (model, freq, label, weights) as a new version; returns its number."""
    spark = models.sparkSession
    made = f"{root}/models/_made-{uuid.uuid4().hex}"
    models.select("model", "freq", "label", "weights").write.parquet(made)
    return _publish(spark, made, f"{root}/models")


def load_models(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of one version, the newest by default."""
    have = versions(spark, f"{root}/models")
    if not have or (version is not None and version not in have):
        raise ValueError(f"no version {version or ''} of models under {root}")
    return spark.read.schema(MODELS).parquet(f"{root}/models/version={version or have[-1]}")


def discover_models(spark: SparkSession, root: str, newest: bool = True) -> DataFrame:
    """The model rows below ``root`` with ``path`` and ``version``, without those of any ``best`` folder.

    With ``newest`` only the row of the highest version of each (model, freq, label).
    """
    d = spark.read.schema(MODELS).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)
    d = d.withColumn("path", F.col("_metadata.file_path"))
    inside = F.split(F.regexp_extract("path", f"/{root.rstrip('/').split('/')[-1]}/(.*)$", 1), "/")
    d = d.where(~F.array_contains(inside, "best"))
    d = d.withColumn("version", F.regexp_extract("path", r"/version=(\d+)/", 1).cast("long"))
    if not newest:
        return d
    rest = [c for c in d.columns if c not in ("model", "freq", "label", "version")]
    g = d.groupBy("model", "freq", "label").agg(F.max("version").alias("version"), F.max_by(F.struct(*rest), "version").alias("_r"))
    return g.select("model", "freq", "label", *[F.col(f"_r.{c}").alias(c) for c in rest], "version")


def promote(models: DataFrame, metrics: DataFrame, periods: DataFrame, root: str, keep: float = SCORE_KEEP) -> int:
    """Publishes the models with a score of ``keep`` or more: their rows, their metrics (S8) and curves.

    ``metrics`` has one row per (model, symbol), ``periods`` the columns model, symbol, period and cum. A promotion that
    keeps nothing is a version too: then nothing is best. Returns the version.
    """
    spark = metrics.sparkSession
    made = f"{root}/best/_made-{uuid.uuid4().hex}"
    kept = promote_best(metrics, keep)
    pairs = kept.select("model", "symbol")
    (models.join(pairs.select("model").distinct(), "model", "left_semi").select("model", "freq", "label", "weights")
     .write.parquet(f"{made}/models"))
    files.write_metrics(kept, f"{made}/metrics")
    files.write_equity(periods.join(pairs, ["model", "symbol"], "left_semi").select("model", "symbol", "period", "cum"), f"{made}/equity")
    return _publish(spark, made, f"{root}/best")


def best_folder(spark: SparkSession, root: str) -> str | None:
    """The folder of the newest promotion (``models``, ``metrics`` and ``equity`` lie in it)."""
    have = versions(spark, f"{root}/best")
    return f"{root}/best/version={have[-1]}" if have else None
