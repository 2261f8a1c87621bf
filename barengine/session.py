"""Spark session defaults and the shared checkpoint folder.

The library never creates a session inside an operator; callers pass one.
``get_spark`` is for tests, the bench and scripts.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every plan in the library relies on.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, partitions: int | None = None,
              app: str = "barengine", extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(SESSION_CONF)
    conf["spark.sql.shuffle.partitions"] = str(partitions or int(cpus))
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster (``spark.checkpoint.dir``).

    The deployment sets it and it is only read here. Where it is unset, a
    session on one machine (``local`` master, as in tests) gets a scratch
    folder; on a cluster that is an error, as executors would not see it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="barengine-ckpt-", dir=os.environ.get("BARENGINE_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def app_dir(spark: SparkSession, sub: str = "barengine") -> str:
    """This application's own folder under the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{sub}/{spark.sparkContext.applicationId}"


def apply_session_conf(spark: SparkSession) -> None:
    """Pin the settings that change results (time zone) on a given session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def materialize(df, name: str = "stage"):
    """Cut lineage: write ``df`` once as Parquet under the shared checkpoint
    folder (``spark.checkpoint.dir``) and read it back.

    One job, no recomputation (``Dataset.checkpoint(eager=True)`` runs the
    plan twice), the files live in shared storage so a lost executor does not
    replay the lineage, and the reader gets Parquet statistics.
    """
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    # the schema is known, so nothing is inferred from a file and empty tables read back
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, asked of its own Hadoop FileSystem."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drop_materialized(spark) -> None:
    """Delete what this application wrote under the checkpoint folder with
    ``materialize`` and the stream helpers. Other applications that share the
    folder keep theirs. Call it when the DataFrames built on those tables are
    no longer needed; it uses the Hadoop FileSystem of the folder."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        return
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for sub in ("barengine", "streams", "io"):
        p = jvm.org.apache.hadoop.fs.Path(app_dir(spark, sub))
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            fs.delete(p, True)
