"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import app_dir, materialize  # noqa: F401  (re-exported to the operators)

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def crc(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes (null: of no bytes)."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).cast("long")


def key_text(col: Column) -> Column:
    """A key as text; a null key is the text ``null``."""
    return F.coalesce(col.cast("string"), F.lit("null"))


def md5_number(text: Column, first: int, digits: int) -> Column:
    """Unsigned number in hexadecimal digits ``first .. first+digits-1`` (from 1) of the MD5 of ``text``."""
    return F.conv(F.substring(F.md5(text.cast("binary")), first, digits), 16, 10).cast("decimal(20,0)")


#: Parquet for rows of packed arrays: a row may be megabytes, so pages and row groups end by size from the first row on,
#: and a writer holds little more than one row group (by default it looks after 100 rows, at 128 MB).
PACKED_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "16"}
#: Bytes of an Arrow batch on its way to Python; 10,000 rows (the default) are any size.
BATCH_BYTES = 15 << 18


@contextmanager
def settings(spark: SparkSession, more: dict[str, str] | None = None) -> Iterator[None]:
    """Small Arrow batches, and ``more``, for the jobs inside; then all is as before."""
    conf = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)} | (more or {})
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables in the shared folder that are given back as soon as they are no longer needed.

    Each is written by one job, whose shuffle files go when it ends.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{app_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        with settings(self.spark, {self.CLEANUP: "true"}):
            df.write.options(**PACKED_ROWS).parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        for path in self.paths.pop(name, []):
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
