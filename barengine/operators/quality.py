"""Load checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_symbols(configured: DataFrame, bars: DataFrame) -> DataFrame:
    """Configured symbols without any bar (anti join on the distinct
    symbols, which Spark aggregates partially before the shuffle)."""
    present = bars.select("symbol").distinct()
    return configured.select("symbol").join(present, "symbol", "left_anti")


def load_report(configured: DataFrame, bars: DataFrame) -> DataFrame:
    """Rows per configured symbol; ``status`` is 'empty' for none."""
    counts = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    r = configured.select("symbol").join(counts, "symbol", "left").fillna({"rows": 0})
    return r.withColumn("status", F.when(F.col("rows") == 0, "empty").otherwise("ok"))


def non_empty_or_fail(configured: DataFrame, bars: DataFrame) -> DataFrame:
    """The report, failing the job (``raise_error``) if a symbol is empty."""
    r = load_report(configured, bars)
    return r.withColumn("rows", F.when(F.col("rows") > 0, F.col("rows")).otherwise(
        F.raise_error(F.concat(F.lit("no data returned for "), F.col("symbol"))).cast("long")))
