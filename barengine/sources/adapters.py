"""Adapters from the driver's tables to tick and bar rows.

The driver tables are not market data; each adapter maps one table to the
TICKS schema (symbol, ts, seq, price, size) with a total order (ts, seq).
All reads go through ``spark.read.parquet`` so column pruning and filter
pushdown reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_session_conf


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Bucketing and the naive → instant cast depend on the session time zone;
    # the library's contract is UTC whatever session it is handed.
    apply_session_conf(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ts(col: str):
    # Test Parquet stores naive timestamps (TIMESTAMP_NTZ); the library works on
    # TIMESTAMP under a UTC session, which streaming watermarks require.
    return F.col(col).cast("timestamp")


def ticks_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main adapter: one series per event_type, price = value."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        _ts("ts").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").cast("double").alias("price"),
        F.lit(1.0).alias("size"),
    )


def ticks_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short series: one per user_id."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("symbol"),
        _ts("ts").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").cast("double").alias("price"),
        F.lit(1.0).alias("size"),
    )


def ticks_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series with many ties per timestamp: one per order priority."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        _ts("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").cast("double").alias("price"),
        F.lit(1.0).alias("size"),
    )


def sessions_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading calendar: every date on which any order was placed."""
    return (table(spark, sf_dir, "orders")
            .select(F.to_date(_ts("o_orderdate")).alias("trade_date"))
            .distinct())


def weekday_sessions(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Calendar of Monday-Friday dates in [start, end]."""
    d = F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return (spark.range(1).select(d.alias("trade_date"))
            .where(F.weekday("trade_date") < 5))
