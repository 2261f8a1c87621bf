"""Bar inputs built from the driver's tables, shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.bars import bars_from_ticks
from ..sources import adapters


def event_bars(spark: SparkSession, sf: str, width: str = "1 hour") -> DataFrame:
    """Main series: one per event_type, hour bars by default (3,385 at sf0.01)."""
    return bars_from_ticks(adapters.ticks_events(spark, sf), width)


def user_bars(spark: SparkSession, sf: str, width: str = "1 hour") -> DataFrame:
    """Many short series: one per user_id."""
    return bars_from_ticks(adapters.ticks_users(spark, sf), width)


def order_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per order priority (prices of several 100,000)."""
    return bars_from_ticks(adapters.ticks_orders(spark, sf), "1 day")
