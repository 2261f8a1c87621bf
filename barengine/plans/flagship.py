"""Flagship query: hour bars from ticks, labels, summary per symbol (the slice of §7.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import series
from .inputs import event_bars
from .output import finalize


def run(spark: SparkSession, sf: str) -> DataFrame:
    bars = event_bars(spark, sf, "1 hour")

    def build(w):
        return {"label_b1": L.label_b1(w), "label_r": L.label_r(w)}
    lab = series.with_series_columns(bars, ["symbol"], build, back=0, fwd=1)
    out = lab.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"),
        F.avg("label_b1").alias("share_up"),
        F.avg("label_r").alias("avg_label_r"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"))
    return finalize(out)
