"""Leaderboard and small report tables.

Sorting is distributed (range partitioning); the top-k reports keep a limit
because the limit is the feature (top 5 runs, newest 5 signals, top k
importances). Per-group top-k uses ``row_number`` over (group) ordered by the
metric, which Spark plans as a per-partition top-k (WindowGroupLimit) before
the full window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leaderboard(metrics: DataFrame, score: str = "final_score") -> DataFrame:
    """O1: best first, missing scores last."""
    return metrics.orderBy(F.col(score).desc_nulls_last())


def sorted_by(metrics: DataFrame, key: str, ascending: bool = False) -> DataFrame:
    """O2: sort by any column in either direction (missing last)."""
    c = F.col(key)
    return metrics.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last())


def score_band(score: str = "final_score") -> Column:
    """P11: 'good' from 0.7, 'bad' below 0.6, else 'fair' (missing → 'fair')."""
    s = F.col(score)
    return F.when(s >= 0.7, "good").when(s < 0.6, "bad").otherwise("fair")


def side_label(signal: str = "signal") -> Column:
    """BUY / SELL / HOLD from the sign of the signal."""
    s = F.col(signal)
    return F.when(s > 0, "BUY").when(s < 0, "SELL").otherwise("HOLD")


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Column, n: int) -> DataFrame:
    """The first n rows of each group by ``order``."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def latest_per_symbol(df: DataFrame, n: int = 1, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Newest n rows per symbol (max_by for n = 1: a partial aggregation)."""
    if n == 1:
        rest = [c for c in df.columns if c not in keys]
        a = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ts").alias("_r"))
        return a.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return top_n_per_group(df, keys, F.col("ts").desc(), n).drop("rank")


def tail(df: DataFrame, n: int = 5, order: str = "ts") -> DataFrame:
    """Newest n rows overall (limit is the feature)."""
    return df.orderBy(F.col(order).desc()).limit(n)


def top_k(df: DataFrame, k: int, by: str) -> DataFrame:
    """K rows with the largest ``by``."""
    return df.orderBy(F.col(by).desc_nulls_last()).limit(k)


def best_trial(runs: DataFrame, group: Sequence[str] = ("experiment",)) -> DataFrame:
    """Parameters of the lowest-mse trial per experiment (min_by)."""
    return runs.groupBy(*group).agg(F.min_by(F.struct("trial", "params"), "mse").alias("_b"),
                                    F.min("mse").alias("mse")).select(
        *group, F.col("_b.trial").alias("trial"), F.col("_b.params").alias("params"), "mse")


def percent_format(col: str, digits: int = 2) -> Column:
    """number as text with fixed decimals."""
    return F.format_number(F.col(col), digits)
