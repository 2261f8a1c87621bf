"""Design matrices, splits and folds.

Row positions come from the blocked numbering (``series.number_rows``), so
no split needs a window over a whole series. Two split modes:

* ``per_symbol_time`` (default): the first ``frac`` of each series trains,
  the rest validates; no future bar of a series leaks into its training set.
* ``positional`` (parity with the reference): series are concatenated in
  symbol order and the first ``int(frac * N)`` rows overall train.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import labels as L
from . import series

OHLCV = {"open", "high", "low", "close", "volume"}


def select_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Every column that is not OHLCV, a key or excluded."""
    skip = OHLCV | {"symbol", "ts", "freq"} | set(exclude)
    return [c for c in df.columns if c not in skip and not c.startswith("_")]


def flatten_arrays(df: DataFrame, col: str, n: int) -> DataFrame:
    """P10: array column → n scalar columns col_0..col_{n-1}."""
    return df.select("*", *[F.col(col)[i].alias(f"{col}_{i}") for i in range(n)]).drop(col)


def design_matrix(bars: DataFrame, n_lags: int = 5, keys: Sequence[str] = ("symbol",),
                  thresh: float = 0.002) -> DataFrame:
    """Lagged returns x_0..x_{n-1} and the three labels per bar, keeps ``_rn``."""
    keys = list(keys)
    d = series.number_rows(bars, keys)
    stages = [lambda w: {"_ret": L.simple_return(w), "label_b1": L.label_b1(w),
                         "label_t3": L.label_t3(w, thresh), "label_r": L.label_r(w)},
              lambda w: {f"x{i}": (F.coalesce(F.lag("_ret", i).over(w), F.lit(0.0)) if i else F.col("_ret"))
                         for i in range(n_lags)}]
    return series.staged(d, keys, stages, back=n_lags, fwd=1, numbered=True, keep_rn=True).drop("_ret")


def series_counts(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """A15 per series: rows per series (a partial aggregation)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def train_val_split(df: DataFrame, frac: float = 0.8, mode: str = "per_symbol_time",
                    keys: Sequence[str] = ("symbol",), counts: DataFrame | None = None) -> DataFrame:
    """M1: adds ``split`` = 'train' / 'val'; input needs ``_rn``.

    ``counts`` (keys, _n) may be given from an earlier, cheaper stage (e.g.
    the bars before their window columns) so the windowed plan is not
    planned twice."""
    keys = list(keys)
    if mode == "per_symbol_time" and series.LEN in df.columns:
        # series lengths came with the row numbers: no join at all
        out = df.withColumn("split", F.when(F.col(series.RN) < F.floor(F.col(series.LEN) * frac), "train")
                            .otherwise("val"))
        return out
    counts = series_counts(df, keys) if counts is None else counts
    if mode == "per_symbol_time":
        cut = counts.select(*keys, F.floor(F.col("_n") * frac).alias("_cut"))
        # One row per series: no broadcast hint (the number of series has no
        # fixed bound); AQE broadcasts it at run time when it is small.
        j = df.join(cut, keys, "inner")
        pos = F.col(series.RN)
    elif mode == "positional":
        # Global position over series in key order: offsets are a prefix sum
        # over the counts table (one row per series, not per bar).
        w = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
        offs = counts.select(*keys, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"),
                             F.sum("_n").over(Window.partitionBy()).alias("_total"))
        offs = offs.withColumn("_cut", F.floor(F.col("_total") * frac))
        j = df.join(offs, keys, "inner")
        pos = F.col("_off") + F.col(series.RN)
    else:
        raise ValueError(mode)
    out = j.withColumn("split", F.when(pos < F.col("_cut"), "train").otherwise("val"))
    return out.drop("_cut", "_off", "_total")


def time_series_folds(df: DataFrame, k: int = 3, keys: Sequence[str] = ("symbol",),
                      counts: DataFrame | None = None) -> DataFrame:
    """M2: expanding folds per series; test size n // (k+1), training = all
    rows before the fold's test block. Adds ``fold`` and ``role`` (one output
    row per fold the row takes part in; no join, an ``explode``)."""
    keys = list(keys)
    counts = (series_counts(df, keys) if counts is None else counts).withColumn("_ts", F.floor(F.col("_n") / (k + 1)))
    j = df.join(counts, keys, "inner")
    pos = F.col(series.RN)
    start = F.col("_n") - F.lit(k) * F.col("_ts")

    def member(i: int) -> Column:
        t0 = start + F.lit(i) * F.col("_ts")
        return (F.when(pos < t0, F.struct(F.lit(i).alias("fold"), F.lit("train").alias("role")))
                .when(pos < t0 + F.col("_ts"), F.struct(F.lit(i).alias("fold"), F.lit("test").alias("role"))))
    e = j.withColumn("_m", F.explode(F.array_compact(F.array(*[member(i) for i in range(k)]))))
    return e.select(*[c for c in df.columns], F.col("_m.fold").alias("fold"), F.col("_m.role").alias("role"))


def fold_slices(df: DataFrame, k: int = 3, keys: Sequence[str] = ("symbol",), counts: DataFrame | None = None) -> DataFrame:
    """M2 without copies: adds ``slice``, 0 before the first test block and i + 1 in the test block of fold i.

    Fold i of ``time_series_folds`` trains on slices 0 .. i and is tested on slice i + 1, so additive
    statistics per slice give those of all folds. Input needs ``_rn``; ``_len`` saves the join with the counts."""
    keys = list(keys)
    if series.LEN in df.columns:
        j = df.withColumn("_n", F.col(series.LEN))
    else:
        j = df.join(series_counts(df, keys) if counts is None else counts, keys, "inner")
    test = F.floor(F.col("_n") / (k + 1))
    start = F.col("_n") - F.lit(k) * test
    at = F.when(F.col(series.RN) < start, 0).otherwise(1 + F.floor((F.col(series.RN) - start) / F.nullif(test, F.lit(0))))
    return j.withColumn("slice", at.cast("int")).drop("_n")


def synthetic_prices(spark, n: int = 200, seed: int = 0, start: str = "2020-01-01") -> DataFrame:
    """Random-walk closes 100 + cumsum(N(0,1)), daily, O=H=L=C.

    For smoke tests only; the cumulative sum is a window over one series of
    ``n`` rows."""
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    d = spark.range(n).withColumn("close", 100 + F.sum(F.randn(seed)).over(w))
    return d.select(F.lit("SYN").alias("symbol"),
                    F.date_add(F.to_date(F.lit(start)), F.col("id").cast("int")).cast("timestamp").alias("ts"),
                    F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"),
                    "close")


def synthetic_features(spark, n: int = 200, k: int = 10, seed: int = 42) -> DataFrame:
    """N × k Gaussian features f0..f{k-1} plus a Gaussian close."""
    return spark.range(n).select("id", *[F.randn(seed + i).alias(f"f{i}") for i in range(k)],
                                 F.randn(seed + k).alias("close"))
