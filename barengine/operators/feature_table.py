"""The feature table of a bar table and its bucketed layout.

``compute_features`` puts all feature blocks beside the bars: indicators by name, price action, return embeddings,
calendar columns and the spread to an outside series. The bars are numbered once and written to the checkpoint
folder; every window block then runs on that table's blocked layout.

``write_feature_table`` lays a table out in hash buckets of (symbol, ts), each sorted by them. Tables with the
same number of buckets join on these columns without an exchange, and since the time is part of the hash a hot symbol fills all
buckets alike. A session without a metastore opens such a folder again with ``open_feature_table``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import asof, calendar, embeddings, series
from . import labels as L
from . import price_action as PA
from .indicators import suite

KEYS = ("symbol", "ts")


def compute_features(bars: DataFrame, exogenous: DataFrame | None = None, sessions: DataFrame | None = None,
                     names: Sequence[str] | None = None, lengths: Sequence[int] = (32, 64),
                     exogenous_by: Sequence[str] | None = None) -> DataFrame:
    """The bars with all feature columns, one row per bar.

    ``names`` are the indicators (all by default); ``lengths`` those of the return embeddings ``emb_<n>``; ``sessions``
    a calendar for ``holiday_flag`` (0 without one); ``exogenous`` a series whose as-of close gives ``exo_spread``, one for all
    symbols or, with ``exogenous_by``, one per value of these columns. The average true range is the indicator ``atr``.
    """
    keys = ["symbol"]
    d = bars
    if exogenous is not None:
        d = asof.exogenous_spread(d, exogenous, exogenous_by).drop("exo_close", "exo_ts")
    d = materialize(series.number_rows(d, keys), "numbered")
    names = suite.available("volume" in bars.columns) if names is None else list(names)
    d = suite.add_indicators(d, names, keys, numbered=True)
    more = {**PA.price_action_columns(), **calendar.calendar_columns()}
    d = d.select("*", *[c.alias(n) for n, c in more.items()])
    stages = [lambda w: {"_ret": L.simple_return(w)},
              lambda w: {f"emb_{n}": embeddings.window_embedding("_ret", n, w) for n in lengths}]
    d = series.staged(d, keys, stages, back=max(lengths, default=1), numbered=True).drop("_ret")
    return calendar.holiday_flag(d, sessions)


def label_table(bars: DataFrame, thresh: float = 0.002) -> DataFrame:
    """(symbol, ts, label_b1, label_t3, label_r), the other side of a training join."""
    n = materialize(series.number_rows(bars.select("symbol", "ts", "close"), ["symbol"]), "numbered")
    d = series.with_series_columns(n, ["symbol"], lambda w: {
        "label_b1": L.label_b1(w), "label_t3": L.label_t3(w, thresh), "label_r": L.label_r(w)}, back=0, fwd=1, numbered=True)
    return d.select("symbol", "ts", "label_b1", "label_t3", "label_r")


def write_feature_table(df: DataFrame, name: str, path: str, buckets: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """``df`` as the table ``name`` with its files in ``path``, one file per bucket, sorted by ``keys``.

    Choose ``buckets`` so that one of them fits a task (about 200 MB of Parquet) and use it for all tables that are joined.
    """
    keys = list(keys)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    (df.repartition(buckets, *keys).write.mode("overwrite").option("path", path).format("parquet")
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
    return df.sparkSession.table(name)


def open_feature_table(spark: SparkSession, name: str, path: str, buckets: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """A table that ``write_feature_table`` wrote in another session, under the same bucket number."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
              f"INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def join_features(left: DataFrame, *others: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """J1 for separate tables: left joins on equal (symbol, ts); a NULL key matches nothing. Tables of one bucket
    number are joined bucket by bucket, without a shuffle."""
    for o in others:
        left = left.join(o, list(keys), "left")
    return left
