"""As-of join (J2), exogenous spread (J3), exogenous mapping.

Spark has no DataFrame as-of join. This one merges both sides into one series
per key, ordered by time with right rows before left rows of the same time, on the
blocked layout of ``series``: rows are numbered, cut into blocks of a fixed number
of rows, and every row gets the last right row at or before it: the last one in
its block, else the last one of the blocks before (one row per block is carried).
No row ever holds more than one right row, and no task more than one block,
however many left or right rows share a key or a time bucket's length of time.

An equal timestamp matches; no tolerance; a right row whose value is NULL is
still the match and its NULL is kept (values travel as one struct). Right rows
without a time match nothing, left rows without one have no match. Of right rows
with the same key and time the last by ``order`` counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import series


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str] | None = None,
              values: Sequence[str] = ("close",), ts: str = "ts", prefix: str = "exo_",
              left_by: Sequence[str] | None = None, right_by: Sequence[str] | None = None,
              bucket_unit: str = "hour", order: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    """For every left row, ``values`` of the newest right row with
    right.ts <= left.ts and equal key; NULL when there is none.

    ``by`` names key columns present on both sides (or give ``left_by`` /
    ``right_by`` pairwise); no key = one global right series; a NULL key equals a NULL key. ``bucket_unit`` is the
    stretch of time whose rows are numbered together: choose it so that a key has at most some
    million rows in one (``minute`` for dense ticks). Output: all left columns plus ``prefix + value`` and ``prefix + ts``.
    """
    lb = list(left_by if left_by is not None else (by or []))
    rb = list(right_by if right_by is not None else (by or []))
    kn = [f"_aj_k{i}" for i in range(len(lb))] or ["_aj_k0"]
    lk = [F.col(c).alias(k) for c, k in zip(lb, kn)] or [F.lit(0).alias("_aj_k0")]
    rk = [F.col(c).alias(k) for c, k in zip(rb, kn)] or [F.lit(0).alias("_aj_k0")]
    values = list(dict.fromkeys([*values, ts]))
    L = left.select(*lk, F.col(ts).alias("_aj_ts"), F.lit(1).alias("_aj_side"),
                    F.struct(*[F.col(f"`{c}`").alias(c) for c in left.columns]).alias("_aj_row"))
    R = right.where(F.col(ts).isNotNull()).select(
        *rk, F.col(ts).alias("_aj_ts"), F.lit(0).alias("_aj_side"),
        F.struct(*[F.col(c).alias(c) for c in values]).alias("_aj_v"),
        *[F.col(c).alias(f"_aj_o{i}") for i, c in enumerate(order)])
    ties = [f"_aj_o{i}" for i in range(len(order))]
    both = L.unionByName(R, allowMissingColumns=True)
    both = series.number_rows(both, kn, ["_aj_ts", "_aj_side", *ties], bucket_unit)
    both = series.running(both, kn, {"_aj_m": ("last", F.col("_aj_v"))}, block_rows)
    out = both.where(F.col("_aj_side") == 1)
    m = F.col("_aj_m")
    return out.select(*[F.col("_aj_row")[c].alias(c) for c in left.columns],
                      *[m[c].alias(prefix + c) for c in values if c != ts], m[ts].alias(prefix + ts))


def exogenous_spread(left: DataFrame, exo: DataFrame, by: Sequence[str] | None = None,
                     left_by: Sequence[str] | None = None, right_by: Sequence[str] | None = None,
                     name: str = "exo_spread") -> DataFrame:
    """Close - as-of exogenous close."""
    j = asof_join(left, exo, by, ("close",), left_by=left_by, right_by=right_by)
    return j.withColumn(name, F.col("close") - F.col("exo_close"))


def map_exogenous(bars: DataFrame, mapping: DataFrame) -> DataFrame:
    """Attach the optional exogenous series name (symbol → exo_symbol).

    ``mapping`` has one row per configured symbol; symbols without one keep
    NULL and get no spread.
    """
    return bars.join(mapping.select("symbol", "exo_symbol"), "symbol", "left")
