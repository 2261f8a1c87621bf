"""Affine scan  y_t = a_t * y_{t-1} + b_t  per series, in blocks.

Spark has no recursive window function. The scan is split the same way as
every other series operator. A row is a map y -> a*y + b, and maps compose to
maps, so any stretch of rows folds into one map. A row whose ``a`` or ``b`` is
NULL is a *gap*: its map is the identity, so the state is carried over it, and its own
output is NULL.

1. each block of ``block_rows`` consecutive rows is folded into one map
   (A, B); only the narrow columns (keys, block, _rn, a, b) are shuffled for this;
2. the block maps of a series, one row per block, are scanned in one group;
3. each block is scanned again from its carry-in (the value at the end of
   the block before) by a cogrouped function; every original column passes
   through, so no join back is needed.

Inside a group maps are composed by doubling (each pass composes every map
with the one 1, 2, 4, ... places before), log2(rows) passes over whole NumPy arrays and no
loop over rows. Composition only multiplies and adds, so it is as stable as the
recurrence, also where products of ``a`` reach 0. The same three steps run for series of every
length. A task holds one block; step 2 holds rows / block_rows maps of a
series (65,536 for a series of 4 * 10^9 rows). Several recurrences
(``specs``) run in the same passes.

Steps 1 and 3 both read the input, and chained averages (EMA of EMA) feed
one scan into the next, so the input is first written as a table under the
cluster's ``spark.checkpoint.dir`` and read back: the lineage stops there,
the input is computed once, and a lost executor does not replay the chain.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .series import BLK, RN, block_of


def compose(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps of all prefixes: (A, B) with y_t = A_t * y_{-1} + B_t."""
    a, b = a.copy(), b.copy()
    step = 1
    while step < len(a):
        b[step:] = a[step:] * b[:-step] + b[step:]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a, b


def _maps(t: pa.Table, a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, gap) of a table's rows; a gap is the identity, a NaN stays a NaN."""
    gap = np.asarray(t[a].is_null()) | np.asarray(t[b].is_null())
    x = np.where(gap, 1.0, t[a].to_numpy(zero_copy_only=False))
    return x, np.where(gap, 0.0, t[b].to_numpy(zero_copy_only=False)), gap


def _ordered(t: pa.Table) -> pa.Table:
    return t.take(pa.array(np.argsort(t[RN].to_numpy(), kind="stable")))


def _fold_fn(names: list[str], keys: list[str]):
    def fold(t: pa.Table) -> pa.Table:
        t = _ordered(t)
        cols = {k: t[k].slice(0, 1) for k in (*keys, BLK)}
        for n in names:
            a, b = compose(*_maps(t, f"_sa_{n}", f"_sb_{n}")[:2])
            cols |= {f"_A_{n}": pa.array(a[-1:]), f"_B_{n}": pa.array(b[-1:])}
        return pa.table(cols)
    return fold


def _carry_fn(names: list[str], keys: list[str]):
    """Maps of the blocks of a series -> value before each block but the first."""
    def carry(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t[BLK].to_numpy(), kind="stable")))
        cols = {k: t[k] for k in keys} | {BLK: pa.array(t[BLK].to_numpy() + 1)}
        for n in names:
            cols[f"_c_{n}"] = pa.array(compose(t[f"_A_{n}"].to_numpy(), t[f"_B_{n}"].to_numpy())[1])
        return pa.table(cols)
    return carry


def _apply_fn(names: list[str], columns: list[str]):
    def apply(t: pa.Table, carry: pa.Table) -> pa.Table:
        t = _ordered(t).select(columns) if t.num_rows else t.select(columns)
        for n in names:
            a, b, gap = _maps(t, f"_sa_{n}", f"_sb_{n}")
            a, b = compose(a, b)
            y = a * carry[f"_c_{n}"][0].as_py() + b if carry.num_rows and len(a) else b
            t = t.append_column(n, pa.array(y, pa.float64(), mask=gap | np.isnan(y)))
        return t
    return apply


def affine_scan(df: DataFrame, keys: Sequence[str], specs: dict[str, tuple[Column, Column]],
                block_rows: int | None = None) -> DataFrame:
    """Add one column per spec: name -> (a, b); input needs ``_rn``.

    ``y_{-1} = 0``; a seed row is a row with a = 0 and b = seed. A row with a NULL ``a`` or ``b``
    is a gap: its output is NULL and the next row goes on from the state before it. A NaN
    reaches all later rows, which are NULL then (NaN does not leave the library).
    """
    keys, names = list(keys), list(specs)
    d = df.select("*", block_of(F.col(RN), block_rows).alias(BLK), *[x for n in names for x in (
        specs[n][0].cast("double").alias(f"_sa_{n}"), specs[n][1].cast("double").alias(f"_sb_{n}"))])
    d = materialize(d, "scan")
    kfields = [d.schema[k] for k in keys] + [T.StructField(BLK, T.LongType())]
    doubles = lambda *cols: [T.StructField(c, T.DoubleType()) for c in cols]
    narrow = d.select(*keys, BLK, RN, *[f"_s{x}_{n}" for n in names for x in "ab"])
    maps = narrow.groupBy(*keys, BLK).applyInArrow(
        _fold_fn(names, keys), T.StructType(kfields + doubles(*[f"_{x}_{n}" for n in names for x in "AB"])))
    carry = maps.groupBy(*keys).applyInArrow(
        _carry_fn(names, keys), T.StructType(kfields + doubles(*[f"_c_{n}" for n in names])))
    out = T.StructType(d.schema.fields + doubles(*names))
    res = d.groupBy(*keys, BLK).cogroup(carry.groupBy(*keys, BLK)).applyInArrow(_apply_fn(names, d.columns), out)
    return res.drop(BLK, *[f"_s{x}_{n}" for n in names for x in "ab"])
