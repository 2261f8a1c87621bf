"""Skew-proof layout for per-series window work.

A window ``partitionBy(symbol).orderBy(ts)`` puts a whole series into one
task; when one symbol holds a third of all rows that task holds a third of the
data. Every series operator in the library therefore runs on fixed-size
*blocks* of rows instead:

1. ``number_rows`` gives each row its 0-based position ``_rn`` in its series.
   Rows are numbered inside (series, time bucket) and shifted by the number of
   rows in earlier buckets; the bucket counts are a small table whose prefix
   sums run as a window over (series) on that small table only.
2. ``blocked`` cuts the series into blocks of ``block_rows`` positions and
   copies the last ``back`` rows of each block into the next block (and the
   first ``fwd`` rows into the previous one) as *halo* rows. A window over
   ``partitionBy(series, _blk).orderBy(_rn)`` then sees every row it needs
   for frames of at most ``back`` rows behind and ``fwd`` rows ahead; halo
   rows are dropped afterwards. No task ever holds more than one block plus
   its halos, whatever the skew.
3. ``running`` handles frames that start at the beginning of the series
   (cumulative sum / product / max / min / last non-null): each block is
   reduced to one row, the small block table gets an exclusive prefix, and the
   carry is joined back by (series, block).

The block size bounds task memory; bucket counts bound the numbering step.
Bars are unique per (series, ts), so a day bucket holds at most 1,440 minute
bars; tick tables are aggregated to bars before they reach this module.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = int(os.environ.get("BARENGINE_BLOCK_ROWS", 1 << 16))
BUCKET_UNIT = "day"

RN, BLK, HALO, LEN = "_rn", "_blk", "_halo", "_len"


def _keys(keys: Iterable[str] | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def number_rows(df: DataFrame, keys: Sequence[str] = ("symbol",),
                order: Sequence[str] = ("ts",), bucket_unit: str = BUCKET_UNIT,
                with_length: bool = False) -> DataFrame:
    """Add ``_rn``: position of the row in its series, 0-based, by ``order``.

    ``order`` must be a total order inside a series and its first column a
    timestamp (the bucket is taken from it). ``with_length`` also adds
    ``_len`` (rows in the series), carried by the same small offsets join.
    """
    keys = _keys(keys)
    order = list(order)
    bkt = "_bkt"
    d = df.withColumn(bkt, F.date_trunc(bucket_unit, F.col(order[0])))
    w_in = Window.partitionBy(*keys, bkt).orderBy(*order)
    d = d.withColumn("_r", F.row_number().over(w_in) - 1)
    # Per-bucket counts: partial aggregation before the shuffle, tiny result.
    counts = d.groupBy(*keys, bkt).agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(*keys).orderBy(bkt).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_n").over(Window.partitionBy(*keys)).cast("long").alias(LEN)] if with_length else []
    offsets = counts.select(*keys, bkt, F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"), *extra)
    out = _join_keys(d, offsets, [*keys, bkt])
    return out.withColumn(RN, (F.col("_off") + F.col("_r")).cast("long")).drop("_off", "_r", bkt)


def _join_keys(big: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on ``on`` with NULL-safe equality (a NULL key is a series too)."""
    s = small.select(*[F.col(c).alias(f"_j_{c}") for c in on],
                     *[c for c in small.columns if c not in on])
    cond = None
    for c in on:
        e = big[c].eqNullSafe(s[f"_j_{c}"])
        cond = e if cond is None else cond & e
    return big.join(s, cond, "inner").drop(*[f"_j_{c}" for c in on])


_PLAN_ROWS: ContextVar[int | None] = ContextVar("block_rows", default=None)


@contextmanager
def block_size(rows: int) -> Iterator[None]:
    """Plans built inside use blocks of ``rows`` rows wherever no size is given.

    Answers do not depend on the block size; it bounds the memory of a task.
    """
    token = _PLAN_ROWS.set(rows)
    try:
        yield
    finally:
        _PLAN_ROWS.reset(token)


def _rows(block_rows: int | None) -> int:
    # Read at call time so tests can shrink blocks to a few rows.
    return block_rows or _PLAN_ROWS.get() or BLOCK_ROWS


def block_of(rn: Column, block_rows: int | None = None) -> Column:
    return F.floor(rn / F.lit(_rows(block_rows))).cast("long")


def blocked(df: DataFrame, back: int, fwd: int = 0, block_rows: int | None = None) -> DataFrame:
    """Assign ``_blk`` and add halo copies; input needs ``_rn``.

    Frames of up to ``back`` rows behind and ``fwd`` rows ahead are exact
    inside a block partition. Drop rows with ``_halo`` after windowing.
    """
    block_rows = _rows(block_rows)
    if back >= block_rows or fwd >= block_rows:
        raise ValueError("frame longer than a block")
    rn = F.col(RN)
    blk = block_of(rn, block_rows)
    pos = rn - blk * F.lit(block_rows)
    own = F.struct(blk.alias("b"), F.lit(False).alias("h"))
    nxt = F.when(pos >= F.lit(block_rows - back), F.struct((blk + 1).alias("b"), F.lit(True).alias("h")))
    prv = F.when((pos < F.lit(fwd)) & (blk > 0), F.struct((blk - 1).alias("b"), F.lit(True).alias("h")))
    targets = F.array_compact(F.array(own, nxt, prv)) if (back or fwd) else F.array(own)
    t = df.withColumn("_t", F.explode(targets))
    return t.withColumn(BLK, F.col("_t.b")).withColumn(HALO, F.col("_t.h")).drop("_t")


def series_window(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*_keys(keys), BLK).orderBy(RN)


def with_series_columns(df: DataFrame, keys: Sequence[str],
                        build: Callable[[Window], dict[str, Column]],
                        back: int, fwd: int = 0, order: Sequence[str] = ("ts",),
                        block_rows: int | None = None, numbered: bool = False) -> DataFrame:
    """Add window columns computed by ``build(w)`` with frames ≤ back/fwd rows.

    ``build`` receives the blocked window spec (ordered by ``_rn``) and
    returns named column expressions; may be called in stages by callers
    that need windows over window results (pass ``numbered=True`` then).
    """
    keys = _keys(keys)
    d = df if numbered else number_rows(df, keys, order)
    b = blocked(d, back, fwd, block_rows)
    w = series_window(keys)
    cols = build(w)
    out = b.select("*", *[c.alias(n) for n, c in cols.items()])
    return out.where(~F.col(HALO)).drop(BLK, HALO)


def staged(df: DataFrame, keys: Sequence[str], stages: Sequence[Callable[[Window], dict[str, Column]]],
           back: int, fwd: int = 0, order: Sequence[str] = ("ts",), block_rows: int | None = None,
           numbered: bool = False, keep_rn: bool = False) -> DataFrame:
    """Several window stages, each may use the columns of the one before.

    ``back``/``fwd`` must cover the whole chain (sum of the frame lengths).
    All stages run on the same partitioning and ordering, so Spark sorts
    once and adds no exchange between stages.
    """
    keys = _keys(keys)
    d = df if numbered else number_rows(df, keys, order)
    b = blocked(d, back, fwd, block_rows)
    w = series_window(keys)
    for st in stages:
        cols = st(w)
        b = b.select("*", *[c.alias(n) for n, c in cols.items()])
    out = b.where(~F.col(HALO)).drop(BLK, HALO)
    return out if keep_rn else out.drop(RN)


# ---------------------------------------------------------------- running
_BLOCK_AGG = {
    "sum": lambda c: F.sum(c),
    "product": lambda c: F.product(c),
    "max": lambda c: F.max(c),
    "min": lambda c: F.min(c),
    "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(RN))),
}


def _prefix(kind: str, c: Column, w: Window) -> Column:
    if kind == "sum":
        return F.sum(c).over(w)
    if kind == "product":
        return F.product(c).over(w)
    if kind == "max":
        return F.max(c).over(w)
    if kind == "min":
        return F.min(c).over(w)
    if kind == "last":
        return F.last(c, ignorenulls=True).over(w)
    raise ValueError(kind)


def _combine(kind: str, carry: Column, inner: Column, dt: T.DataType) -> Column:
    if kind == "sum" and isinstance(dt, T.DecimalType):
        # a sum of two DECIMAL(38, s) would lose a digit of the scale
        wide = T.DecimalType(37, dt.scale)
        return F.coalesce(carry.cast(wide), F.lit(0).cast(wide)) + inner.cast(wide)
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + inner
    if kind == "product":
        return F.coalesce(carry, F.lit(1)) * inner
    if kind == "max":
        return F.greatest(carry, inner)
    if kind == "min":
        return F.least(carry, inner)
    if kind == "last":
        return F.coalesce(inner, carry)
    raise ValueError(kind)


def running(df: DataFrame, keys: Sequence[str], specs: dict[str, tuple[str, Column]],
            block_rows: int | None = None) -> DataFrame:
    """Cumulative columns from the start of each series; input needs ``_rn``.

    ``specs``: name -> (kind, expression) with kind in sum, product, max, min,
    last (last non-null value). Equal to ``agg(expr) over (partition by keys
    order by _rn rows between unbounded preceding and current row)``.
    """
    keys = _keys(keys)
    d = df.withColumn(BLK, block_of(F.col(RN), block_rows))
    inner_w = Window.partitionBy(*keys, BLK).orderBy(RN).rowsBetween(Window.unboundedPreceding, 0)
    tmp = {f"_x_{n}": e for n, (_, e) in specs.items()}
    d = d.select("*", *[e.alias(t) for t, e in tmp.items()])
    aggs, post = [], []
    for n, (k, _) in specs.items():
        x = F.col(f"_x_{n}")
        dt = d.schema[f"_x_{n}"].dataType
        if k == "last" and isinstance(dt, T.StructType):
            # A struct value would force a sort-based aggregate: take each field
            # by the same ordering (fixed-width buffers, hash aggregate) and
            # rebuild the struct; a block without any non-NULL value gives NULL.
            o = F.when(x.isNotNull(), F.col(RN))
            aggs.append(F.max(o).alias(f"_bo_{n}"))
            aggs += [F.max_by(x[f.name], o).alias(f"_bf_{n}_{i}") for i, f in enumerate(dt.fields)]
            post.append(F.when(F.col(f"_bo_{n}").isNull(), F.lit(None).cast(dt)).otherwise(
                F.struct(*[F.col(f"_bf_{n}_{i}").alias(f.name) for i, f in enumerate(dt.fields)])).alias(f"_b_{n}"))
        else:
            aggs.append(_BLOCK_AGG[k](x).alias(f"_b_{n}"))
            post.append(F.col(f"_b_{n}"))
    per_block = d.groupBy(*keys, BLK).agg(*aggs).select(*keys, BLK, *post)
    w_blocks = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    carries = per_block.select(*keys, BLK, *[
        _prefix(k, F.col(f"_b_{n}"), w_blocks).alias(f"_c_{n}") for n, (k, _) in specs.items()])
    out = _join_keys(d, carries, [*keys, BLK])
    out = out.select("*", *[
        _combine(k, F.col(f"_c_{n}"), _prefix(k, F.col(f"_x_{n}"), inner_w), d.schema[f"_x_{n}"].dataType).alias(n)
        for n, (k, _) in specs.items()])
    drop = [f"_x_{n}" for n in specs] + [f"_c_{n}" for n in specs] + [BLK]
    return out.drop(*drop)
