"""Output normalisation shared by registered queries and their SQL oracles.

Doubles are rounded to 6 decimals with -0.0 cleared, integers widened to
BIGINT, timestamps returned without zone (the Parquet inputs are naive).

Rounding is ``round(x * 10^d) / 10^d`` on both engines: plain IEEE
arithmetic, so equal doubles give equal results. (Spark's ``round(x, d)``
rounds the shortest decimal form of x, DuckDB's the binary value; they
disagree on ties such as 48.1 * 1.0005.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def finalize(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = rnd(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("long")
        elif isinstance(t, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(t, T.BooleanType):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def rnd(c, digits: int = DIGITS):
    """Round half away from zero at ``digits`` decimals, binary rule."""
    k = float(10 ** digits)
    return F.round(c * F.lit(k), 0) / F.lit(k)


def rsql(expr: str, digits: int = DIGITS) -> str:
    """SQL twin of ``rnd``."""
    return f"(round(CAST({expr} AS DOUBLE) * {float(10 ** digits)!r}, 0) / {float(10 ** digits)!r})"


def r6(expr: str) -> str:
    """SQL side of ``finalize`` for one double expression."""
    return f"({rsql(expr)} + 0.0)"
