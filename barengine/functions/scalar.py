"""Scalar column functions.

All are built-in Spark expressions (JVM side, inside whole-stage codegen);
none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequency name → download interval code.
INTERVAL_CODES = {"minute": "1m", "hour": "1h", "day": "1d"}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def interval_code(freq: str | Column) -> Column:
    """Minute → 1m, hour → 1h, day → 1d (NULL otherwise)."""
    m = F.create_map(*[F.lit(x) for kv in INTERVAL_CODES.items() for x in kv])
    return m[_c(freq)]


def sign(x: str | Column) -> Column:
    """-1 / 0 / 1 as INT."""
    return F.signum(_c(x)).cast("int")


def threshold_class(x: str | Column, thresh: float) -> Column:
    """1 above +thresh, -1 below -thresh, else 0."""
    c = _c(x)
    return F.when(c > thresh, 1).when(c < -thresh, -1).otherwise(0)


def experiment_name(model: str | Column, freq: str | Column, label: str | Column) -> Column:
    """model_freq_label."""
    return F.concat_ws("_", _c(model), _c(freq), _c(label))


def path_stem(path: str | Column) -> Column:
    """file name without directory and last suffix."""
    name = F.element_at(F.split(_c(path), "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def path_parent(path: str | Column) -> Column:
    """name of the parent folder."""
    return F.element_at(F.split(_c(path), "/"), -2)


def path_has_part(path: str | Column, part: str) -> Column:
    """True when one path component equals ``part``."""
    return F.array_contains(F.split(_c(path), "/"), part)


def replace_suffix(x: str | Column, old: str, new: str = "") -> Column:
    """stem with a suffix removed (e.g. '_equity')."""
    return F.regexp_replace(_c(x), f"{old}$", new)


def age_days(mtime: str | Column, now: str | Column) -> Column:
    """whole and fractional days between a modification time and ``now``."""
    n = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return (F.unix_micros(n) - F.unix_micros(_c(mtime).cast("timestamp"))) / 86_400_000_000.0


def time_chunks(start: str | Column, end: str | Column, days: int = 8) -> Column:
    """[start, end) cut into pieces of at most ``days`` days, as an array
    of struct(chunk_start, chunk_end); empty when start >= end."""
    s, e = _c(start), _c(end)
    step = F.make_dt_interval(F.lit(days))
    starts = F.when(s < e, F.sequence(s, e - F.expr("INTERVAL 1 MICROSECOND"), step)).otherwise(
        F.array().cast("array<timestamp>"))
    return F.transform(starts, lambda x: F.struct(x.alias("chunk_start"), F.least(x + step, e).alias("chunk_end")))


def percent(x: str | Column, digits: int = 2) -> Column:
    """value × 100 as text with fixed decimals and a percent sign."""
    return F.concat(F.format_number(_c(x) * 100, digits), F.lit("%"))


def price_text(x: str | Column) -> Column:
    """price with two decimals."""
    return F.format_number(_c(x), 2)
