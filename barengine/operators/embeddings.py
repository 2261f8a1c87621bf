"""Rolling window embeddings.

The last L returns as an array, centred by their mean and divided by their
population standard deviation (1 when that is 0 or missing); rows with fewer
than L returns get L missing values. The frame is bounded (L rows), so it runs
on the blocked layout with an L-1 row halo.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def missing_array(n: int) -> Column:
    """array of n NULL doubles."""
    return F.array_repeat(F.lit(None).cast("double"), n)


def standardize(arr: Column, mean: Column, sd: Column) -> Column:
    """(x - mean) / sd over an array, sd 0 or missing → 1."""
    s = F.when(sd.isNull() | F.isnan(sd) | (sd == 0), F.lit(1.0)).otherwise(sd)
    return F.transform(arr, lambda x: (x - mean) / s)


def window_embedding(col: str, length: int, w: Window) -> Column:
    """W8 over window spec ``w`` (ordered by series position)."""
    fr = w.rowsBetween(-(length - 1), 0)
    arr = F.collect_list(col).over(fr)
    mean = F.avg(col).over(fr)
    sd = F.stddev_pop(col).over(fr)
    return F.when(F.size(arr) < length, missing_array(length)).otherwise(standardize(arr, mean, sd))
