import math
from datetime import datetime, timedelta

from pyspark.sql import functions as F


def bars_df(spark, closes, symbol="A", start="2021-01-01", step_days=1, opens=None, highs=None, lows=None,
            volumes=None):
    t0 = datetime.fromisoformat(start)
    rows = []
    for i, c in enumerate(closes):
        o = opens[i] if opens else c
        h = highs[i] if highs else (max(o, c) if c is not None and o is not None else c)
        lo = lows[i] if lows else (min(o, c) if c is not None and o is not None else c)
        v = volumes[i] if volumes else 1.0
        rows.append((symbol, t0 + timedelta(days=i * step_days), o, h, lo, c, v))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, "
                                     "close double, volume double")
    return df


def col_list(df, name, order="ts"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)
