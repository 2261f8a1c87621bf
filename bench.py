"""

Runs each query on $BENCH_SF_DIR (default /root/testdata/sf0.1) with
local[$BENCH_CPUS]: one warm-up, then the median of $BENCH_REPEAT runs, each
written to the ``noop`` sink (the whole plan runs, nothing is collected).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from barengine.operators import labels as L  # noqa: E402
from barengine.operators import price_action as PA  # noqa: E402
from barengine.operators import series  # noqa: E402
from barengine.operators.indicators import rolling, suite  # noqa: E402
from barengine.plans import queries  # noqa: E402
from barengine.plans.inputs import event_bars  # noqa: E402
from barengine.session import get_spark  # noqa: E402


def price_action_labels(spark, sf):
    """One sort: wick features, returns and the three labels per bar."""
    bars = event_bars(spark, sf)

    def build(w):
        cols = dict(PA.price_action_columns())
        cols.update(label_b1=L.label_b1(w), label_t3=L.label_t3(w), label_r=L.label_r(w),
                    ret=L.simple_return(w))
        return cols
    return series.with_series_columns(bars, ["symbol"], build, back=1, fwd=1)


def indicator_suite_finite(spark, sf):
    """Every finite-frame indicator (I1-I8) in one blocked window pass."""
    bars = event_bars(spark, sf)
    return suite.add_indicators(bars, [i.name for i in rolling.ALL] + ["avgprice", "typprice", "bop"])


def rsi_macd_atr(spark, sf):
    return suite.add_indicators(event_bars(spark, sf), ["rsi", "macd", "atr"])


def headline():
    q = queries()
    out = {
        "bars_5m": q["bars_5m"],
        "price_action_labels": price_action_labels,
        "asof_spread": q["asof_spread"],
        "embedding_64": q["embedding_64"],
        "indicator_suite_finite": indicator_suite_finite,
        "rsi_macd_atr": rsi_macd_atr,
        "risk_metrics": q["risk_metrics"],
    }
    for name in ("gram_matrix", "stream_bars_5m"):
        if name in q:
            out[name] = q[name]
    return out


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [a for a in sys.argv[1:]]
    spark = get_spark(f"local[{cpus}]", partitions=cpus)
    times = {}
    for name, fn in headline().items():
        if only and name not in only:
            continue
        runs = []
        for i in range(repeat + 1):
            t0 = time.perf_counter()
            fn(spark, sf).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i:
                runs.append(dt)
        times[name] = round(statistics.median(runs), 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    sf_name = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf_name) if sf_name.replace(".", "").isdigit() else sf,
                      "cpus": cpus, "repeat": repeat}))


if __name__ == "__main__":
    main()
