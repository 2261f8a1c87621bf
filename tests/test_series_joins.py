"""Gaps in scans, as-of joins, wide Gram matrices and folds against plain Python, at several block sizes."""
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barengine.operators import asof, dataset, learn, scan, series

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("block", [1, 3, 16, 1000])
def test_scan_carries_the_state_over_gaps(spark, block):
    """NULL in a or b: no output there, the next row goes on; resets, zero and negative factors, NULL keys."""
    r = random.Random(block)
    rows, want = [], {}
    for sym in ("A", None, "C"):
        y = 0.0
        for i in range(150):
            a, b = r.choice([0.5, 0.9, 0.0, 1.0, -0.3, None]), r.choice([1.0, 2.5, -4.0, None])
            rows.append((sym, i, a, b))
            if a is not None and b is not None:
                y = a * y + b
            want[(sym, i)] = None if a is None or b is None else y
    df = spark.createDataFrame(rows, "symbol string, _rn long, a double, b double").repartition(3)
    out = scan.affine_scan(df, ["symbol"], {"y": (F.col("a"), F.col("b")), "z": (F.lit(0.5), F.col("b"))}, block_rows=block)
    got = {(x.symbol, x._rn): x.y for x in out.collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (v is None) and (v is None or math.isclose(got[k], v, abs_tol=1e-9)) for k, v in want.items())


def test_ema_of_a_constant_stays_constant_after_a_gap(spark):
    from barengine.operators.indicators import suite
    rows = [("A", T0 + timedelta(hours=i), 100.0, 100.0, 100.0, None if i in (40, 55) else 100.0, 1.0) for i in range(80)]
    b = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    got = {r.ts: r.ema for r in suite.add_indicators(b, ["ema"]).collect()}
    assert [got[T0 + timedelta(hours=i)] for i in (39, 40, 41, 55, 79)] == pytest.approx([100.0, None, 100.0, None, 100.0])


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_asof_against_plain_search(spark, block):
    """Hot, NULL and one-sided keys, equal times, ties on the right, NULL values and times."""
    r = random.Random(11)
    key = lambda: r.choice(["hot", "hot", "hot", "b", None])
    left = [(i, key() if i % 9 else "left", None if i % 31 == 30 else T0 + timedelta(minutes=r.randrange(300))) for i in range(200)]
    right = [(key() if i % 9 else "right", None if i % 41 == 40 else T0 + timedelta(minutes=r.randrange(300)), i,
              None if i % 7 == 0 else float(i)) for i in range(200)]
    L = spark.createDataFrame(left, "id int, k string, ts timestamp").repartition(3)
    R = spark.createDataFrame(right, "k string, ts timestamp, seq int, v double").repartition(3)
    got = {x.id: (x.r_v, x.r_seq, x.r_ts) for x in
           asof.asof_join(L, R, by=["k"], values=("v", "seq"), prefix="r_", order=("seq",), block_rows=block).collect()}
    for i, k, ts in left:
        best = max(((t, s, v) for kk, t, s, v in right if kk == k and t is not None and ts is not None and t <= ts),
                   key=lambda x: x[:2], default=None)
        assert got[i] == ((best[2], best[1], best[0]) if best else (None, None, None))


def test_asof_blocks_bound_the_rows_of_a_task(spark):
    """No array of right rows in the plan; a key with all rows lies in many blocks."""
    L = spark.range(100).select(F.lit("hot").alias("k"), F.timestamp_seconds("id").alias("ts"))
    R = L.withColumn("close", F.lit(1.0))
    plan = asof.asof_join(L, R, by=["k"], block_rows=10)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and series.BLK in plan


def test_gram_cells_of_many_features_and_groups(spark):
    """Cells equal XᵀX over complete rows; NULL and NaN rows are left out; the plan does not grow with the features."""
    rng = np.random.default_rng(3)
    k = 70
    x = rng.standard_normal((300, k + 1))
    rows = [[float(v) for v in row] for row in x]
    rows[5][3], rows[6][k], rows[7][0] = None, None, float("nan")
    names = [f"x{i}" for i in range(k)] + ["y"]
    split = ["train" if i % 3 else None for i in range(300)]
    df = spark.createDataFrame([(s, *r) for s, r in zip(split, rows)], "split string, " + ", ".join(f"{n} double" for n in names)).repartition(4)
    cells = learn.gram_cells(df, names[:-1], "y", ["split"])
    assert len(cells._jdf.queryExecution().analyzed().toString()) < 20_000
    ok = [i for i in range(300) if i not in (5, 6, 7)]
    got = cells.collect()
    for s in ("train", None):
        z = np.column_stack([x, np.ones(300)])[[i for i in ok if split[i] == s]]
        m = z.T @ z
        G, b, yy, n = learn.stats_from_cells([c for c in got if c["split"] == s], k)
        assert n == len(z) and np.allclose(G, m[:k, :k]) and np.allclose(b, m[:k, k]) and np.isclose(yy, m[k, k])
    none = learn.stats_from_cells(learn.gram_cells(df.limit(0), names[:-1], "y").collect(), k)
    assert none[3] == 0 and not none[0].any()


def test_cross_validation_equals_fits_on_the_folds(spark):
    """Prefix sums of slices give the same mse as fitting on each fold's rows; slices agree with the fold table."""
    rng = np.random.default_rng(5)
    rows = [(s, i, float(a), float(b), float(0.3 * a - b + c)) for s, n in (("A", 41), ("B", 23), ("C", 2))
            for i, (a, b, c) in enumerate(rng.standard_normal((n, 3)))]
    df = spark.createDataFrame(rows, "symbol string, _rn long, f0 double, f1 double, y double")
    trials = [{"lr": 0.1, "epochs": 30}, {"lr": 0.4, "epochs": 5}]
    got = {(r.trial, r.fold): r for r in learn.cross_validate(spark, df, ["f0", "f1"], "y", trials).collect()}
    folds = dataset.time_series_folds(df, 3)
    for i in range(3):
        part = {role: np.array([(r.f0, r.f1, r.y) for r in folds.where((F.col("fold") == i) & (F.col("role") == role)).collect()])
                for role in ("train", "test")}
        for t, p in enumerate(trials):
            w = np.zeros(2)
            X, y = part["train"][:, :2], part["train"][:, 2]
            for _ in range(p["epochs"]):
                w = w - p["lr"] * X.T @ (X @ w - y) / len(y)
            r = got[(t, i)]
            assert (r.n_train, r.n_test) == (len(y), len(part["test"]))
            assert np.isclose(r.mse, np.mean((part["test"][:, :2] @ w - part["test"][:, 2]) ** 2))
    runs, best = learn.cross_validated_search(spark, df, ["f0", "f1"], "y", {"lr": [0.01, 0.5], "epochs": [1, 60]}, n_trials=8, seed=2)
    top = runs.orderBy("mse").first()
    assert runs.count() == 8 and learn.expand_search_space(spark, {"lr": [0.01, 0.5], "epochs": [1, 60]}, 8, 2)[top.trial] == best
