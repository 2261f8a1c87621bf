"""Registered dataset and learning queries: M1, M2, A8, A20, M3, M5, M9, M11, W15, O5, M6, M7.

Features are bounded bar-shape values (balance of power, wick ratios) and the
label is label_b1, so the sums behind the Gram matrix stay well inside double
precision at 6 decimals. Queries whose output comes from iterative fitting
(gradient descent, MLlib) have no SQL oracle and get the row-count check.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset as DS
from ..operators import labels as L
from ..operators import learn as LR
from ..operators import price_action as PA
from ..operators import series
from ..operators.indicators.base import safe_div
from . import sql as S
from .output import r6
from .registry import register
from .inputs import event_bars, user_bars

FEATURES = ["f0", "f1", "f2"]
LABEL = "y"
K = len(FEATURES)


def design(spark, sf, mode="per_symbol_time", next_return=False):
    """Hour bars → (symbol, ts, _rn, f0..f2, y, split), with the label R as ``r`` if asked for."""
    b = event_bars(spark, sf)
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))

    def build(w):
        more = {"r": L.label_r(w)} if next_return else {}
        return more | {"f0": safe_div(c - o, h - low), "f1": F.coalesce(PA.wick_ratio_upper(), F.lit(0.0)),
                "f2": F.coalesce(PA.wick_ratio_lower(), F.lit(0.0)), "y": L.label_b1(w)}
    n = series.number_rows(b, ["symbol"], with_length=True)
    d = series.with_series_columns(n, ["symbol"], build, back=0, fwd=1, numbered=True)
    d = d.select("symbol", "ts", series.RN, series.LEN, *FEATURES, LABEL, *(["r"] if next_return else []))
    return DS.train_val_split(d, 0.8, mode).drop(series.LEN)


DESIGN = f"""b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM ({S.hour_bars()}) h),
d0 AS (SELECT symbol, ts, rn,
  CASE WHEN high - low <> 0 THEN (close - open) / (high - low) ELSE 0.0 END AS f0,
  coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0.0) AS f1,
  coalesce((least(open, close) - low) / nullif(high - low, 0), 0.0) AS f2,
  CASE WHEN lead(close) OVER (PARTITION BY symbol ORDER BY rn) > close THEN 1 ELSE 0 END AS y,
  count(*) OVER (PARTITION BY symbol) AS n FROM b),
d AS (SELECT *, CASE WHEN rn < floor(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM d0)"""


@register("train_val_split", f"WITH {DESIGN} SELECT symbol, ts, split FROM d")
def train_val_split(spark, sf):
    """M1 per_symbol_time: first 80 % of each series trains."""
    return design(spark, sf).select("symbol", "ts", "split")


@register("train_val_split_positional", f"""
WITH b AS ({S.hour_bars()}),
p AS (SELECT symbol, ts, row_number() OVER (ORDER BY symbol, ts) - 1 AS pos, count(*) OVER () AS n FROM b)
SELECT symbol, ts, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM p""")
def train_val_split_positional(spark, sf):
    """M1 positional (parity): series concatenated in symbol order, first 80 % overall."""
    b = series.number_rows(event_bars(spark, sf).select("symbol", "ts"), ["symbol"])
    return DS.train_val_split(b, 0.8, "positional").select("symbol", "ts", "split")


@register("ts_folds", f"""
WITH b AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn,
                  count(*) OVER (PARTITION BY symbol) AS n FROM ({S.hour_bars()}) h),
f AS (SELECT *, n // 4 AS tsz, n - 3 * (n // 4) AS st FROM b),
u AS (SELECT symbol, ts, CAST(i AS BIGINT) AS fold,
        CASE WHEN rn < st + i * tsz THEN 'train' WHEN rn < st + (i + 1) * tsz THEN 'test' END AS role
      FROM f, (SELECT unnest(range(3)) AS i) k)
SELECT * FROM u WHERE role IS NOT NULL""")
def ts_folds(spark, sf):
    """M2: three expanding folds per series."""
    bars = event_bars(spark, sf).select("symbol", "ts")
    b = series.number_rows(bars, ["symbol"])
    return DS.time_series_folds(b, 3, counts=DS.series_counts(bars)).select("symbol", "ts", "fold", "role")


def _gram_sql():
    g = [f"{r6(f'sum({FEATURES[i]} * {FEATURES[j]})')} AS g_{i}_{j}" for i in range(K) for j in range(i, K)]
    bb = [f"{r6(f'sum({FEATURES[i]} * y)')} AS b_{i}" for i in range(K)]
    return (f"WITH {DESIGN} SELECT split, count(*) AS n, {', '.join(g + bb)}, {r6('sum(y * y)')} AS yy "
            f"FROM d GROUP BY split")


@register("gram_matrix", _gram_sql())
def gram_matrix(spark, sf):
    """XᵀX, Xᵀy, yᵀy and n per split in one aggregation."""
    return LR.gram_stats(design(spark, sf).withColumn("y", F.col("y").cast("double")), FEATURES, LABEL, ["split"])


# Fixed configuration: linear models over the shape features.
SHAPE_MODELS = [("shape_a", [0.5, -0.25, 0.25]), ("shape_b", [1.0, 0.0, -1.0])]
_SM = " UNION ALL ".join(
    f"SELECT '{m}' AS model, {w[0]!r} AS w0, {w[1]!r} AS w1, {w[2]!r} AS w2" for m, w in SHAPE_MODELS)


@register("mse_by_symbol", f"""
WITH {DESIGN}, m AS ({_SM})
SELECT model, symbol, {r6('avg(pow(y - (((0.0 + f0 * w0) + f1 * w1) + f2 * w2), 2))')} AS mse, count(*) AS n
FROM d, m WHERE split = 'val' GROUP BY model, symbol""")
def mse_by_symbol(spark, sf):
    """Validation MSE of fixed linear models per series."""
    d = design(spark, sf).where(F.col("split") == "val")
    # One prediction per configured model on the same row, then one explode:
    # no join, the rows are read once.
    preds = F.array(*[F.struct(F.lit(n).alias("model"), LR.predict(FEATURES, w).alias("pred"))
                      for n, w in SHAPE_MODELS])
    e = d.select("symbol", "y", F.explode(preds).alias("m"))
    return e.groupBy(F.col("m.model").alias("model"), "symbol").agg(
        LR.mse(F.col("y").cast("double"), F.col("m.pred")).alias("mse"), F.count(F.lit(1)).alias("n"))


N_WIDE = 64


def _wide(spark, sf):
    """64 lagged returns of user-level hour bars and the next return, clipped to [-1, 1], per split."""
    bars = user_bars(spark, sf).where(F.length("symbol") == 2)
    n = series.number_rows(bars.select("symbol", "ts", "close"), ["symbol"], with_length=True)
    ret = lambda w: {"_c": F.lag("close").over(w), "_d": F.lead("close").over(w)}

    def clip(x):
        return F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))

    def change(w):
        return {"_r": F.coalesce(clip(F.col("close") / F.nullif(F.col("_c"), F.lit(0.0)) - 1), F.lit(0.0)),
                "y": F.coalesce(clip(F.col("_d") / F.nullif(F.col("close"), F.lit(0.0)) - 1), F.lit(0.0))}
    d = series.staged(n, ["symbol"], [ret, change, lambda w: {
        f"x{i}": F.coalesce(F.lag("_r", i).over(w), F.lit(0.0)) if i else F.col("_r") for i in range(N_WIDE)}],
        back=N_WIDE, fwd=1, numbered=True, keep_rn=True)
    return DS.train_val_split(d, 0.8)


@register("gram_matrix_wide", f"""
WITH b AS (SELECT symbol, ts, close, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n,
    coalesce(greatest(least(close / nullif(lag(close) OVER w, 0) - 1, 1.0), -1.0), 0.0) AS r,
    coalesce(greatest(least(lead(close) OVER w / nullif(close, 0) - 1, 1.0), -1.0), 0.0) AS y
  FROM ({S.bars('1 hour', S.TICKS_USERS)}) h WHERE length(symbol) = 2 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
l AS (SELECT *, list(r) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {N_WIDE - 1} PRECEDING AND CURRENT ROW) AS x FROM b),
z AS (SELECT CASE WHEN rn < floor(n * 0.8) THEN 'train' ELSE 'val' END AS split, list_concat(
    list_transform(range({N_WIDE}), lambda i: CASE WHEN i <= rn THEN x[len(x) - i] ELSE 0.0 END), [y, 1.0]) AS z FROM l)
SELECT split, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {r6('sum(z[i + 1] * z[j + 1])')} AS v
FROM z, range({N_WIDE + 2}) a(i), range({N_WIDE + 2}) c(j) WHERE i <= j GROUP BY ALL""")
def gram_matrix_wide(spark, sf):
    """A20 for 64 features: the cells of [X, y, 1]ᵀ[X, y, 1] per split."""
    return LR.gram_cells(_wide(spark, sf), [f"x{i}" for i in range(N_WIDE)], "y", ["split"])


# Fixed configuration: trials of the cross-validated study.
TRIALS = [{"lr": 0.05, "epochs": 20}, {"lr": 0.2, "epochs": 40}, {"lr": 0.5, "epochs": 60}, {"lr": 0.5, "epochs": 5}]
_SUMS = ", ".join([f"sum(f{i} * f{j}) AS g{i}{j}" for i in range(K) for j in range(i, K)] +
                  [f"sum(f{i} * y) AS b{i}" for i in range(K)] + ["sum(y * y) AS yy", "count(*) AS n"])


def _cell(i, j):
    return f"g{min(i, j)}{max(i, j)}"


def _gd_sql(stats: str, runs: str, by: list[str]) -> str:
    """Recursive CTE gd(run columns, e, w0..w2): gradient descent from the sums in ``stats``; runs has lr, epochs, scale."""
    step = ", ".join(f"w{i} - lr * scale * (" + " + ".join(f"{_cell(i, j)} * w{j}" for j in range(K)) + f" - b{i}) / n"
                     for i in range(K))
    keys = ", ".join(f"t.{c}" for c in by)
    return f"""t AS (SELECT * FROM {runs}, {stats}), gd AS (
  SELECT {keys}, 0 AS e, {', '.join(f'CAST(0 AS DOUBLE) AS w{i}' for i in range(K))} FROM t
  UNION ALL SELECT {keys}, e + 1, {step} FROM gd JOIN t ON {' AND '.join(f't.{c} = gd.{c}' for c in by)} WHERE e < epochs)"""


_FOLDS = f"""{DESIGN},
sl AS (SELECT *, n - 3 * (n // 4) AS st, n // 4 AS tsz FROM d),
s1 AS (SELECT * EXCLUDE (n), CASE WHEN rn < st THEN 0 ELSE 1 + (rn - st) // nullif(tsz, 0) END AS slice FROM sl),
st AS (SELECT slice, {_SUMS} FROM s1 GROUP BY slice),
tr AS (SELECT f.fold, {', '.join(f'sum({c}) AS {c}' for c in [_cell(i, j) for i in range(K) for j in range(i, K)] + [f'b{i}' for i in range(K)] + ['n'])}
  FROM st, range(3) f(fold) WHERE slice <= fold GROUP BY f.fold),
runs AS (SELECT * FROM (VALUES {', '.join(f"({t}, CAST({p['lr']!r} AS DOUBLE), {p['epochs']}, 1.0)" for t, p in enumerate(TRIALS))}) v(trial, lr, epochs, scale)),
{_gd_sql('tr', 'runs', ['trial', 'fold'])},
m AS (SELECT trial, fold, lr, epochs, tr.n AS n_train, te.n AS n_test, ({' + '.join(f'w{i} * w{j} * te.{_cell(i, j)}' for i in range(K) for j in range(K))}
    - 2 * ({' + '.join(f'w{i} * te.b{i}' for i in range(K))}) + te.yy) / te.n AS mse
  FROM gd JOIN runs USING (trial) JOIN tr USING (fold) JOIN st te ON te.slice = fold + 1 WHERE e = epochs)"""


def _folded(spark, sf):
    return LR.cross_validate(spark, design(spark, sf).withColumn("y", F.col("y").cast("double")), FEATURES, LABEL, TRIALS)


@register("cv_fold_metrics", f"""
WITH RECURSIVE {_FOLDS} SELECT CAST(trial AS BIGINT) AS trial, CAST(fold AS BIGINT) AS fold, {r6('lr')} AS lr, CAST(epochs AS BIGINT) AS epochs,
  CAST(n_train AS BIGINT) AS n_train, CAST(n_test AS BIGINT) AS n_test, {r6('mse')} AS mse FROM m""")
def cv_fold_metrics(spark, sf):
    """M9 + M2: mse of four trials on three expanding folds, all from one pass."""
    return _folded(spark, sf)


@register("cv_trial_means", f"WITH RECURSIVE {_FOLDS} SELECT CAST(trial AS BIGINT) AS trial, {r6('avg(mse)')} AS mse FROM m GROUP BY trial")
def cv_trial_means(spark, sf):
    """Mean of the fold metrics per trial."""
    return LR.cv_mean(_folded(spark, sf))


@register("linear_gd_weights", f"""
WITH RECURSIVE {DESIGN}, st AS (SELECT {_SUMS} FROM d WHERE split = 'train'),
runs AS (SELECT 'linear_gd' AS model, CAST(0.1 AS DOUBLE) AS lr, 50 AS epochs, 1.0 AS scale
  UNION ALL SELECT 'linear_gd_torch', 0.1, 50, 2.0), {_gd_sql('st', 'runs', ['model'])}
SELECT model, CAST(i AS BIGINT) AS i, {r6('CASE i WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END')} AS weight
FROM gd, range(3) a(i) WHERE e = 50""")
def linear_gd_weights(spark, sf):
    """M3 + M4: gradient descent (lr 0.1, 50 epochs) from the Gram matrix of the training split."""
    d = design(spark, sf).where(F.col("split") == "train").withColumn("y", F.col("y").cast("double"))
    rows = []
    for name, scale in (("linear_gd", 1.0), ("linear_gd_torch", 2.0)):
        w = LR.linear_gd(d, FEATURES, LABEL, lr=0.1, epochs=50, grad_scale=scale)
        rows += [(name, i, float(v)) for i, v in enumerate(w)]
    return spark.createDataFrame(rows, "model string, i int, weight double")


@register("linear_predict", f"""
WITH RECURSIVE {DESIGN}, st AS (SELECT {_SUMS} FROM d WHERE split = 'train'),
runs AS (SELECT 'linear_gd' AS model, CAST(0.1 AS DOUBLE) AS lr, 50 AS epochs, 1.0 AS scale), {_gd_sql('st', 'runs', ['model'])}
SELECT symbol, ts, {r6('0.0 + f0 * w0 + f1 * w1 + f2 * w2')} AS pred FROM d, gd WHERE split = 'val' AND e = 50""")
def linear_predict(spark, sf):
    """Fitted weights applied to the validation rows."""
    d = design(spark, sf)
    w = LR.linear_gd(d.where(F.col("split") == "train").withColumn("y", F.col("y").cast("double")),
                     FEATURES, LABEL, lr=0.1, epochs=50)
    return d.where(F.col("split") == "val").select("symbol", "ts", LR.predict(FEATURES, w).alias("pred"))


# Fixed configuration: the search space of the linear model.
SPACE = {"lr": [0.001, 0.5], "epochs": [5, 100]}


def _search(spark, sf):
    d = design(spark, sf).withColumn("y", F.col("y").cast("double"))
    return LR.random_search(spark, d, FEATURES, LABEL, SPACE, n_trials=20, seed=7, experiment="linear_gd_hour_B1")


@register("random_search_runs")
def random_search_runs(spark, sf):
    """M9: 20 sampled (lr, epochs) trials, validation MSE of each."""
    runs, _ = _search(spark, sf)
    return runs.select("experiment", "trial", F.to_json("params").alias("params"), "mse")


@register("top_runs")
def top_runs(spark, sf):
    """The five best runs per experiment."""
    runs, _ = _search(spark, sf)
    return LR.top_runs(runs, 5).select("experiment", "trial", "mse", "rank")


@register("best_trial_refit")
def best_trial_refit(spark, sf):
    """O5 + M11: best trial and the weights refitted on train + validation."""
    from ..operators.leaderboard import best_trial
    runs, w = _search(spark, sf)
    bt = best_trial(runs).select("experiment", "trial", F.to_json("params").alias("params"), "mse")
    return bt.withColumn("weights", F.array(*[F.lit(float(v)) for v in w])).select(
        "experiment", "trial", "params", "mse", F.posexplode("weights").alias("i", "weight"))


@register("mllib_linear")
def mllib_linear(spark, sf):
    """M6: MLlib LinearRegression on the shape features (coefficients + intercept)."""
    d = design(spark, sf).where(F.col("split") == "train").withColumn("y", F.col("y").cast("double"))
    m = LR.fit_linear_regression(d, FEATURES, LABEL)
    rows = [(f, float(v)) for f, v in zip(FEATURES, m.coefficients.toArray())] + [("intercept", float(m.intercept))]
    return spark.createDataFrame(rows, "term string, value double")


@register("gbt_importances")
def gbt_importances(spark, sf):
    """M7 + S12: boosted trees (10 rounds, depth 3) and their feature importances."""
    d = design(spark, sf).where(F.col("split") == "train").withColumn("y", F.col("y").cast("double"))
    m = LR.fit_gbt(d, FEATURES, LABEL, maxIter=10, maxDepth=3, seed=1)
    return LR.importances(spark, m, FEATURES)


@register("train_all_runs")
def train_all_runs(spark, sf):
    """M10 + J8: every allowed combination with a trainable linear model
    (n_linear on R for hour bars here), 10 trials each; runs table."""
    d = design(spark, sf, next_return=True).withColumn("y", F.col("y").cast("double"))
    runs, models = LR.train_all(spark, {"hour": d}, FEATURES, {"R": "r", "B1": "y"},
                                {"n_linear": {"lr": [0.001, 0.5], "epochs": [5, 50]}}, n_trials=10, seed=3)
    return runs.select("experiment", "trial", "mse")
