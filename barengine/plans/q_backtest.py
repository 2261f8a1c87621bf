"""Registered backtest queries: B1-B10, A5-A14, W10, W11, O1, P7, P11.

The models are a small configuration table of weight vectors over lagged
returns (the reference's linear models carry only ``weights``); the prices
are hour bars of the events table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as BT
from ..operators import leaderboard as LB
from . import sql as S
from .inputs import event_bars
from .output import r6, rnd, rsql
from .registry import register

# Fixed configuration: (model, frequency, weights of lag_0, lag_1, ...).
MODELS = [
    ("momentum_3", "1h", [1.0, 0.5, 0.25]),
    ("reversal_2", "1h", [-1.0, -0.5]),
    ("trend_5", "1h", [0.2, 0.2, 0.2, 0.2, 0.2]),
]
N_LAGS = 5


def models_df(spark):
    return spark.createDataFrame([(m, f, w) for m, f, w in MODELS], "model string, freq string, weights array<double>")


def _bt(spark, sf):
    bars = event_bars(spark, sf).withColumn("freq", F.lit("1h"))
    return BT.backtest(bars, models_df(spark), N_LAGS)


def Fl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


_WVALS = ", ".join("('{}', '{}', {})".format(m, f, ", ".join(Fl(v) for v in (w + [0.0] * (N_LAGS - len(w)))))
                   for m, f, w in MODELS)
_WCOLS = ", ".join(f"w{i}" for i in range(N_LAGS))
_PRED = "0.0" + "".join(f" + l{i} * w{i}" for i in range(N_LAGS))
_PRED = "(" * N_LAGS + "0.0" + "".join(f" + l{i} * w{i})" for i in range(N_LAGS))
_WS = "OVER (PARTITION BY symbol ORDER BY rn)"
_WM = "OVER (PARTITION BY model, symbol ORDER BY rn)"
_RUNM = "OVER (PARTITION BY model, symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_RUNP = "OVER (PARTITION BY model, symbol ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

BT_CTES = f"""
b AS (SELECT *, '1h' AS freq, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM ({S.hour_bars()}) h),
r AS (SELECT *, coalesce(close / nullif(lag(close) {_WS}, 0) - 1, 0) AS ret FROM b),
x AS (SELECT *, {", ".join(["ret AS l0"] + [f"coalesce(lag(ret, {i}) {_WS}, 0) AS l{i}" for i in range(1, N_LAGS)])} FROM r),
m AS (SELECT * FROM (VALUES {_WVALS}) m(model, freq, {_WCOLS})),
s AS (SELECT x.*, m.model, {_PRED} AS pred FROM x JOIN m USING (freq)),
p1 AS (SELECT *, CAST(sign(pred) AS INTEGER) AS signal FROM s),
p2 AS (SELECT *, coalesce(lag(signal) {_WM}, 0) AS pos FROM p1),
p3 AS (SELECT *, pos - coalesce(lag(pos) {_WM}, 0) AS dq FROM p2),
p4 AS (SELECT *, CASE WHEN dq > 0 THEN least(open * {Fl(1 + 0.0005)}, high)
                      WHEN dq < 0 THEN greatest(open * {Fl(1 - 0.0005)}, low) END AS fill FROM p3),
p5 AS (SELECT *, CASE WHEN dq <> 0 THEN abs(dq) * fill * {Fl(0.0004)} ELSE 0.0 END AS commission FROM p4),
p6 AS (SELECT *, CAST(CAST(10000 AS DECIMAL(27,10)) - sum(CAST(CASE WHEN dq <> 0 THEN dq * fill + commission ELSE 0.0 END
                      AS DECIMAL(27,10))) {_RUNM} AS DOUBLE) AS cash FROM p5),
eq AS (SELECT *, cash + pos * close AS equity FROM p6),
per AS (SELECT model, symbol, date_trunc('day', ts) AS period, arg_max(equity, ts) AS equity_end
        FROM eq GROUP BY model, symbol, date_trunc('day', ts)),
pr AS (SELECT *, equity_end / coalesce(lag(equity_end) OVER (PARTITION BY model, symbol ORDER BY period),
        {Fl(10000.0)}) - 1 AS ret FROM per),
pc AS (SELECT *, product(1 + ret) {_RUNP} AS cum FROM pr),
pk AS (SELECT *, max(cum) {_RUNP} AS peak FROM pc),
pd AS (SELECT *, (peak - cum) / peak AS drawdown FROM pk),
risk AS (SELECT model, symbol, count(ret) AS n_periods, product(1 + ret) - 1 AS total_return,
   avg(ret) * 252 AS mean_a, stddev_samp(ret) * sqrt(252) AS std_a,
   stddev_samp(ret) FILTER (WHERE ret < 0) * sqrt(252) AS down_a, max(drawdown) AS max_drawdown
   FROM pd GROUP BY model, symbol),
riskm AS (SELECT model, symbol, n_periods, total_return,
   CASE WHEN isnan(pow(1 + total_return, 252.0 / n_periods)) THEN NULL ELSE pow(1 + total_return, 252.0 / n_periods) - 1 END AS cagr,
   CASE WHEN std_a = 0 THEN 0.0 ELSE mean_a / std_a END AS sharpe,
   CASE WHEN down_a = 0 THEN 0.0 ELSE mean_a / down_a END AS sortino, max_drawdown FROM risk),
ct AS (SELECT model, symbol, CAST(lead(close) {_WM} > close AS INTEGER) AS t, CAST(pred > 0 AS INTEGER) AS p FROM s),
cc AS (SELECT model, symbol, avg(CAST(t = p AS DOUBLE)) AS accuracy,
   sum(CAST(t = 1 AND p = 1 AS BIGINT)) AS tp, sum(CAST(t = 0 AND p = 1 AS BIGINT)) AS fp,
   sum(CAST(t = 1 AND p = 0 AS BIGINT)) AS fn, sum(CAST(t = 0 AND p = 0 AS BIGINT)) AS tn
   FROM ct WHERE t IS NOT NULL GROUP BY model, symbol),
cls AS (SELECT model, symbol, accuracy,
   CASE WHEN tp + fn = 0 THEN tn / (tn + fp) WHEN tn + fp = 0 THEN tp / (tp + fn)
        ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END AS balanced_accuracy,
   CASE WHEN tp * 2 + fp + fn > 0 THEN tp * 2 / (tp * 2 + fp + fn) ELSE 0.0 END AS f1 FROM cc),
mt AS (SELECT riskm.*, cls.accuracy, cls.balanced_accuracy, cls.f1,
   balanced_accuracy * 0.4 + CASE WHEN sharpe IS NULL THEN NULL WHEN sharpe / 3 < 1 THEN sharpe / 3 ELSE 1.0 END * 0.6
   AS final_score FROM riskm JOIN cls USING (model, symbol))"""

_METRICS = ["n_periods", "total_return", "cagr", "sharpe", "sortino", "max_drawdown", "accuracy",
            "balanced_accuracy", "f1", "final_score"]
_DBL = set(_METRICS) - {"n_periods"}


def _msel(cols):
    return ", ".join(r6(c) + f" AS {c}" if c in _DBL else f"CAST({c} AS BIGINT) AS {c}" for c in cols)


# Money columns have up to 10 exact decimals (2-decimal prices x 1.0005 x
# 0.0004): a tie at the 7th decimal is common and float summation order
# then decides the 6th, so they are compared at 4 decimals on both sides.
MONEY = 4


def _m(e: str) -> str:
    return r6(rsql(e, MONEY))


@register("positions_fills", f"""WITH {BT_CTES}
SELECT model, symbol, ts, {r6('pred')} AS pred, CAST(signal AS BIGINT) AS signal, CAST(pos AS BIGINT) AS pos,
  CAST(dq AS BIGINT) AS dq, {_m('fill')} AS fill, {_m('commission')} AS commission, {_m('cash')} AS cash,
  {_m('equity')} AS equity FROM eq""")
def positions_fills(spark, sf):
    """Signal, position, fills, commission, cash and equity per bar and model."""
    t = _bt(spark, sf)["trades"]
    return t.select("model", "symbol", "ts", "pred", "signal", "pos", "dq",
                    *[rnd(F.col(c), MONEY).alias(c) for c in ("fill", "commission", "cash", "equity")])


@register("equity_curve", f"""WITH {BT_CTES}
SELECT model, symbol, period, {_m('equity_end')} AS equity_end, {r6('ret')} AS ret, {r6('cum')} AS cum,
  {r6('drawdown')} AS drawdown FROM pd""")
def equity_curve(spark, sf):
    """Daily equity, return, cumulated return and drawdown."""
    p = _bt(spark, sf)["periods"]
    return p.select("model", "symbol", "period", rnd(F.col("equity_end"), MONEY).alias("equity_end"), "ret", "cum",
                    "drawdown")


@register("risk_metrics", f"""WITH {BT_CTES}
SELECT model, symbol, {_msel(_METRICS[:6])} FROM riskm""")
def risk_metrics(spark, sf):
    """B7 = A9-A13 per model and series."""
    m = _bt(spark, sf)["metrics"]
    return m.select("model", "symbol", *_METRICS[:6])


@register("class_metrics", f"""WITH {BT_CTES}
SELECT model, symbol, {_msel(['accuracy', 'balanced_accuracy', 'f1'])} FROM cls""")
def class_metrics(spark, sf):
    """B8 = A5-A7 per model and series."""
    m = _bt(spark, sf)["metrics"]
    return m.select("model", "symbol", "accuracy", "balanced_accuracy", "f1")


@register("leaderboard", f"""WITH {BT_CTES}
SELECT model, symbol, {_msel(_METRICS)},
  CASE WHEN final_score >= 0.7 THEN 'good' WHEN final_score < 0.6 THEN 'bad' ELSE 'fair' END AS score_band
FROM mt ORDER BY final_score DESC NULLS LAST""")
def leaderboard(spark, sf):
    """A14 + O1 + P11: every metric, the final score, sorted best first."""
    m = _bt(spark, sf)["metrics"]
    return LB.leaderboard(m.select("model", "symbol", *_METRICS).withColumn("score_band", LB.score_band()))


@register("final_score", f"""WITH {BT_CTES}
SELECT model, symbol, {_msel(['final_score'])},
  CAST(final_score >= 0.6 AS BIGINT) AS kept FROM mt""")
def final_score(spark, sf):
    """A14 + P7: final score and whether the model would be kept (>= 0.6)."""
    m = _bt(spark, sf)["metrics"]
    return m.select("model", "symbol", "final_score", (F.col("final_score") >= 0.6).alias("kept"))
