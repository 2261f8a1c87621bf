"""Registered queries of the load step, the feature table and the model store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import backtest as BT, calendar, dataset as DS, feature_table as FT, learn as LR, model_store as MS
from ..operators import labels as L, series
from ..sources import files as FS, landing
from . import q_backtest as QB
from . import sql as S
from .inputs import event_bars
from .output import r6
from .q_features import _embedding_sql
from .q_io import _METRIC_COLS, _scratch
from .q_learn import _cell
from .registry import ORACLES, register

# ------------------------------------------------------------ S6
BY_FOLDER = r"/symbol=([^/]+)/"
OTHER_ORDER = ("purchase", "view")  # symbols whose files have another column order
BAD_HOUR = 13  # bars of this hour are landed with a close that is no number


def _landed(spark, sf):
    """Hour bars written as CSV files of two layouts, with unreadable records, and landed again."""
    path = _scratch(spark, "landing")
    b = event_bars(spark, sf)
    text = F.when(F.hour("ts") == BAD_HOUR, F.lit("n/a")).otherwise(F.col("close").cast("string"))
    one = b.where(~F.col("symbol").isin(*OTHER_ORDER)).select(
        "symbol", F.col("ts").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"),
        F.col("low").alias("Low"), text.alias("Close"), F.col("close").alias("Adj Close"), F.col("volume").alias("Volume"))
    two = b.where(F.col("symbol").isin(*OTHER_ORDER)).select(
        "symbol", "volume", text.alias("close"), F.col("symbol").alias("venue"), "low", "high", "open", "ts")
    for name, d in (("one", one), ("two", two)):
        d.write.option("header", True).partitionBy("symbol").csv(f"{path}/{name}")
    return landing.land_market_files(spark, path, symbol=BY_FOLDER)


@register("landed_bars", f"SELECT {S.rounded_bars_select()} FROM ({S.hour_bars()}) b WHERE hour(ts) <> {BAD_HOUR}")
def landed_bars(spark, sf):
    """The readable records of files with two column orders."""
    return _landed(spark, sf)[0].select("symbol", "ts", "open", "high", "low", "close", "volume")


@register("landed_quarantine", f"""
SELECT symbol, 'number' AS reason, count(*) AS records FROM ({S.hour_bars()}) b WHERE hour(ts) = {BAD_HOUR} GROUP BY symbol""")
def landed_quarantine(spark, sf):
    """The records kept beside the bars, per symbol and reason."""
    return _landed(spark, sf)[1].groupBy("symbol", "reason").agg(F.count(F.lit(1)).alias("records"))


# ------------------------------------------------------------ J1 + S5
NAMES = ["sma", "roc", "atr", "ema", "rsi", "obv"]
BUCKETS = 16
EMB = 32


def _tables(spark, sf):
    """The feature table and the label table, written in buckets and joined."""
    bars = event_bars(spark, sf)
    exo = event_bars(spark, sf, "5 minutes").where(F.col("symbol") == "purchase").select("ts", "close")
    feats = FT.compute_features(bars, exo, calendar.rule_calendar(bars), NAMES, (EMB,))
    made = []
    for name, d in (("features", feats), ("labels", FT.label_table(bars))):
        table = f"{name}_{uuid.uuid4().hex}"
        made.append(FT.write_feature_table(d, table, _scratch(spark, name), BUCKETS))
    return FT.join_features(*made)


_FEATS = ["sma", "roc", "atr", "ema", "rsi", "obv", "wick_upper", "wick_lower", "wick_ratio_upper", "wick_ratio_lower",
          "weekday", "month_end", "holiday_flag", "exo_spread"]
_FROM = {"sma": "sma", "roc": "roc", "atr": "atr", "ema": "ema", "rsi": "rsi", "obv": "obv", "price_action": "pa",
         "holiday_flag": "hf", "asof_spread": "exo", "label_b1": "lb", "label_t3": "lt", "label_r": "lr"}


def _select(q: str) -> str:
    return f"SELECT * FROM ({ORACLES[q]}) _{q}"


@register("feature_table", f"""
WITH h AS ({S.hour_bars()}), em AS (SELECT symbol, ts, list(value ORDER BY pos) AS e FROM ({ORACLES['embedding_32']}) x GROUP BY symbol, ts)
SELECT h.symbol, h.ts, {', '.join(
    'CAST(isodow(h.ts) - 1 AS BIGINT) AS weekday' if c == 'weekday' else
    'CAST(CASE WHEN CAST(h.ts AS DATE) = last_day(h.ts) THEN 1 ELSE 0 END AS BIGINT) AS month_end' if c == 'month_end' else c
    for c in _FEATS)}, label_b1, label_t3, label_r, {', '.join(f'e[{i + 1}] AS emb_{EMB}_{i}' for i in range(EMB))}
FROM h JOIN em ON em.symbol = h.symbol AND em.ts = h.ts
{' '.join(f'JOIN ({_select(q)}) {a} ON {a}.symbol = h.symbol AND {a}.ts = h.ts' for q, a in _FROM.items())}""")
def feature_table(spark, sf):
    """J1 + S5 + P1 + P10: features computed, written, read, joined with labels without a shuffle, selected, flattened."""
    d = _tables(spark, sf)
    d = DS.flatten_arrays(d, f"emb_{EMB}", EMB)
    labels = ("label_b1", "label_t3", "label_r")
    return d.select("symbol", "ts", *DS.select_features(d, labels), *labels)


_EMB_CTES = _embedding_sql(EMB).rsplit("SELECT symbol, ts, CAST(generate_subscripts", 1)[0]


@register("feature_gram", f"""{_EMB_CTES},
z AS (SELECT list_concat(emb, [label_t3, 1.0]) AS z FROM v JOIN ({ORACLES['label_t3']}) l USING (symbol, ts) WHERE emb[1] IS NOT NULL)
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {r6('sum(z[i + 1] * z[j + 1])')} AS v
FROM z, range({EMB + 2}) a(i), range({EMB + 2}) c(j) WHERE i <= j GROUP BY ALL""")
def feature_gram(spark, sf):
    """A20 on the feature table: the cells of the flattened embedding and the label T3, complete rows only."""
    d = DS.flatten_arrays(_tables(spark, sf), f"emb_{EMB}", EMB)
    x = [c for c in DS.select_features(d) if c.startswith(f"emb_{EMB}_")]
    return LR.gram_cells(d, x, "label_t3")


# ------------------------------------------------------------ S16 + S17 + B10
K = QB.N_LAGS
KEEP = 0.6
EPOCHS = {"fitted_20": 20, "fitted_200": 200}
_BASE, _REST = QB.BT_CTES.split("m AS (SELECT", 1)
_REST = _REST.split("),\ns AS", 1)[1]
_LSUMS = ", ".join([f"sum(l{i} * l{j}) AS g{i}{j}" for i in range(K) for j in range(i, K)] +
                   [f"sum(l{i} * y) AS b{i}" for i in range(K)] + ["count(*) AS n"])
_STEP = ", ".join(f"w{i} - n / ({' + '.join(f'g{a}{a}' for a in range(K))}) * (" +
                  " + ".join(f"{_cell(i, j)} * w{j}" for j in range(K)) + f" - b{i}) / n AS w{i}" for i in range(K))
_W = ", ".join(f"w{i}" for i in range(K))


@register("model_store_loop", f"""
WITH RECURSIVE {_BASE}
yx AS (SELECT *, CASE WHEN nx / nullif(close, 0) - 1 > 0.002 THEN 1 WHEN nx / nullif(close, 0) - 1 < -0.002 THEN -1 ELSE 0 END AS y
  FROM (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY rn) AS nx FROM x) q),
st AS (SELECT {_LSUMS} FROM yx),
gd AS (SELECT 0 AS e, {', '.join(f'CAST(0 AS DOUBLE) AS w{i}' for i in range(K))}
  UNION ALL SELECT e + 1, {_STEP} FROM gd, st WHERE e < {max(EPOCHS.values())}),
m AS (SELECT model, freq, {_W}, 1 AS version FROM (VALUES {QB._WVALS}) m(model, freq, {QB._WCOLS})
  UNION ALL SELECT CASE e {' '.join(f"WHEN {e} THEN '{n}'" for n, e in EPOCHS.items())} END, '1h', {_W}, 2 FROM gd
  WHERE e IN ({', '.join(map(str, EPOCHS.values()))})),
s AS{_REST}
SELECT model, symbol, CAST(version AS BIGINT) AS version, {QB._msel([*_METRIC_COLS, 'final_score'])},
  CAST(CASE WHEN final_score >= {KEEP} THEN 1 ELSE 0 END AS BIGINT) AS best,
  CASE WHEN final_score >= {KEEP} THEN (SELECT {r6('max(cum)')} FROM pd WHERE pd.model = mt.model AND pd.symbol = mt.symbol) END AS best_peak
FROM mt JOIN (SELECT DISTINCT model, version FROM m) v USING (model)""")
def model_store_loop(spark, sf):
    """Fit, save (two versions), discover, score, promote; metrics of all, and what the best folder holds."""
    root = _scratch(spark, "store")
    bars = event_bars(spark, sf).withColumn("freq", F.lit("1h"))
    MS.save_models(QB.models_df(spark).withColumn("label", F.lit("R")), root)
    x = BT.lag_features(bars, K).select("*", *[F.col("x")[i].alias(f"l{i}") for i in range(K)])
    d = series.with_series_columns(x, ["symbol"], lambda w: {"y": L.label_t3(w)}, back=0, fwd=1, numbered=True)
    G, b, _, n = LR.stats_from_cells(LR.gram_cells(d, [f"l{i}" for i in range(K)], "y").collect(), K)
    lr = n / G.trace() if G.trace() else 0.0  # below 2 / the largest eigenvalue, so the descent converges
    MS.save_models(LR.weights_table(spark, [(m, "1h", "T3", LR.gd_from_gram(G, b, n, lr, e)) for m, e in EPOCHS.items()]), root)
    models = MS.discover_models(spark, root)
    bt = BT.backtest(bars, models, K)
    MS.promote(models, bt["metrics"], bt["periods"], root, KEEP)
    best = MS.best_folder(spark, root)
    kept = FS.read_metrics(spark, f"{best}/metrics", ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in bt["metrics"].schema.fields if f.name != "model") + ", model string")
    curves = (FS.read_equity(spark, f"{best}/equity", "period timestamp, cum double, model string, symbol string")
              .groupBy("model", "symbol").agg(F.max("cum").alias("best_peak")))
    out = bt["metrics"].select("model", "symbol", *_METRIC_COLS, "final_score").join(models.select("model", "version"), "model")
    out = out.join(kept.select("model", "symbol", F.lit(1).alias("best")), ["model", "symbol"], "left").join(curves, ["model", "symbol"], "left")
    return out.select("model", "symbol", "version", *_METRIC_COLS, "final_score", F.coalesce("best", F.lit(0)).alias("best"), "best_peak")
