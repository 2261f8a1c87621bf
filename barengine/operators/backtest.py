"""Backtest as window functions.

The reference drives an event-driven broker bar by bar. Its strategy has no
memory beyond the current signal: after bar i the wanted position is
sign(signal_i), filled at the next bar's open. So the whole simulation is
a set of window expressions per (model, series):

  pos_t   = sign(pred_{t-1})                       (B2, 0 on the first bar)
  dq_t    = pos_t - pos_{t-1}
  fill_t  = min(open*(1+s), high) if dq > 0, max(open*(1-s), low) if dq < 0
  comm_t  = |dq_t| * fill_t * 0.0004
  cash_t  = 10,000 - sum_{u<=t} (dq_u * fill_u + comm_u)     (running sum)
  equity_t = cash_t + pos_t * close_t

Period returns are the change of the last equity of each day (B6), the
metrics are one aggregation per (model, series). Positions, cash and the
drawdown's running maximum all use the blocked series layout, so a long
series never lands in one task. No order is refused for lack of cash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import COMMISSION, SLIPPAGE, START_CASH, TRADING_DAYS
from . import labels as L
from . import series


def dot(x: Column, w: Column) -> Column:
    """x·w over the first len(w) entries of x (no Python UDF)."""
    return F.aggregate(F.zip_with(F.slice(x, 1, F.size(w)), w, lambda a, b: a * b), F.lit(0.0),
                       lambda acc, v: acc + v)


def lag_features(bars: DataFrame, n: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """W5 + W6 as an array column ``x`` (lag_0..lag_{n-1} of the return); keeps ``_rn``."""
    d = series.number_rows(bars, keys)
    stages = [lambda w: {"_ret": L.simple_return(w)},
              lambda w: {"x": F.array(*[F.coalesce(F.lag("_ret", i).over(w), F.lit(0.0)) if i
                                        else F.col("_ret") for i in range(n)])}]
    return series.staged(d, keys, stages, back=n, numbered=True, keep_rn=True).drop("_ret")


def score(bars_x: DataFrame, models: DataFrame, on: Sequence[str] = ("freq",)) -> DataFrame:
    """J5 + M12: every series row × every model of its frequency, with pred = x·w.

    The models table has one row per trained model (a configuration-sized
    table: model × label × frequency combinations); it is broadcast for the
    equi-join on the frequency, so the price rows are not shuffled.
    """
    m = F.broadcast(models.select("model", *on, "weights"))
    j = bars_x.join(m, list(on), "inner")
    return j.withColumn("pred", dot(F.col("x"), F.col("weights"))).drop("weights")


def simulate(scored: DataFrame, keys: Sequence[str] = ("model", "symbol"), slippage: float = SLIPPAGE,
             commission: float = COMMISSION, cash0: float = START_CASH) -> DataFrame:
    """B1-B5 on scored rows (needs ``_rn``, OHLC, pred)."""
    keys = list(keys)

    def st1(w):
        # next_up (W7) rides along for the class metrics: same window, no extra pass
        return {"signal": F.signum("pred").cast("int"), "_up": L.next_up(w).cast("int")}

    def st2(w):
        return {"pos": F.coalesce(F.lag("signal", 1).over(w), F.lit(0))}

    def st3(w):
        dq = F.col("pos") - F.coalesce(F.lag("pos", 1).over(w), F.lit(0))
        return {"dq": dq}

    d = series.staged(scored, keys, [st1, st2, st3], back=2, fwd=1, numbered=True, keep_rn=True)
    fill = (F.when(F.col("dq") > 0, F.least(F.col("open") * (1 + slippage), F.col("high")))
            .when(F.col("dq") < 0, F.greatest(F.col("open") * (1 - slippage), F.col("low"))))
    d = d.withColumn("fill", fill)
    d = d.withColumn("commission", F.when(F.col("dq") != 0, F.abs(F.col("dq")) * F.col("fill") * commission)
                     .otherwise(F.lit(0.0)))
    cost = F.when(F.col("dq") != 0, F.col("dq") * F.col("fill") + F.col("commission")).otherwise(F.lit(0.0))
    # exact decimals: the cash of a bar does not depend on the order or grouping of the sum
    d = series.running(d, keys, {"_spent": ("sum", cost.cast("decimal(27,10)"))})
    return (d.withColumn("cash", (F.lit(cash0).cast("decimal(27,10)") - F.col("_spent")).cast("double"))
             .withColumn("equity", F.col("cash") + F.col("pos") * F.col("close"))
             .drop("_spent"))


def period_returns(sim: DataFrame, keys: Sequence[str] = ("model", "symbol"), period: str = "day",
                   cash0: float = START_CASH) -> DataFrame:
    """Last equity of each period and its return against the period
    before (the first against the starting cash); W10 cumulated, W11 peak."""
    keys = list(keys)
    per = sim.groupBy(*keys, F.date_trunc(period, "ts").alias("period")).agg(
        F.max_by("equity", "ts").alias("equity_end"))
    # One row per series and period: a partition holds at most the number of
    # periods in the covered range (3,653 days per decade), however many bars
    # or ticks a hot symbol has, so plain windows are bounded here.
    w = Window.partitionBy(*keys).orderBy("period")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    prev = F.coalesce(F.lag("equity_end", 1).over(w), F.lit(cash0))
    d = per.withColumn("ret", F.col("equity_end") / F.nullif(prev, F.lit(0.0)) - 1)
    d = d.withColumn("cum", F.product(1 + F.col("ret")).over(run))
    d = d.withColumn("peak", F.max("cum").over(run))
    return d.withColumn("drawdown", (F.col("peak") - F.col("cum")) / F.nullif(F.col("peak"), F.lit(0.0)))


def risk_metrics(rets: DataFrame, keys: Sequence[str] = ("model", "symbol")) -> DataFrame:
    """B7 = A9-A13 per series: one aggregation (partial on the map side)."""
    r = F.col("ret")
    ann = math.sqrt(TRADING_DAYS)
    agg = rets.groupBy(*keys).agg(
        F.count(r).alias("n_periods"),
        (F.product(1 + r) - 1).alias("total_return"),
        (F.avg(r) * TRADING_DAYS).alias("_mean"),
        (F.stddev_samp(r) * ann).alias("_std"),
        (F.stddev_samp(F.when(r < 0, r)) * ann).alias("_down"),
        F.max("drawdown").alias("max_drawdown"))
    cagr = F.pow(1 + F.col("total_return"), F.lit(float(TRADING_DAYS)) / F.col("n_periods")) - 1
    return agg.select(
        *keys, "n_periods", "total_return",
        F.nanvl(cagr, F.lit(None)).alias("cagr"),
        F.when(F.col("_std") == 0, F.lit(0.0)).otherwise(F.col("_mean") / F.col("_std")).alias("sharpe"),
        F.when(F.col("_down") == 0, F.lit(0.0)).otherwise(F.col("_mean") / F.col("_down")).alias("sortino"),
        "max_drawdown")


def class_metrics(scored: DataFrame, keys: Sequence[str] = ("model", "symbol")) -> DataFrame:
    """B8 = A5-A7: accuracy, balanced accuracy (mean recall over the classes
    present in the truth), F1 of class 1 (0 when undefined); the last row of
    each series has no truth and is left out."""
    keys = list(keys)
    d = scored
    if "_up" not in d.columns:  # simulate() already carries it
        d = series.staged(scored, keys, [lambda w: {"_up": L.next_up(w).cast("int")}], back=0, fwd=1,
                          numbered=True, keep_rn=True)
    d = d.where(F.col("_up").isNotNull()).withColumn("_p", (F.col("pred") > 0).cast("int"))
    t, p = F.col("_up"), F.col("_p")
    agg = d.groupBy(*keys).agg(
        F.avg((t == p).cast("double")).alias("accuracy"),
        F.sum(((t == 1) & (p == 1)).cast("long")).alias("_tp"),
        F.sum(((t == 0) & (p == 1)).cast("long")).alias("_fp"),
        F.sum(((t == 1) & (p == 0)).cast("long")).alias("_fn"),
        F.sum(((t == 0) & (p == 0)).cast("long")).alias("_tn"))
    rec1 = F.when(F.col("_tp") + F.col("_fn") > 0, F.col("_tp") / (F.col("_tp") + F.col("_fn")))
    rec0 = F.when(F.col("_tn") + F.col("_fp") > 0, F.col("_tn") / (F.col("_tn") + F.col("_fp")))
    bal = F.when(rec1.isNull(), rec0).when(rec0.isNull(), rec1).otherwise((rec1 + rec0) / 2)
    den = F.col("_tp") * 2 + F.col("_fp") + F.col("_fn")
    f1 = F.when(den > 0, F.col("_tp") * 2 / den).otherwise(F.lit(0.0))
    return agg.select(*keys, "accuracy", bal.alias("balanced_accuracy"), f1.alias("f1"))


def final_score(bal: Column, sharpe: Column) -> Column:
    """0.4*balanced_accuracy + 0.6*min(sharpe/3, 1); a missing Sharpe
    gives a missing score (CASE, not least(), which would skip the NULL)."""
    capped = F.when(sharpe.isNull(), F.lit(None)).when(sharpe / 3 < 1, sharpe / 3).otherwise(F.lit(1.0))
    return bal * 0.4 + capped * 0.6


def backtest(bars: DataFrame, models: DataFrame, n_lags: int, keys: Sequence[str] = ("symbol",),
             on: Sequence[str] = ("freq",)) -> dict[str, DataFrame]:
    """All models × all series in one plan; returns the trade table, the
    period table and the metric table (one row per model and series)."""
    keys = list(keys)
    x = lag_features(bars, n_lags, keys)
    # The scored table feeds the simulation and the class metrics: cut the
    # lineage once (a table written under spark.checkpoint.dir) so neither
    # branch recomputes it and a lost executor does not replay it.
    scored = checkpoint(score(x, models, on))
    mk = ["model", *keys]
    sim = simulate(scored, mk)
    per = period_returns(sim, mk)
    risk = risk_metrics(per, mk)
    cls = class_metrics(sim, mk)
    m = risk.join(cls, mk, "inner")
    m = m.withColumn("final_score", final_score(F.col("balanced_accuracy"), F.col("sharpe")))
    return {"trades": sim, "periods": per, "metrics": m}


def checkpoint(df: DataFrame) -> DataFrame:
    from ..session import materialize
    return materialize(df, "scored")


def promote_best(metrics: DataFrame, keep: float = 0.6) -> DataFrame:
    """Models worth keeping (a missing score is not kept)."""
    return metrics.where(F.col("final_score") >= keep)
