"""Finite-memory indicators (I3 lag, I4 rolling aggregates, I5 rolling
arg-max, I6 weighted windows, I7 rolling regression, I8 oscillators).

Every frame is bounded, so all of them run on the blocked series layout in
one sort; default periods are the public TA-Lib defaults.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..series import RN
from .base import Ctx, Indicator, safe_div, true_range



# ----------------------------------------------------------------- I3 lag
def _roc(name, n, fn):
    def st(ctx: Ctx):
        p = ctx.lag("close", n)
        return {name: F.when(ctx.ready(n), F.when(p != 0, fn(F.col("close"), p)).otherwise(F.lit(0.0)))}
    return Indicator(name, n, [st], [name], group="momentum")


def _mom(n=10):
    return Indicator("mom", n, [lambda ctx: {"mom": F.when(ctx.ready(n), F.col("close") - ctx.lag("close", n))}],
                     ["mom"], group="momentum")


def _trange():
    return Indicator("trange", 1, [lambda ctx: {"trange": true_range(ctx)}], ["trange"], group="momentum")


LAG = [
    _mom(),
    _roc("roc", 10, lambda x, p: (x / p - 1) * 100),
    _roc("rocp", 10, lambda x, p: (x - p) / p),
    _roc("rocr", 10, lambda x, p: x / p),
    _roc("rocr100", 10, lambda x, p: x / p * 100),
    _trange(),
]


# ------------------------------------------------------- I4 rolling aggregates
def _agg(name, fn, n, col="close"):
    return Indicator(name, n - 1, [lambda ctx: {name: ctx.roll(fn, col, n)}], [name], group="rolling")


def _minmax(n=30):
    return Indicator("minmax", n - 1, [lambda ctx: {"minmax_min": ctx.roll(F.min, "close", n),
                                                    "minmax_max": ctx.roll(F.max, "close", n)}],
                     ["minmax_min", "minmax_max"], group="rolling")


def _midpoint(n=14):
    return Indicator("midpoint", n - 1, [lambda ctx: {
        "midpoint": (ctx.roll(F.max, "close", n) + ctx.roll(F.min, "close", n)) / 2}], ["midpoint"], group="rolling")


def _midprice(n=14):
    return Indicator("midprice", n - 1, [lambda ctx: {
        "midprice": (ctx.roll(F.max, "high", n) + ctx.roll(F.min, "low", n)) / 2}], ["midprice"], group="rolling")


def _bbands(n=5, up=2.0, dn=2.0):
    def st(ctx):
        m = ctx.sma("close", n)
        sd = ctx.roll(F.stddev_pop, "close", n)
        return {"bbands_upperband": m + sd * up, "bbands_middleband": m, "bbands_lowerband": m - sd * dn}
    return Indicator("bbands", n - 1, [st], ["bbands_upperband", "bbands_middleband", "bbands_lowerband"],
                     group="rolling")


ROLLING = [
    _agg("sma", F.avg, 30),
    _agg("ma", F.avg, 30),
    _agg("sum", F.sum, 30),
    _agg("max", F.max, 30),
    _agg("min", F.min, 30),
    _minmax(),
    _midpoint(),
    _midprice(),
    _agg("stddev", F.stddev_pop, 5),
    _agg("var", F.var_pop, 5),
    _bbands(),
]


# ------------------------------------------------------- I5 rolling arg-max
def _argmax(ctx: Ctx, col: str, n: int):
    """Series position of the highest value in the last n rows; newest tie wins."""
    return F.max_by(F.col(RN), F.struct(F.col(col), F.col(RN))).over(ctx.frame(n))


def _argmin(ctx: Ctx, col: str, n: int):
    return F.min_by(F.col(RN), F.struct(F.col(col), -F.col(RN))).over(ctx.frame(n))


def _index_ind(name, n=30):
    def st(ctx):
        r = ctx.ready(n - 1)
        out = {}
        if name in ("maxindex", "minmaxindex"):
            out["maxindex" if name == "maxindex" else "minmaxindex_maxidx"] = F.when(r, _argmax(ctx, "close", n))
        if name in ("minindex", "minmaxindex"):
            out["minindex" if name == "minindex" else "minmaxindex_minidx"] = F.when(r, _argmin(ctx, "close", n))
        return out
    outs = {"maxindex": ["maxindex"], "minindex": ["minindex"],
            "minmaxindex": ["minmaxindex_minidx", "minmaxindex_maxidx"]}[name]
    return Indicator(name, n - 1, [st], outs, group="argmax")


def _aroon(n=14):
    def st(ctx):
        r = ctx.ready(n)
        up = (n - (F.col(RN) - _argmax(ctx, "high", n + 1))) * 100.0 / n
        dn = (n - (F.col(RN) - _argmin(ctx, "low", n + 1))) * 100.0 / n
        return {"aroon_aroondown": F.when(r, dn), "aroon_aroonup": F.when(r, up)}
    return Indicator("aroon", n, [st], ["aroon_aroondown", "aroon_aroonup"], group="argmax")


def _aroonosc(n=14):
    def st(ctx):
        up = (n - (F.col(RN) - _argmax(ctx, "high", n + 1))) * 100.0 / n
        dn = (n - (F.col(RN) - _argmin(ctx, "low", n + 1))) * 100.0 / n
        return {"aroonosc": F.when(ctx.ready(n), up - dn)}
    return Indicator("aroonosc", n, [st], ["aroonosc"], group="argmax")


ARGMAX = [_index_ind("maxindex"), _index_ind("minindex"), _index_ind("minmaxindex"), _aroon(), _aroonosc()]


# ------------------------------------------------------- I6 weighted windows
def _wma(n=30):
    def st(ctx):
        arr = ctx.collect("close", n)
        w = F.aggregate(F.zip_with(arr, F.sequence(F.lit(1), F.lit(n)), lambda x, i: x * i),
                        F.lit(0.0), lambda acc, x: acc + x)
        return {"wma": F.when(ctx.ready(n - 1), w / (n * (n + 1) / 2))}
    return Indicator("wma", n - 1, [st], ["wma"], group="weighted")


def _trima(n=30):
    a, b = (n // 2, n // 2 + 1) if n % 2 == 0 else ((n + 1) // 2, (n + 1) // 2)
    return Indicator("trima", a + b - 2, [
        lambda ctx: {"_trima1": ctx.sma("close", a)},
        lambda ctx: {"trima": ctx.roll(F.avg, "_trima1", b, a + b - 2)},
    ], ["trima"], group="weighted")


WEIGHTED = [_wma(), _trima()]


# ------------------------------------------------------ I7 rolling regression
def _linreg_family(n=14):
    def st(ctx):
        x = ctx.local_x()
        fr = ctx.frame(n)
        slope = F.regr_slope(F.col("close"), x).over(fr)
        icpt = F.regr_intercept(F.col("close"), x).over(fr)
        r = ctx.ready(n - 1)
        return {
            "linearreg": F.when(r, icpt + slope * x),
            "linearreg_slope": F.when(r, slope),
            "linearreg_intercept": F.when(r, icpt + slope * (x - (n - 1))),
            "linearreg_angle": F.when(r, F.atan(slope) * (180.0 / math.pi)),
            "tsf": F.when(r, icpt + slope * (x + 1)),
        }
    return Indicator("linearreg", n - 1, [st], ["linearreg", "linearreg_slope", "linearreg_intercept",
                                               "linearreg_angle", "tsf"], group="regression")


def _correl(n=30):
    def st(ctx):
        cr = F.corr(F.col("high"), F.col("low")).over(ctx.frame(n))
        return {"correl": F.when(ctx.ready(n - 1), F.coalesce(F.nanvl(cr, F.lit(None)), F.lit(0.0)))}
    return Indicator("correl", n - 1, [st], ["correl"], group="regression")


def _beta(n=5):
    def rets(ctx):
        h1, l1 = ctx.lag("high"), ctx.lag("low")
        return {"_beta_x": F.when(h1 != 0, (F.col("high") - h1) / h1).otherwise(F.lit(0.0)),
                "_beta_y": F.when(l1 != 0, (F.col("low") - l1) / l1).otherwise(F.lit(0.0))}

    def st(ctx):
        fr = ctx.frame(n)
        sx, sy = F.sum("_beta_x").over(fr), F.sum("_beta_y").over(fr)
        sxx = F.sum(F.col("_beta_x") * F.col("_beta_x")).over(fr)
        sxy = F.sum(F.col("_beta_x") * F.col("_beta_y")).over(fr)
        den = sxx * n - sx * sx
        return {"beta": F.when(ctx.ready(n), safe_div(sxy * n - sx * sy, den))}
    return Indicator("beta", n, [rets, st], ["beta"], group="regression")


REGRESSION = [_linreg_family(), _correl(), _beta()]


# ------------------------------------------------------------ I8 oscillators
def _willr(n=14):
    def st(ctx):
        hh, ll = ctx.roll(F.max, "high", n), ctx.roll(F.min, "low", n)
        return {"willr": safe_div((hh - F.col("close")) * -100.0, hh - ll)}
    return Indicator("willr", n - 1, [st], ["willr"], group="oscillator")


def _cci(n=14):
    def st(ctx):
        tp = (F.col("high") + F.col("low") + F.col("close")) / 3
        return {"_cci_tp": tp}

    def st2(ctx):
        arr = ctx.collect("_cci_tp", n)
        m = F.avg("_cci_tp").over(ctx.frame(n))
        dev = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.abs(x - m))
        return {"cci": F.when(ctx.ready(n - 1), safe_div(F.col("_cci_tp") - m, dev / n * 0.015))}
    return Indicator("cci", n - 1, [st, st2], ["cci"], group="oscillator")


def _mfi(n=14):
    def st(ctx):
        tp = (F.col("high") + F.col("low") + F.col("close")) / 3
        return {"_mfi_tp": tp}

    def st2(ctx):
        tp1 = ctx.lag("_mfi_tp")
        flow = F.col("_mfi_tp") * F.col("volume")
        return {"_pos": F.when(F.col("_mfi_tp") > tp1, flow).otherwise(F.lit(0.0)),
                "_neg": F.when(F.col("_mfi_tp") < tp1, flow).otherwise(F.lit(0.0))}

    def st3(ctx):
        fr = ctx.frame(n)
        p, q = F.sum("_pos").over(fr), F.sum("_neg").over(fr)
        return {"mfi": F.when(ctx.ready(n), F.when(p + q < 1.0, F.lit(0.0)).otherwise(p * 100.0 / (p + q)))}
    return Indicator("mfi", n, [st, st2, st3], ["mfi"], volume=True, group="oscillator")


def _fastk(ctx, n):
    hh, ll = ctx.roll(F.max, "high", n), ctx.roll(F.min, "low", n)
    return F.when(hh - ll > 0, (F.col("close") - ll) * 100.0 / (hh - ll)).otherwise(F.when(hh.isNotNull(), F.lit(0.0)))


def _stochf(n=5, d=3):
    lb = n - 1 + d - 1
    return Indicator("stochf", lb, [
        lambda ctx: {"_sf_k": _fastk(ctx, n)},
        lambda ctx: {"stochf_fastk": F.when(ctx.ready(lb), F.col("_sf_k")),
                     "stochf_fastd": ctx.roll(F.avg, "_sf_k", d, lb)},
    ], ["stochf_fastk", "stochf_fastd"], group="oscillator")


def _stoch(n=5, k=3, d=3):
    lb = n - 1 + k - 1 + d - 1
    return Indicator("stoch", lb, [
        lambda ctx: {"_st_k": _fastk(ctx, n)},
        lambda ctx: {"_st_sk": ctx.roll(F.avg, "_st_k", k, n - 1 + k - 1)},
        lambda ctx: {"stoch_slowk": F.when(ctx.ready(lb), F.col("_st_sk")),
                     "stoch_slowd": ctx.roll(F.avg, "_st_sk", d, lb)},
    ], ["stoch_slowk", "stoch_slowd"], group="oscillator")


def _ultosc(p1=7, p2=14, p3=28):
    def st(ctx):
        c1 = ctx.lag("close")
        lo = F.least(F.col("low"), c1)
        return {"_ult_bp": F.when(c1.isNotNull(), F.col("close") - lo), "_ult_tr": F.when(c1.isNotNull(), F.greatest(F.col("high"), c1) - lo)}

    def st2(ctx):
        def part(n, wgt):
            fr = ctx.frame(n)
            a, b = F.sum("_ult_bp").over(fr), F.sum("_ult_tr").over(fr)
            return F.when(b != 0, a / b * wgt).otherwise(F.lit(0.0))
        return {"ultosc": F.when(ctx.ready(p3), (part(p1, 4.0) + part(p2, 2.0) + part(p3, 1.0)) * 100.0 / 7.0)}
    return Indicator("ultosc", p3, [st, st2], ["ultosc"], group="oscillator")


def _apo(fast=12, slow=26):
    return Indicator("apo", slow - 1, [lambda ctx: {
        "apo": ctx.sma("close", fast, slow - 1) - ctx.sma("close", slow)}], ["apo"], group="oscillator")


def _ppo(fast=12, slow=26):
    def st(ctx):
        f, s = ctx.sma("close", fast, slow - 1), ctx.sma("close", slow)
        return {"ppo": F.when(s.isNotNull(), safe_div((f - s) * 100.0, s))}
    return Indicator("ppo", slow - 1, [st], ["ppo"], group="oscillator")


def _macdext(fast=12, slow=26, sig=9):
    lb = slow - 1 + sig - 1
    return Indicator("macdext", lb, [
        lambda ctx: {"_mx": ctx.sma("close", fast, slow - 1) - ctx.sma("close", slow)},
        lambda ctx: {"_ms": ctx.roll(F.avg, "_mx", sig, lb)},
        lambda ctx: {"macdext_macd": F.when(ctx.ready(lb), F.col("_mx")), "macdext_macdsignal": F.col("_ms"),
                     "macdext_macdhist": F.col("_mx") - F.col("_ms")},
    ], ["macdext_macd", "macdext_macdsignal", "macdext_macdhist"], group="oscillator")


OSCILLATORS = [_willr(), _cci(), _mfi(), _stochf(), _stoch(), _ultosc(), _apo(), _ppo(), _macdext()]

ALL = LAG + ROLLING + ARGMAX + WEIGHTED + REGRESSION + OSCILLATORS
