"""Recursive indicators (I10 exponential, I11 Wilder, I12 KAMA) on W14.

Every smoothed average here is an affine recurrence y_t = a_t*y_{t-1} + b_t
with a seed row (a = 0, b = seed). Indicators are computed in *levels*: a
level is one blocked window pass (bounded frames: seeds, true range, price
changes, ...) followed by one ``affine_scan`` with all recurrences of that
level; chained averages (EMA of EMA) go one level up. Requested names decide
which levels and recurrences run.

Seeds follow the public TA-Lib definitions: EMA(n) starts at row n-1 with the
simple average of the first n values; Wilder averages (RSI, ATR, ADX) start
with the mean of the first n values after the first change; Wilder sums (DM,
TR for DI) with the sum of the first n-1 changes; MACD's fast EMA is seeded
from the 12 closes ending where the slow one starts (rows 15-26), so both
begin together; ADOSC's EMAs start at the first AD value; KAMA starts from
the close of the row before its first output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import series
from ..scan import affine_scan
from ..series import RN
from .base import Ctx, Indicator, safe_div, true_range


def _i(name, outputs, volume=False):
    return Indicator(name, 0, [], outputs, volume=volume, group="recursive")


REGISTRY: dict[str, Indicator] = {i.name: i for i in [
    _i("ema", ["ema"]), _i("dema", ["dema"]), _i("tema", ["tema"]), _i("trix", ["trix"]), _i("t3", ["t3"]),
    _i("macd", ["macd_macd", "macd_macdsignal", "macd_macdhist"]),
    _i("macdfix", ["macdfix_macd", "macdfix_macdsignal", "macdfix_macdhist"]),
    _i("adosc", ["adosc"], volume=True),
    _i("atr", ["atr"]), _i("natr", ["natr"]), _i("rsi", ["rsi"]), _i("cmo", ["cmo"]),
    _i("plus_dm", ["plus_dm"]), _i("minus_dm", ["minus_dm"]), _i("plus_di", ["plus_di"]),
    _i("minus_di", ["minus_di"]), _i("dx", ["dx"]), _i("adx", ["adx"]), _i("adxr", ["adxr"]),
    _i("stochrsi", ["stochrsi_fastk", "stochrsi_fastd"]), _i("kama", ["kama"]),
]}

# Default periods and constants of the public definitions.
EMA_N, T3_N, T3_V = 30, 5, 0.7
MACD_FAST, MACD_SLOW, MACD_SIG = 12, 26, 9
MACDFIX_FAST_ALPHA, MACDFIX_SLOW_ALPHA = 0.15, 0.075
ADOSC_FAST, ADOSC_SLOW = 3, 10
WILDER_N, KAMA_N = 14, 30
STOCHRSI_K, STOCHRSI_D = 5, 3



def ema_spec(src: Column, seed: Column, seed_rn: int, alpha: float) -> tuple[Column, Column]:
    """EMA recurrence: seed at ``seed_rn``, then y = (1-α)·y + α·x."""
    a = F.when(F.col(RN) <= seed_rn, F.lit(0.0)).otherwise(F.lit(1.0 - alpha))
    b = F.when(F.col(RN) < seed_rn, F.lit(0.0)).when(F.col(RN) == seed_rn, seed).otherwise(src * alpha)
    return a, b


def wilder_avg_spec(src: Column, seed: Column, seed_rn: int, n: int) -> tuple[Column, Column]:
    """y = (y·(n-1) + x)/n, seeded with the mean of the first n values."""
    a = F.when(F.col(RN) <= seed_rn, F.lit(0.0)).otherwise(F.lit((n - 1) / n))
    b = F.when(F.col(RN) < seed_rn, F.lit(0.0)).when(F.col(RN) == seed_rn, seed).otherwise(src / n)
    return a, b


def wilder_sum_spec(src: Column, seed: Column, seed_rn: int, n: int) -> tuple[Column, Column]:
    """s = s - s/n + x, seeded with the sum of the first n-1 values."""
    a = F.when(F.col(RN) <= seed_rn, F.lit(0.0)).otherwise(F.lit(1.0 - 1.0 / n))
    b = F.when(F.col(RN) < seed_rn, F.lit(0.0)).when(F.col(RN) == seed_rn, seed).otherwise(src)
    return a, b


def _after(k: int, e: Column) -> Column:
    return F.when(F.col(RN) >= k, e)


def _part(change: Column) -> Column:
    """The part of a change above 0; NULL stays NULL."""
    return F.when(change.isNotNull(), F.greatest(change, F.lit(0.0)))


class _Level:
    def __init__(self):
        self.stages: list[dict[str, Callable[[Ctx], Column]]] = [{}, {}]
        self.back = 1
        self.specs: dict[str, tuple[Callable[[], Column], Callable[[], Column]]] = {}
        self.post: dict[str, Callable[[], Column]] = {}

    def win(self, stage: int, name: str, fn: Callable[[Ctx], Column], back: int):
        self.stages[stage][name] = fn
        self.back = max(self.back, back)

    def empty(self) -> bool:
        return not (any(self.stages) or self.specs or self.post)


def _plan(names: set[str]) -> list[_Level]:
    """Levels of windows and scans needed for ``names``."""
    L = [_Level() for _ in range(6)]
    W = WILDER_N
    ema_chain = {"ema": 1, "dema": 2, "tema": 3, "trix": 3}
    depth = max([ema_chain.get(n, 0) for n in names] + [0])
    # EMA(30) chain: e1, e2, e3 (DEMA, TEMA, TRIX).
    for k in range(depth):
        seed_rn = (k + 1) * (EMA_N - 1)
        src = "close" if k == 0 else f"_e{k}"
        L[k].win(0, f"_se{k + 1}", lambda ctx, s=src: F.avg(s).over(ctx.frame(EMA_N)), EMA_N - 1)
        L[k].specs[f"_e{k + 1}"] = (lambda s=src, sr=seed_rn, k=k: ema_spec(F.col(s), F.col(f"_se{k + 1}"), sr,
                                                                            2.0 / (EMA_N + 1)))
        L[k].post[f"_e{k + 1}"] = (lambda k=k, sr=seed_rn: _after(sr, F.col(f"_e{k + 1}")))
    if "ema" in names:
        L[0].post["ema"] = lambda: F.col("_e1")
    if "dema" in names:
        L[1].post["dema"] = lambda: _after(2 * (EMA_N - 1), F.col("_e1") * 2 - F.col("_e2"))
    if "tema" in names:
        L[2].post["tema"] = lambda: _after(3 * (EMA_N - 1), F.col("_e1") * 3 - F.col("_e2") * 3 + F.col("_e3"))
    if "trix" in names:
        L[3].win(0, "trix", lambda ctx: _after(3 * (EMA_N - 1) + 1, F.when(
            ctx.lag("_e3") != 0, (F.col("_e3") / ctx.lag("_e3") - 1) * 100).otherwise(F.lit(0.0))), 1)
    # Six chained EMA(5).
    if "t3" in names:
        for k in range(6):
            seed_rn = (k + 1) * (T3_N - 1)
            src = "close" if k == 0 else f"_t{k}"
            L[k].win(0, f"_st{k + 1}", lambda ctx, s=src: F.avg(s).over(ctx.frame(T3_N)), T3_N - 1)
            L[k].specs[f"_t{k + 1}"] = (lambda s=src, sr=seed_rn, k=k: ema_spec(
                F.col(s), F.col(f"_st{k + 1}"), sr, 2.0 / (T3_N + 1)))
            L[k].post[f"_t{k + 1}"] = (lambda k=k, sr=seed_rn: _after(sr, F.col(f"_t{k + 1}")))
        v = T3_V
        c1, c2 = -v ** 3, 3 * v ** 2 + 3 * v ** 3
        c3, c4 = -6 * v ** 2 - 3 * v - 3 * v ** 3, 1 + 3 * v + 3 * v ** 2 + v ** 3
        L[5].post["t3"] = lambda: (F.col("_t6") * c1 + F.col("_t5") * c2 + F.col("_t4") * c3 + F.col("_t3") * c4)
    # MACD / MACDFIX: fast and slow EMAs both start at row slow-1.
    for nm, fa, sa in (("macd", 2.0 / (MACD_FAST + 1), 2.0 / (MACD_SLOW + 1)),
                       ("macdfix", MACDFIX_FAST_ALPHA, MACDFIX_SLOW_ALPHA)):
        if nm not in names:
            continue
        s0 = MACD_SLOW - 1
        L[0].win(0, f"_{nm}_sf", lambda ctx: F.avg("close").over(ctx.frame(MACD_FAST)), MACD_SLOW)
        L[0].win(0, f"_{nm}_ss", lambda ctx: F.avg("close").over(ctx.frame(MACD_SLOW)), MACD_SLOW)
        L[0].specs[f"_{nm}_f"] = (lambda nm=nm, fa=fa: ema_spec(F.col("close"), F.col(f"_{nm}_sf"), s0, fa))
        L[0].specs[f"_{nm}_s"] = (lambda nm=nm, sa=sa: ema_spec(F.col("close"), F.col(f"_{nm}_ss"), s0, sa))
        L[0].post[f"_{nm}_l"] = (lambda nm=nm: _after(s0, F.col(f"_{nm}_f") - F.col(f"_{nm}_s")))
        s1 = s0 + MACD_SIG - 1
        L[1].win(0, f"_{nm}_sg0", lambda ctx, nm=nm: F.avg(f"_{nm}_l").over(ctx.frame(MACD_SIG)), MACD_SIG)
        L[1].specs[f"_{nm}_sg"] = (lambda nm=nm: ema_spec(F.col(f"_{nm}_l"), F.col(f"_{nm}_sg0"), s1,
                                                          2.0 / (MACD_SIG + 1)))
        L[1].post[f"{nm}_macd"] = (lambda nm=nm: _after(s1, F.col(f"_{nm}_l")))
        L[1].post[f"{nm}_macdsignal"] = (lambda nm=nm: _after(s1, F.col(f"_{nm}_sg")))
        L[1].post[f"{nm}_macdhist"] = (lambda nm=nm: _after(s1, F.col(f"_{nm}_l") - F.col(f"_{nm}_sg")))
    # ADOSC: EMAs of the accumulation/distribution line seeded by its first value.
    if "adosc" in names:
        for nm, n in (("_adf", ADOSC_FAST), ("_ads", ADOSC_SLOW)):
            L[0].specs[nm] = (lambda n=n: ema_spec(F.col("_adl"), F.col("_adl"), 0, 2.0 / (n + 1)))
        L[0].post["adosc"] = lambda: _after(ADOSC_SLOW - 1, F.col("_adf") - F.col("_ads"))
    # Wilder family on true range and price changes.
    need_tr = names & {"atr", "natr", "plus_di", "minus_di", "dx", "adx", "adxr"}
    need_dm = names & {"plus_dm", "minus_dm", "plus_di", "minus_di", "dx", "adx", "adxr"}
    need_rsi = names & {"rsi", "cmo", "stochrsi"}
    if need_tr or need_dm or need_rsi:
        L[0].win(0, "_tr", true_range, 1)
        L[0].win(0, "_chg", lambda ctx: F.col("close") - ctx.lag("close"), 1)
        L[0].win(0, "_pdm0", lambda ctx: F.col("high") - ctx.lag("high"), 1)
        L[0].win(0, "_mdm0", lambda ctx: ctx.lag("low") - F.col("low"), 1)
    if names & {"atr", "natr"}:
        L[0].win(1, "_atr0", lambda ctx: F.avg("_tr").over(ctx.frame(W)), W + 1)
        L[0].specs["_atr"] = lambda: wilder_avg_spec(F.col("_tr"), F.col("_atr0"), W, W)
        if "atr" in names:
            L[0].post["atr"] = lambda: _after(W, F.col("_atr"))
        if "natr" in names:
            L[0].post["natr"] = lambda: _after(W, safe_div(F.col("_atr") * 100.0, F.col("close")))
    if need_rsi:
        # a missing change is a gap, not a change of 0 (greatest skips NULL)
        L[0].win(1, "_up", lambda ctx: _part(F.col("_chg")), 1)
        L[0].win(1, "_dn", lambda ctx: _part(-F.col("_chg")), 1)
        # seeds use the raw change (stage 1 columns are not visible to each other)
        L[0].win(1, "_up0", lambda ctx: F.avg(_part(F.col("_chg"))).over(ctx.frame(W)), W + 1)
        L[0].win(1, "_dn0", lambda ctx: F.avg(_part(-F.col("_chg"))).over(ctx.frame(W)), W + 1)
        L[0].specs["_au"] = lambda: wilder_avg_spec(F.col("_up"), F.col("_up0"), W, W)
        L[0].specs["_ad"] = lambda: wilder_avg_spec(F.col("_dn"), F.col("_dn0"), W, W)
        if names & {"rsi", "stochrsi"}:
            L[0].post["rsi"] = lambda: _after(W, safe_div(F.col("_au") * 100.0, F.col("_au") + F.col("_ad")))
        if "cmo" in names:
            L[0].post["cmo"] = lambda: _after(W, safe_div((F.col("_au") - F.col("_ad")) * 100.0,
                                                          F.col("_au") + F.col("_ad")))
    if "stochrsi" in names:
        k0 = W + STOCHRSI_K - 1
        k1 = k0 + STOCHRSI_D - 1

        def fastk(ctx):
            hi, lo = F.max("rsi").over(ctx.frame(STOCHRSI_K)), F.min("rsi").over(ctx.frame(STOCHRSI_K))
            return _after(k0, F.when(hi - lo > 0, (F.col("rsi") - lo) * 100.0 / (hi - lo)).otherwise(F.lit(0.0)))
        L[1].win(0, "_srk", fastk, STOCHRSI_K + STOCHRSI_D)
        L[1].win(1, "stochrsi_fastd", lambda ctx: _after(k1, F.avg("_srk").over(ctx.frame(STOCHRSI_D))),
                 STOCHRSI_K + STOCHRSI_D)
        L[1].post["stochrsi_fastk"] = lambda: _after(k1, F.col("_srk"))
    if need_dm:
        def pdm(ctx):
            up, dn = F.col("_pdm0"), F.col("_mdm0")
            return F.when(up.isNull() | dn.isNull(), F.when(F.col(RN) == 0, 0.0)).when((up > dn) & (up > 0), up).otherwise(F.lit(0.0))

        def mdm(ctx):
            up, dn = F.col("_pdm0"), F.col("_mdm0")
            return F.when(up.isNull() | dn.isNull(), F.when(F.col(RN) == 0, 0.0)).when((dn > up) & (dn > 0), dn).otherwise(F.lit(0.0))
        L[0].win(1, "_pdm", pdm, 1)
        L[0].win(1, "_mdm", mdm, 1)
        pdm_raw = F.when((F.col("_pdm0") > F.col("_mdm0")) & (F.col("_pdm0") > 0), F.col("_pdm0"))
        mdm_raw = F.when((F.col("_mdm0") > F.col("_pdm0")) & (F.col("_mdm0") > 0), F.col("_mdm0"))
        L[0].win(1, "_pdm_s0", lambda ctx: F.sum(F.coalesce(pdm_raw, F.lit(0.0))).over(ctx.frame(W - 1)), W)
        L[0].win(1, "_mdm_s0", lambda ctx: F.sum(F.coalesce(mdm_raw, F.lit(0.0))).over(ctx.frame(W - 1)), W)
        L[0].specs["_spdm"] = lambda: wilder_sum_spec(F.col("_pdm"), F.col("_pdm_s0"), W - 1, W)
        L[0].specs["_smdm"] = lambda: wilder_sum_spec(F.col("_mdm"), F.col("_mdm_s0"), W - 1, W)
        if "plus_dm" in names:
            L[0].post["plus_dm"] = lambda: _after(W - 1, F.col("_spdm"))
        if "minus_dm" in names:
            L[0].post["minus_dm"] = lambda: _after(W - 1, F.col("_smdm"))
        if names & {"plus_di", "minus_di", "dx", "adx", "adxr"}:
            L[0].win(1, "_tr_s0", lambda ctx: F.sum("_tr").over(ctx.frame(W - 1)), W)
            L[0].specs["_str"] = lambda: wilder_sum_spec(F.col("_tr"), F.col("_tr_s0"), W - 1, W)
            L[0].post["_pdi"] = lambda: _after(W, safe_div(F.col("_spdm") * 100.0, F.col("_str")))
            L[0].post["_mdi"] = lambda: _after(W, safe_div(F.col("_smdm") * 100.0, F.col("_str")))
            L[0].post["_dx"] = lambda: _after(W, safe_div(F.abs(F.col("_pdi") - F.col("_mdi")) * 100.0,
                                                          F.col("_pdi") + F.col("_mdi")))
            for o, src in (("plus_di", "_pdi"), ("minus_di", "_mdi"), ("dx", "_dx")):
                if o in names:
                    L[0].post[o] = lambda src=src: F.col(src)
        if names & {"adx", "adxr"}:
            s = 2 * W - 1
            L[1].win(0, "_adx0", lambda ctx: F.avg("_dx").over(ctx.frame(W)), W)
            L[1].specs["_adx"] = lambda: wilder_avg_spec(F.col("_dx"), F.col("_adx0"), s, W)
            L[1].post["adx"] = lambda: _after(s, F.col("_adx"))
            if "adxr" in names:
                L[2].win(0, "adxr", lambda ctx: _after(s + W - 1, (F.col("adx") + ctx.lag("adx", W - 1)) / 2), W)
    # KAMA: per-row smoothing constant from the efficiency ratio.
    if "kama" in names:
        n = KAMA_N
        L[0].win(0, "_kd", lambda ctx: F.abs(F.col("close") - ctx.lag("close")), n)
        L[0].win(0, "_kc", lambda ctx: F.col("close") - ctx.lag("close", n), n)

        def sc(ctx):
            s = F.sum("_kd").over(ctx.frame(n))
            er = F.when((s <= F.col("_kc")) | (s == 0), F.lit(1.0)).otherwise(F.abs(F.col("_kc") / s))
            fast, slow = 2.0 / 3.0, 2.0 / (n + 1)
            k = er * (fast - slow) + slow
            return k * k
        L[0].win(1, "_ksc", sc, n + 1)
        L[0].specs["_kama"] = lambda: (F.when(F.col(RN) <= n - 1, F.lit(0.0)).otherwise(1 - F.col("_ksc")),
                                       F.when(F.col(RN) < n - 1, F.lit(0.0)).when(F.col(RN) == n - 1, F.col("close"))
                                       .otherwise(F.col("_ksc") * F.col("close")))
        L[0].post["kama"] = lambda: _after(n, F.col("_kama"))
    return [lv for lv in L if not lv.empty()]


def add_recursive(d: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Add the outputs of ``names`` to ``d`` (which carries ``_rn``)."""
    names = set(names)
    keys = list(keys)
    if "adosc" in names:
        from .cumulative import ad_term
        d = series.running(d, keys, {"_adl": ("sum", ad_term())})
    for lv in _plan(names):
        stages = []
        for st in lv.stages:
            if st:
                stages.append(lambda w, st=st: {k: f(Ctx(w)) for k, f in st.items()})
        if stages:
            d = series.staged(d, keys, stages, back=lv.back, numbered=True, keep_rn=True)
        if lv.specs:
            d = affine_scan(d, keys, {k: f() for k, f in lv.specs.items()})
        for k, f in lv.post.items():  # in order: later posts read earlier ones
            d = d.withColumn(k, f())
    return d
