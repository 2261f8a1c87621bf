"""Registered indicator queries (I1-I9) with DuckDB oracles.

Each oracle is written from the public formula over a row-numbered bar CTE
``b``; the Spark side is ``add_indicators`` on the blocked layout.
"""

from __future__ import annotations

from ..operators.indicators import suite
from . import sql as S
from .inputs import event_bars
from .output import r6
from .registry import register

# Bars with their series position rn (0-based) and the previous close.
BASE = f"""b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn
FROM ({S.hour_bars()}) x)"""
D = "CAST({} AS DOUBLE)"


def W(k: int) -> str:
    """Frame of the current row and k rows before it."""
    return f"OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)"


LAG = "OVER (PARTITION BY symbol ORDER BY rn)"
RUN = "OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def when(rn: int, e: str) -> str:
    return f"CASE WHEN rn >= {rn} THEN {e} END"


def sdiv(n: str, d: str) -> str:
    return f"CASE WHEN ({n}) IS NULL OR ({d}) IS NULL THEN NULL WHEN ({d}) <> 0 THEN ({n}) / ({d}) ELSE 0.0 END"


def q(select: str, ctes: str = "", src: str = "b") -> str:
    return f"WITH {BASE}{',' if ctes else ''} {ctes} SELECT symbol, ts, {select} FROM {src}"


def cols(**exprs: str) -> str:
    return ", ".join(f"{r6(e)} AS {n}" for n, e in exprs.items())


def _spark(names):
    def fn(spark, sf):
        bars = event_bars(spark, sf)
        out = [o for n in names for o in suite.outputs(n)]
        return suite.add_indicators(bars, names).select("symbol", "ts", *out)
    return fn


ORACLE: dict[str, tuple[list[str], str]] = {}


def reg(qname: str, names: list[str], sql: str):
    ORACLE[qname] = (names, sql)
    register(qname, sql)(_spark(names))


# ------------------------------------------------------------ I1 / I2
reg("typprice", ["typprice"], q(cols(typprice="(high + low + close) / 3")))
reg("bop", ["bop"], q(cols(bop=sdiv("close - open", "high - low"))))
reg("price_transforms", ["avgprice", "medprice", "typprice", "wclprice", "bop"], q(cols(
    avgprice="(open + high + low + close) / 4", medprice="(high + low) / 2",
    typprice="(high + low + close) / 3", wclprice="(high + low + close * 2) / 4",
    bop=sdiv("close - open", "high - low"))))
reg("math_transforms", ["atan", "ceil", "cos", "floor", "ln", "log10", "sin", "sqrt", "tanh", "acos",
                        "add", "sub", "mult", "div"], q(cols(
    atan="atan(close)", ceil="ceil(close)", cos="cos(close)", floor="floor(close)",
    ln="CASE WHEN close > 0 THEN ln(close) END", log10="CASE WHEN close > 0 THEN log10(close) END",
    sin="sin(close)", sqrt="CASE WHEN close >= 0 THEN sqrt(close) END", tanh="tanh(close)",
    acos="CASE WHEN close BETWEEN -1 AND 1 THEN acos(close) END",
    add="high + low", sub="high - low", mult="high * low", div="high / nullif(low, 0)")))

# ------------------------------------------------------------ I3
_P10 = f"lag(close, 10) {LAG}"
reg("roc", ["mom", "roc", "rocp", "rocr", "rocr100"], q(cols(
    mom=when(10, f"close - {_P10}"),
    roc=when(10, f"CASE WHEN {_P10} <> 0 THEN (close / {_P10} - 1) * 100 ELSE 0 END"),
    rocp=when(10, f"CASE WHEN {_P10} <> 0 THEN (close - {_P10}) / {_P10} ELSE 0 END"),
    rocr=when(10, f"CASE WHEN {_P10} <> 0 THEN close / {_P10} ELSE 0 END"),
    rocr100=when(10, f"CASE WHEN {_P10} <> 0 THEN close / {_P10} * 100 ELSE 0 END"))))
_C1 = f"lag(close) {LAG}"
reg("trange", ["trange"], q(cols(trange=f"CASE WHEN {_C1} IS NOT NULL THEN greatest(high - low, "
                                     f"abs(high - {_C1}), abs(low - {_C1})) END")))

# ------------------------------------------------------------ I4
reg("sma", ["sma"], q(cols(sma=when(29, f"avg(close) {W(29)}"))))
reg("minmax", ["minmax", "max", "min", "sum"], q(cols(
    minmax_min=when(29, f"min(close) {W(29)}"), minmax_max=when(29, f"max(close) {W(29)}"),
    max=when(29, f"max(close) {W(29)}"), min=when(29, f"min(close) {W(29)}"),
    sum=when(29, f"sum(close) {W(29)}"))))
reg("midpoint", ["midpoint", "midprice"], q(cols(
    midpoint=when(13, f"(max(close) {W(13)} + min(close) {W(13)}) / 2"),
    midprice=when(13, f"(max(high) {W(13)} + min(low) {W(13)}) / 2"))))
reg("bbands", ["bbands", "stddev", "var"], q(cols(
    bbands_upperband=when(4, f"avg(close) {W(4)} + stddev_pop(close) {W(4)} * 2.0"),
    bbands_middleband=when(4, f"avg(close) {W(4)}"),
    bbands_lowerband=when(4, f"avg(close) {W(4)} - stddev_pop(close) {W(4)} * 2.0"),
    stddev=when(4, f"stddev_pop(close) {W(4)}"), var=when(4, f"var_pop(close) {W(4)}"))))

# ------------------------------------------------------------ I5
_UP = f"(14 - (rn - arg_max(rn, (high, rn)) {W(14)}))"
_DN = f"(14 - (rn - arg_min(rn, (low, -rn)) {W(14)}))"
reg("aroon", ["aroon", "aroonosc"], q(cols(
    aroon_aroondown=when(14, f"{D.format(_DN)} * 100.0 / 14"),
    aroon_aroonup=when(14, f"{D.format(_UP)} * 100.0 / 14"),
    aroonosc=when(14, f"{D.format(_UP)} * 100.0 / 14 - {D.format(_DN)} * 100.0 / 14"))))
reg("maxindex", ["maxindex", "minindex", "minmaxindex"], q(
    f"CAST({when(29, f'arg_max(rn, (close, rn)) {W(29)}')} AS BIGINT) AS maxindex, "
    f"CAST({when(29, f'arg_min(rn, (close, -rn)) {W(29)}')} AS BIGINT) AS minindex, "
    f"CAST({when(29, f'arg_min(rn, (close, -rn)) {W(29)}')} AS BIGINT) AS minmaxindex_minidx, "
    f"CAST({when(29, f'arg_max(rn, (close, rn)) {W(29)}')} AS BIGINT) AS minmaxindex_maxidx"))

# ------------------------------------------------------------ I6
reg("wma", ["wma"], q(cols(wma=when(29, f"list_sum(list_transform(range(1, 31), lambda i: "
                                        f"(list(close) {W(29)})[i] * i)) / 465.0"))))
reg("trima", ["trima"], q(cols(trima=when(29, f"avg(s15) {W(15)}")),
                          f"t AS (SELECT *, {when(14, f'avg(close) {W(14)}')} AS s15 FROM b)", "t"))

# ------------------------------------------------------------ I7
_SL = f"regr_slope(close, rn) {W(13)}"
_IC = f"regr_intercept(close, rn) {W(13)}"
reg("linreg", ["linearreg"], q(cols(
    linearreg=when(13, f"{_IC} + {_SL} * rn"), linearreg_slope=when(13, _SL),
    linearreg_intercept=when(13, f"{_IC} + {_SL} * (rn - 13)"),
    linearreg_angle=when(13, f"atan({_SL}) * (180.0 / pi())"),
    tsf=when(13, f"{_IC} + {_SL} * (rn + 1)"))))
_CR = f"corr(high, low) {W(29)}"
reg("correl", ["correl"], q(cols(correl=when(29, f"coalesce(CASE WHEN isnan({_CR}) THEN NULL ELSE {_CR} END, 0)"))))
_BETA_CTE = f"""r AS (SELECT *,
  CASE WHEN lag(high) {LAG} <> 0 THEN (high - lag(high) {LAG}) / lag(high) {LAG} ELSE 0.0 END AS x,
  CASE WHEN lag(low) {LAG} <> 0 THEN (low - lag(low) {LAG}) / lag(low) {LAG} ELSE 0.0 END AS y FROM b),
s AS (SELECT *, sum(x) {W(4)} AS sx, sum(y) {W(4)} AS sy, sum(x * x) {W(4)} AS sxx, sum(x * y) {W(4)} AS sxy FROM r)"""
reg("beta", ["beta"], q(cols(beta=when(5, sdiv("sxy * 5 - sx * sy", "sxx * 5 - sx * sx"))), _BETA_CTE, "s"))

# ------------------------------------------------------------ I8
_HH, _LL = f"max(high) {W(13)}", f"min(low) {W(13)}"
reg("willr", ["willr"], q(cols(willr=when(13, sdiv(f"({_HH} - close) * -100.0", f"{_HH} - {_LL}")))))
_CCI_CTE = f"""t AS (SELECT *, (high + low + close) / 3 AS tp FROM b),
m AS (SELECT *, avg(tp) {W(13)} AS m, list(tp) {W(13)} AS arr FROM t),
d AS (SELECT *, list_sum(list_transform(arr, lambda x: abs(x - m))) AS dev FROM m)"""
reg("cci", ["cci"], q(cols(cci=when(13, sdiv("tp - m", "dev / 14 * 0.015"))), _CCI_CTE, "d"))
_MFI_CTE = f"""t AS (SELECT *, (high + low + close) / 3 AS tp FROM b),
f AS (SELECT *, CASE WHEN tp > lag(tp) {LAG} THEN tp * volume ELSE 0.0 END AS pos,
  CASE WHEN tp < lag(tp) {LAG} THEN tp * volume ELSE 0.0 END AS neg FROM t),
s AS (SELECT *, sum(pos) {W(13)} AS p, sum(neg) {W(13)} AS n FROM f)"""
reg("mfi", ["mfi"], q(cols(mfi=when(14, "CASE WHEN p + n < 1.0 THEN 0.0 ELSE p * 100.0 / (p + n) END")),
                      _MFI_CTE, "s"))


def _fastk(k):
    hh, ll = f"max(high) {W(k)}", f"min(low) {W(k)}"
    return when(k, f"CASE WHEN {hh} - {ll} > 0 THEN (close - {ll}) * 100.0 / ({hh} - {ll}) ELSE 0.0 END")


_STOCH_CTE = f"""k AS (SELECT *, {_fastk(4)} AS fk FROM b),
sk AS (SELECT *, {when(6, f'avg(fk) {W(2)}')} AS slowk FROM k),
sd AS (SELECT *, {when(8, f'avg(slowk) {W(2)}')} AS slowd FROM sk)"""
reg("stoch", ["stoch", "stochf"], q(cols(
    stoch_slowk=when(8, "slowk"), stoch_slowd="slowd",
    stochf_fastk=when(6, "fk"), stochf_fastd=when(6, f"avg(fk) {W(2)}")), _STOCH_CTE, "sd"))
_ULT_CTE = f"""t AS (SELECT *, CASE WHEN {_C1} IS NOT NULL THEN close - least(low, {_C1}) END AS bp,
  CASE WHEN {_C1} IS NOT NULL THEN greatest(high, {_C1}) - least(low, {_C1}) END AS tr FROM b),
s AS (SELECT *, sum(bp) {W(6)} AS a7, sum(tr) {W(6)} AS b7, sum(bp) {W(13)} AS a14, sum(tr) {W(13)} AS b14,
  sum(bp) {W(27)} AS a28, sum(tr) {W(27)} AS b28 FROM t)"""
_U = " + ".join(f"CASE WHEN b{n} <> 0 THEN a{n} / b{n} * {w} ELSE 0.0 END" for n, w in ((7, 4.0), (14, 2.0), (28, 1.0)))
reg("ultosc", ["ultosc"], q(cols(ultosc=when(28, f"({_U}) * 100.0 / 7.0")), _ULT_CTE, "s"))
_F12, _S26 = f"avg(close) {W(11)}", f"avg(close) {W(25)}"
reg("apo", ["apo", "ppo"], q(cols(apo=when(25, f"{_F12} - {_S26}"),
                                  ppo=when(25, sdiv(f"({_F12} - {_S26}) * 100.0", _S26)))))
_MX_CTE = f"""m AS (SELECT *, {when(25, f'{_F12} - {_S26}')} AS mx FROM b),
s AS (SELECT *, {when(33, f'avg(mx) {W(8)}')} AS ms FROM m)"""
reg("macdext", ["macdext"], q(cols(macdext_macd=when(33, "mx"), macdext_macdsignal="ms",
                                   macdext_macdhist="mx - ms"), _MX_CTE, "s"))

# ------------------------------------------------------------ I9
reg("obv", ["obv"], q(cols(obv=f"sum(t) {RUN}"),
                      f"o AS (SELECT *, CASE WHEN rn = 0 THEN volume WHEN close > {_C1} THEN volume "
                      f"WHEN close < {_C1} THEN -volume ELSE 0.0 END AS t FROM b)", "o"))
reg("ad", ["ad"], q(cols(ad=f"sum(CASE WHEN high <> low THEN ((close - low) - (high - close)) / (high - low) * volume "
                           f"ELSE 0.0 END) {RUN}")))
