"""Registered recursive indicator queries (I10-I12) with recursive-CTE oracles.

The oracle walks each series row by row (``rn = r.rn + 1``), exactly the
sequential definition; the Spark side is the blocked affine scan.
"""

from __future__ import annotations

from pyspark.sql import functions as C

from ..operators.indicators import suite
from .inputs import event_bars
from .output import r6
from .q_indicators import BASE, LAG, W, _spark, sdiv, when
from .registry import register


def F(x: float) -> str:
    """Float literal with the exact double value Python uses."""
    return f"CAST({x!r} AS DOUBLE)"


def rec(name: str, src: str, seed_rn: int, cols: list[str]) -> str:
    """Recursive CTE: src has a_<c>, b_<c>, seed_<c>; y = a*y + b from the seed row."""
    init = ", ".join(f"seed_{c} AS {c}" for c in cols)
    step = ", ".join(f"x.a_{c} * r.{c} + x.b_{c} AS {c}" for c in cols)
    return f"""{name}(symbol, rn, {", ".join(cols)}) AS (
  SELECT symbol, rn, {init} FROM {src} WHERE rn = {seed_rn}
  UNION ALL
  SELECT x.symbol, x.rn, {step} FROM {name} r JOIN {src} x ON x.symbol = r.symbol AND x.rn = r.rn + 1)"""


def final(select: str, ctes: list[str], joins: list[str]) -> str:
    j = " ".join(f"LEFT JOIN {t} USING (symbol, rn)" for t in joins)
    return f"WITH RECURSIVE {BASE}, {', '.join(ctes)} SELECT symbol, ts, {select} FROM b {j}"


def reg(qname, names, sql):
    register(qname, sql)(_spark(names))


# --------------------------------------------------------------- EMA chains
def ema_chain(prefix: str, n: int, depth: int) -> list[str]:
    """CTEs {prefix}1..depth: EMA(n) of close, of that, ...; column e."""
    al = 2.0 / (n + 1)
    ctes = []
    for k in range(1, depth + 1):
        src = "b" if k == 1 else f"{prefix}{k - 1}"
        val = "close" if k == 1 else "e"
        seed_rn = k * (n - 1)
        ctes.append(f"""{prefix}x{k} AS (SELECT symbol, rn, {F(1 - al)} AS a_e, {val} * {F(al)} AS b_e,
  avg({val}) {W(n - 1)} AS seed_e FROM {src})""")
        ctes.append(rec(f"{prefix}{k}", f"{prefix}x{k}", seed_rn, ["e"]))
    return ctes


def _ema_sel(prefix, depth):
    return ", ".join(f"{prefix}{k}.e AS e{k}" for k in range(1, depth + 1))


def chain_query(select: str, depth: int, n: int = 30, prefix: str = "m") -> str:
    ctes = ema_chain(prefix, n, depth)
    j = " ".join(f"LEFT JOIN {prefix}{k} USING (symbol, rn)" for k in range(1, depth + 1))
    return (f"WITH RECURSIVE {BASE}, {', '.join(ctes)}, "
            f"z AS (SELECT b.*, {_ema_sel(prefix, depth)} FROM b {j}) SELECT symbol, ts, {select} FROM z")


reg("ema", ["ema"], chain_query(f"{r6('e1')} AS ema", 1))
reg("dema", ["dema"], chain_query(f"{r6(when(58, 'e1 * 2 - e2'))} AS dema", 2))
reg("tema", ["tema", "trix"], chain_query(
    f"{r6(when(87, 'e1 * 3 - e2 * 3 + e3'))} AS tema, "
    f"{r6(when(88, f'CASE WHEN lag(e3) {LAG} <> 0 THEN (e3 / lag(e3) {LAG} - 1) * 100 ELSE 0 END'))} AS trix", 3))

_v = 0.7
_c1, _c2 = -_v ** 3, 3 * _v ** 2 + 3 * _v ** 3
_c3, _c4 = -6 * _v ** 2 - 3 * _v - 3 * _v ** 3, 1 + 3 * _v + 3 * _v ** 2 + _v ** 3
reg("t3", ["t3"], chain_query(
    f"{r6(f'e6 * {F(_c1)} + e5 * {F(_c2)} + e4 * {F(_c3)} + e3 * {F(_c4)}')} AS t3", 6, n=5, prefix="t"))


# ----------------------------------------------------------------- MACD
def macd_sql(nm: str, fa: float, sa: float) -> str:
    ctes = [
        f"""x1 AS (SELECT symbol, rn, {F(1 - fa)} AS a_f, close * {F(fa)} AS b_f, avg(close) {W(11)} AS seed_f,
  {F(1 - sa)} AS a_s, close * {F(sa)} AS b_s, avg(close) {W(25)} AS seed_s FROM b)""",
        rec("r1", "x1", 25, ["f", "s"]),
        f"""l AS (SELECT symbol, rn, f - s AS line FROM r1)""",
        f"""x2 AS (SELECT symbol, rn, {F(1 - 0.2)} AS a_g, line * {F(0.2)} AS b_g, avg(line) {W(8)} AS seed_g FROM l)""",
        rec("r2", "x2", 33, ["g"]),
    ]
    sel = (f"{r6(when(33, 'line'))} AS {nm}_macd, {r6(when(33, 'g'))} AS {nm}_macdsignal, "
           f"{r6(when(33, 'line - g'))} AS {nm}_macdhist")
    return final(sel, ctes, ["l", "r2"])


reg("macd", ["macd"], macd_sql("macd", 2.0 / 13, 2.0 / 27))
reg("macdfix", ["macdfix"], macd_sql("macdfix", 0.15, 0.075))

# ------------------------------------------------------------------ RSI
_CHG = f"close - lag(close) {LAG}"
_RSI_CTES = [
    f"""c AS (SELECT symbol, rn, greatest({_CHG}, 0.0) AS up, greatest(-({_CHG}), 0.0) AS dn FROM b)""",
    f"""x AS (SELECT symbol, rn, {F(13 / 14)} AS a_u, up / 14 AS b_u, avg(up) {W(13)} AS seed_u,
  {F(13 / 14)} AS a_d, dn / 14 AS b_d, avg(dn) {W(13)} AS seed_d FROM c)""",
    rec("r", "x", 14, ["u", "d"]),
    f"""s AS (SELECT symbol, rn, {sdiv('u * 100.0', 'u + d')} AS rsi, {sdiv('(u - d) * 100.0', 'u + d')} AS cmo FROM r)""",
    f"""k AS (SELECT symbol, rn, rsi, cmo, {when(18, f"CASE WHEN max(rsi) {W(4)} - min(rsi) {W(4)} > 0 THEN "
                                                  f"(rsi - min(rsi) {W(4)}) * 100.0 / (max(rsi) {W(4)} - min(rsi) {W(4)}) "
                                                  f"ELSE 0.0 END")} AS fk FROM s)""",
    f"""kd AS (SELECT symbol, rn, rsi, cmo, fk, {when(20, f'avg(fk) {W(2)}')} AS fd FROM k)""",
]
reg("rsi", ["rsi", "cmo", "stochrsi"], final(
    f"{r6('rsi')} AS rsi, {r6('cmo')} AS cmo, {r6(when(20, 'fk'))} AS stochrsi_fastk, {r6('fd')} AS stochrsi_fastd",
    _RSI_CTES, ["kd"]))

# ------------------------------------------------------------------ ATR
_C1 = f"lag(close) {LAG}"
_TR = f"CASE WHEN {_C1} IS NOT NULL THEN greatest(high - low, abs(high - {_C1}), abs(low - {_C1})) END"
reg("atr", ["atr", "natr"], final(
    f"{r6('atr')} AS atr, {r6(sdiv('atr * 100.0', 'close'))} AS natr",
    [f"t AS (SELECT symbol, rn, {_TR} AS tr FROM b)",
     f"x AS (SELECT symbol, rn, {F(13 / 14)} AS a_atr, tr / 14 AS b_atr, avg(tr) {W(13)} AS seed_atr FROM t)",
     rec("r", "x", 14, ["atr"])], ["r"]))

# --------------------------------------------------------------- ADX family
_ADX_CTES = [
    f"""d0 AS (SELECT symbol, rn, {_TR} AS tr, high - lag(high) {LAG} AS p0, lag(low) {LAG} - low AS m0 FROM b)""",
    """d1 AS (SELECT symbol, rn, tr, CASE WHEN p0 > m0 AND p0 > 0 THEN p0 ELSE 0.0 END AS pdm,
  CASE WHEN m0 > p0 AND m0 > 0 THEN m0 ELSE 0.0 END AS mdm FROM d0)""",
    f"""x AS (SELECT symbol, rn, {F(1 - 1 / 14)} AS a_p, pdm AS b_p, sum(pdm) {W(12)} AS seed_p,
  {F(1 - 1 / 14)} AS a_m, mdm AS b_m, sum(mdm) {W(12)} AS seed_m,
  {F(1 - 1 / 14)} AS a_t, tr AS b_t, sum(tr) {W(12)} AS seed_t FROM d1)""",
    rec("r", "x", 13, ["p", "m", "t"]),
    f"""di AS (SELECT symbol, rn, p, m, {when(14, sdiv('p * 100.0', 't'))} AS pdi,
  {when(14, sdiv('m * 100.0', 't'))} AS mdi FROM r)""",
    f"""dx AS (SELECT *, {when(14, sdiv('abs(pdi - mdi) * 100.0', 'pdi + mdi'))} AS dx FROM di)""",
    f"""x2 AS (SELECT symbol, rn, {F(13 / 14)} AS a_adx, dx / 14 AS b_adx, avg(dx) {W(13)} AS seed_adx FROM dx)""",
    rec("r2", "x2", 27, ["adx"]),
    f"""ax AS (SELECT symbol, rn, adx, {when(40, f'(adx + lag(adx, 13) {LAG}) / 2')} AS adxr FROM r2)""",
]
reg("adx", ["plus_dm", "minus_dm", "plus_di", "minus_di", "dx", "adx", "adxr"], final(
    f"{r6('p')} AS plus_dm, {r6('m')} AS minus_dm, {r6('pdi')} AS plus_di, {r6('mdi')} AS minus_di, "
    f"{r6('dx')} AS dx, {r6('adx')} AS adx, {r6('adxr')} AS adxr", _ADX_CTES, ["dx", "ax"]))

# ------------------------------------------------------------------ KAMA
_FS = 2.0 / 3.0 - 2.0 / 31
_KAMA_CTES = [
    f"""k0 AS (SELECT symbol, rn, close, abs(close - lag(close) {LAG}) AS kd, close - lag(close, 30) {LAG} AS kc FROM b)""",
    f"""k1 AS (SELECT *, sum(kd) {W(29)} AS s FROM k0)""",
    f"""k2 AS (SELECT *, CASE WHEN s <= kc OR s = 0 THEN 1.0 ELSE abs(kc / s) END AS er FROM k1)""",
    f"""k3 AS (SELECT *, (er * {F(_FS)} + {F(2.0 / 31)}) * (er * {F(_FS)} + {F(2.0 / 31)}) AS sc FROM k2)""",
    """x AS (SELECT symbol, rn, 1 - sc AS a_k, sc * close AS b_k, close AS seed_k FROM k3)""",
    rec("r", "x", 29, ["k"]),
]
reg("kama", ["kama"], final(f"{r6(when(30, 'k'))} AS kama", _KAMA_CTES, ["r"]))

# ----------------------------------------------------------------- ADOSC
_AD = ("sum(CASE WHEN high <> low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0.0 END) "
       "OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
_ADOSC_CTES = [
    f"a AS (SELECT symbol, rn, {_AD} AS ad FROM b)",
    f"""x AS (SELECT symbol, rn, {F(1 - 2 / 4)} AS a_f, ad * {F(2 / 4)} AS b_f, ad AS seed_f,
  {F(1 - 2 / 11)} AS a_s, ad * {F(2 / 11)} AS b_s, ad AS seed_s FROM a)""",
    rec("r", "x", 0, ["f", "s"]),
]
reg("adosc", ["adosc"], final(f"{r6(when(9, 'f - s'))} AS adosc", _ADOSC_CTES, ["r"]))


# ------------------------------------------------------------- series with gaps
def _gappy(names):
    """Hour bars whose close is missing in the hours 5, 13 and 21."""
    def run(spark, sf):
        b = event_bars(spark, sf)
        b = b.withColumn("close", C.when(C.hour("ts") % 8 != 5, C.col("close")))
        return suite.add_indicators(b, names).select("symbol", "ts", *[o for n in names for o in suite.outputs(n)])
    return run


_GAPPY = BASE.replace("SELECT *,", "SELECT * REPLACE (CASE WHEN hour(ts) % 8 <> 5 THEN close END AS close),")


def rec_gaps(name: str, src: str, seed_rn: int, cols: list[str]) -> str:
    """``rec`` that carries the state over rows without a value."""
    step = ", ".join(f"CASE WHEN x.b_{c} IS NULL THEN r.{c} ELSE x.a_{c} * r.{c} + x.b_{c} END AS {c}" for c in cols)
    init = ", ".join(f"seed_{c} AS {c}" for c in cols)
    return f"""{name}(symbol, rn, {", ".join(cols)}) AS (
  SELECT symbol, rn, {init} FROM {src} WHERE rn = {seed_rn}
  UNION ALL
  SELECT x.symbol, x.rn, {step} FROM {name} r JOIN {src} x ON x.symbol = r.symbol AND x.rn = r.rn + 1)"""


_AL = 2.0 / 31
register("ema_with_gaps", f"""
WITH RECURSIVE {_GAPPY}, x AS (SELECT symbol, rn, {F(1 - _AL)} AS a_e, close * {F(_AL)} AS b_e, avg(close) {W(29)} AS seed_e FROM b),
{rec_gaps('r', 'x', 29, ['e'])}
SELECT symbol, ts, {r6('CASE WHEN rn = 29 OR close IS NOT NULL THEN e END')} AS ema FROM b LEFT JOIN r USING (symbol, rn)""")(_gappy(["ema"]))

_PART = "CASE WHEN {0} IS NOT NULL THEN greatest({0}, 0.0) END"
register("rsi_with_gaps", f"""
WITH RECURSIVE {_GAPPY}, c0 AS (SELECT symbol, rn, {_CHG} AS chg FROM b),
c AS (SELECT symbol, rn, {_PART.format('chg')} AS up, {_PART.format('(-chg)')} AS dn FROM c0),
x AS (SELECT symbol, rn, up, {F(13 / 14)} AS a_u, up / 14 AS b_u, avg(up) {W(13)} AS seed_u,
  {F(13 / 14)} AS a_d, dn / 14 AS b_d, avg(dn) {W(13)} AS seed_d FROM c),
{rec_gaps('r', 'x', 14, ['u', 'd'])},
s AS (SELECT symbol, rn, CASE WHEN rn = 14 OR up IS NOT NULL THEN u END AS u, CASE WHEN rn = 14 OR up IS NOT NULL THEN d END AS d
  FROM r JOIN x USING (symbol, rn))
SELECT symbol, ts, {r6(sdiv('u * 100.0', 'u + d'))} AS rsi, {r6(sdiv('(u - d) * 100.0', 'u + d'))} AS cmo
FROM b LEFT JOIN s USING (symbol, rn)""")(_gappy(["rsi", "cmo"]))
