"""Registered feature queries: F1-F5, J2-J4, J7, J9, W8, A17, A19."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, calendar, embeddings, quality, series
from ..sources import adapters
from ..operators import labels as L
from ..operators import price_action as PA
from . import sql as S
from .inputs import event_bars, order_bars
from .output import r6
from .registry import register

_H = S.hour_bars()


@register("price_action", f"""
SELECT symbol, ts,
  {r6('high - greatest(open, close)')} AS wick_upper,
  {r6('least(open, close) - low')} AS wick_lower,
  {r6('(high - greatest(open, close)) / nullif(high - low, 0)')} AS wick_ratio_upper,
  {r6('(least(open, close) - low) / nullif(high - low, 0)')} AS wick_ratio_lower
FROM ({_H}) b""")
def price_action(spark, sf):
    b = event_bars(spark, sf)
    return b.select("symbol", "ts", *[c.alias(n) for n, c in PA.price_action_columns().items()])


@register("calendar_features", f"""
SELECT symbol, ts, CAST(isodow(ts) - 1 AS BIGINT) AS weekday,
  CAST(CASE WHEN CAST(ts AS DATE) = last_day(ts) THEN 1 ELSE 0 END AS BIGINT) AS month_end
FROM ({S.bars('1 day', S.TICKS_ORDERS)}) b""")
def calendar_features(spark, sf):
    """F3, F4 on daily order bars (six years: every month end occurs)."""
    b = order_bars(spark, sf)
    return b.select("symbol", "ts", *[c.alias(n) for n, c in calendar.calendar_columns().items()])


_CLOSED = " OR ".join(f"(month(d) = {m} AND day(d) = {dd})" for m, dd in calendar.FIXED_CLOSURES)
_CAL_SQL = f"""
b AS ({_H}),
bounds AS (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM b),
days AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d
         FROM bounds),
cal AS (SELECT d AS trade_date FROM days WHERE isodow(d) < 6 AND NOT ({_CLOSED}))"""


@register("holiday_flag", f"""
WITH {_CAL_SQL}
SELECT b.symbol, b.ts, CAST(CASE WHEN c.trade_date IS NULL THEN 1 ELSE 0 END AS BIGINT) AS holiday_flag
FROM b LEFT JOIN cal c ON CAST(b.ts AS DATE) = c.trade_date""")
def holiday_flag(spark, sf):
    """J4 with a rule calendar (weekdays minus fixed closures) over the bars' own range."""
    b = event_bars(spark, sf).select("symbol", "ts")
    return calendar.holiday_flag(b, calendar.rule_calendar(b))


@register("session_filter", f"""
WITH {_CAL_SQL}
SELECT b.symbol, b.ts, {r6('b.close')} AS close FROM b
WHERE CAST(b.ts AS DATE) IN (SELECT trade_date FROM cal)""")
def session_filter(spark, sf):
    """J4 as a filter: bars on session days only (semi join)."""
    b = event_bars(spark, sf).select("symbol", "ts", "close")
    return calendar.session_filter(b, calendar.rule_calendar(b))


@register("distinct_sessions", f"""
SELECT CAST(o_orderdate AS DATE) AS trade_date, count(*) AS n_orders FROM orders GROUP BY 1""")
def distinct_sessions(spark, sf):
    """Dates with orders, and how many (the order calendar)."""
    t = adapters.ticks_orders(spark, sf)
    return t.groupBy(calendar.trade_date().alias("trade_date")).agg(F.count(F.lit(1)).alias("n_orders"))


@register("index_bounds", f"""
SELECT symbol, min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date
FROM ({S.bars('1 day', S.TICKS_ORDERS)}) b GROUP BY symbol""")
def index_bounds(spark, sf):
    return calendar.index_bounds(order_bars(spark, sf), ["symbol"])


# Fixed configuration: the tickers a load expects (two of them never occur).
CONFIGURED = ["click", "error", "login", "purchase", "refund", "signup", "view"]
_CFG_SQL = ", ".join(f"('{t}')" for t in CONFIGURED)


@register("missing_symbols", f"""
SELECT c.symbol FROM (VALUES {_CFG_SQL}) c(symbol)
WHERE c.symbol NOT IN (SELECT DISTINCT event_type FROM events)""")
def missing_symbols(spark, sf):
    """Configured tickers that produced no bars (anti join)."""
    cfg = spark.createDataFrame([(t,) for t in CONFIGURED], "symbol string")
    return quality.missing_symbols(cfg, event_bars(spark, sf))


_EXO = "purchase"


@register("asof_spread", f"""
WITH l AS ({_H}),
r AS (SELECT * FROM ({S.bars('5 minutes')}) x WHERE symbol = '{_EXO}')
SELECT l.symbol, l.ts, {r6('l.close')} AS close, {r6('r.close')} AS exo_close, r.ts AS exo_ts,
       {r6('l.close - r.close')} AS exo_spread
FROM l ASOF LEFT JOIN r ON l.ts >= r.ts""")
def asof_spread(spark, sf):
    """J2 + J3: hour bars against the newest 5-minute 'purchase' bar at or before each hour."""
    left = event_bars(spark, sf).select("symbol", "ts", "close")
    exo = event_bars(spark, sf, "5 minutes").where(F.col("symbol") == _EXO).select("ts", "close")
    return asof.exogenous_spread(left, exo).select("symbol", "ts", "close", "exo_close", "exo_ts", "exo_spread")


@register("asof_ticks_hot_key", f"""
WITH l AS (SELECT CASE WHEN symbol IN ('click', 'view') THEN 'hot' ELSE symbol END AS k, symbol, ts, close FROM ({_H}) h),
r AS (SELECT CASE WHEN symbol IN ('click', 'view') THEN 'hot' ELSE symbol END AS k, tick_ts, max(seq) AS seq, arg_max(price, seq) AS price
  FROM ({S.TICKS_EVENTS}) t GROUP BY ALL)
SELECT l.symbol, l.ts, {r6('l.close')} AS close, {r6('r.price')} AS last_price, r.seq AS last_seq, r.tick_ts AS last_ts
FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.ts >= r.tick_ts""")
def asof_ticks_hot_key(spark, sf):
    """Hour bars against the newest tick of their key; one key has the ticks of two symbols."""
    k = F.when(F.col("symbol").isin("click", "view"), "hot").otherwise(F.col("symbol")).alias("k")
    left = event_bars(spark, sf).select("symbol", "ts", "close", k)
    ticks = adapters.ticks_events(spark, sf).select(k, "ts", "seq", "price")
    return asof.asof_join(left, ticks, by=["k"], values=("price", "seq"), prefix="last_", order=("seq",)).drop("k")


_MAP = [("click", "purchase"), ("view", "purchase"), ("signup", "error")]
_MAP_SQL = ", ".join(f"('{a}', '{b}')" for a, b in _MAP)


@register("asof_mapped_spread", f"""
WITH l AS (SELECT b.*, m.exo_symbol FROM ({_H}) b LEFT JOIN (VALUES {_MAP_SQL}) m(symbol, exo_symbol) USING (symbol)),
r AS ({_H})
SELECT l.symbol, l.ts, l.exo_symbol, {r6('r.close')} AS exo_close, r.ts AS exo_ts,
       {r6('l.close - r.close')} AS exo_spread
FROM l ASOF LEFT JOIN r ON l.exo_symbol = r.symbol AND l.ts >= r.ts""")
def asof_mapped_spread(spark, sf):
    """J7 + J2: each symbol against its own exogenous series (some have none)."""
    mapping = spark.createDataFrame(_MAP, "symbol string, exo_symbol string")
    bars = event_bars(spark, sf)
    left = asof.map_exogenous(bars.select("symbol", "ts", "close"), mapping)
    right = bars.select(F.col("symbol").alias("exo_symbol"), "ts", "close")
    j = asof.exogenous_spread(left, right, by=["exo_symbol"])
    return j.select("symbol", "ts", "exo_symbol", "exo_close", "exo_ts", "exo_spread")


def _embedding_sql(n: int) -> str:
    return f"""
WITH r AS (SELECT symbol, ts,
    coalesce(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1, 0) AS ret FROM ({_H}) b),
e AS (SELECT symbol, ts, list(ret) OVER w AS arr, avg(ret) OVER w AS m, stddev_pop(ret) OVER w AS sd,
        count(*) OVER w AS n FROM r
      WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
v AS (SELECT symbol, ts, CASE WHEN n < {n} THEN list_transform(range({n}), lambda i: CAST(NULL AS DOUBLE))
        ELSE list_transform(arr, lambda x: (x - m) / CASE WHEN sd IS NULL OR isnan(sd) OR sd = 0 THEN 1 ELSE sd END)
        END AS emb FROM e)
SELECT symbol, ts, CAST(generate_subscripts(emb, 1) - 1 AS BIGINT) AS pos, {r6('unnest(emb)')} AS value FROM v"""


def _embedding(spark, sf, n):
    b = event_bars(spark, sf).select("symbol", "ts", "close")
    d = series.number_rows(b, ["symbol"])
    stages = [lambda w: {"ret": L.simple_return(w)},
              lambda w: {"emb": embeddings.window_embedding("ret", n, w)}]
    e = series.staged(d, ["symbol"], stages, back=n, numbered=True)
    return e.select("symbol", "ts", F.posexplode("emb").alias("pos", "value"))


@register("embedding_32", _embedding_sql(32))
def embedding_32(spark, sf):
    """32-return embeddings, one row per (bar, position)."""
    return _embedding(spark, sf, 32)


@register("embedding_64", _embedding_sql(64))
def embedding_64(spark, sf):
    return _embedding(spark, sf, 64)


@register("latest_bars", f"""
WITH b AS ({_H}),
r AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rank,
        sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS s FROM b)
SELECT symbol, ts, {r6('close')} AS close, CAST(rank AS BIGINT) AS rank,
  CASE WHEN s > 0 THEN 'BUY' WHEN s < 0 THEN 'SELL' ELSE 'HOLD' END AS side
FROM r WHERE rank <= 5""")
def latest_bars(spark, sf):
    """W13 + P12 + O7: the newest five bars per symbol with a BUY/SELL side
    (sign of the last change); per-symbol top-5 (the limit is the feature)."""
    from ..operators.leaderboard import side_label, top_n_per_group
    b = event_bars(spark, sf).select("symbol", "ts", "close")
    d = series.with_series_columns(b, ["symbol"], lambda w: {"signal": F.signum(F.col("close") - F.lag("close").over(w))},
                                   back=1).drop(series.RN)
    return top_n_per_group(d, ["symbol"], F.col("ts").desc(), 5).select(
        "symbol", "ts", "close", "rank", side_label().alias("side"))


@register("latest_price_lookup", f"""
WITH b AS ({_H}), c AS (SELECT * FROM (VALUES ('click'), ('view'), ('refund')) c(symbol))
SELECT c.symbol, x.ts, {r6('x.close')} AS close FROM c LEFT JOIN
  (SELECT symbol, arg_max(ts, ts) AS ts, arg_max(close, ts) AS close FROM b GROUP BY symbol) x USING (symbol)""")
def latest_price_lookup(spark, sf):
    """J10 + W13: the chosen symbols' newest bar (max_by per symbol, then an
    equi-join; a symbol without bars keeps NULLs)."""
    from ..operators.leaderboard import latest_per_symbol
    chosen = spark.createDataFrame([("click",), ("view",), ("refund",)], "symbol string")
    last = latest_per_symbol(event_bars(spark, sf).select("symbol", "ts", "close"))
    return chosen.join(last, "symbol", "left")


@register("load_report", f"""
SELECT c.symbol, CAST(coalesce(n, 0) AS BIGINT) AS rows, CASE WHEN n IS NULL THEN 'empty' ELSE 'ok' END AS status
FROM (VALUES {_CFG_SQL}) c(symbol) LEFT JOIN (SELECT symbol, count(*) AS n FROM ({_H}) b GROUP BY symbol) x USING (symbol)""")
def load_report(spark, sf):
    """Bars per configured ticker; empty tickers flagged (the reference
    raises for them; ``quality.non_empty_or_fail`` does that)."""
    cfg = spark.createDataFrame([(t,) for t in CONFIGURED], "symbol string")
    return quality.load_report(cfg, event_bars(spark, sf))
