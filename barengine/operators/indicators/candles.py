"""Candle patterns (I13): one boolean window expression per pattern.

Shared parts per bar: real body |C-O|, range H-L, upper and lower shadow,
colour (+1 when C >= O, else -1). "Long", "short", "doji", "near" compare a
candle with the mean of the same measure over the candles before it, with
the public TA-Lib candle settings (measure, number of candles, factor):

  body long       real body,  10, 1.0     body very long  real body, 10, 3.0
  body short      real body,  10, 1.0     body doji       range,     10, 0.1
  shadow long     real body,   0, 1.0     shadow very long real body, 0, 2.0
  shadow very short range,    10, 0.1     near            range,      5, 0.2
  far             range,       5, 0.6     equal           range,      5, 0.05

  shadow short    both shadows, 10, 1.0 (halved: one shadow on average)
(0 candles = the candle's own real body.) Outputs are +100 (bullish) /
-100 (bearish) / 0; rows before a pattern's lookback are 0. All frames are
bounded (at most 14 rows back), so every pattern joins the single blocked
window pass of the indicator suite.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import Ctx, Indicator

# Candle settings (measure, candles averaged, factor).
SETTINGS = {
    "body_long": ("body", 10, 1.0), "body_very_long": ("body", 10, 3.0), "body_short": ("body", 10, 1.0),
    "body_doji": ("range", 10, 0.1), "shadow_long": ("body", 0, 1.0), "shadow_very_long": ("body", 0, 2.0),
    "shadow_very_short": ("range", 10, 0.1), "near": ("range", 5, 0.2), "far": ("range", 5, 0.6),
    "equal": ("range", 5, 0.05), "shadow_short": ("shadows", 10, 1.0),
}
_COL = {"body": "_cdl_body", "range": "_cdl_range", "shadows": "_cdl_sh"}


def _cached(fn):
    """Shared stages are built once per window context, not once per pattern."""
    def wrapper(ctx: Ctx) -> dict[str, Column]:
        key = f"_memo_{fn.__name__}"
        if not hasattr(ctx, key):
            setattr(ctx, key, fn(ctx))
        return getattr(ctx, key)
    wrapper.__name__ = fn.__name__
    return wrapper


@_cached
def _base(ctx: Ctx) -> dict[str, Column]:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {"_cdl_body": F.abs(c - o), "_cdl_range": h - lo,
            "_cdl_up": h - F.greatest(o, c), "_cdl_lo": F.least(o, c) - lo,
            "_cdl_col": F.when(c >= o, F.lit(1)).otherwise(F.lit(-1)),
            "_cdl_sh": (h - F.greatest(o, c)) + (F.least(o, c) - lo)}


_PARTS = {"o": "open", "h": "high", "l": "low", "c": "close", "body": "_cdl_body", "up": "_cdl_up",
          "lo": "_cdl_lo", "col": "_cdl_col"}
MAX_BACK = 5   # candles back any pattern looks at
MAX_AVG_K = 4  # candles back whose trailing average any pattern uses


def _avg_name(measure: str, n: int, k: int) -> str:
    return f"_cdl_a_{measure}{n}_{k}"


@_cached
def _prep(ctx: Ctx) -> dict[str, Column]:
    """Lags of the candle parts and the trailing averages, once for all
    patterns: the pattern expressions below are then plain column logic,
    so one window operator computes every input of every pattern."""
    out = {}
    for k in range(1, MAX_BACK + 1):
        for short, name in _PARTS.items():
            out[f"_cdl_{short}_{k}"] = F.lag(name, k).over(ctx.w)
    for measure, n in sorted({(m, n) for m, n, _ in SETTINGS.values() if n}):
        for k in range(MAX_AVG_K + 1):
            out[_avg_name(measure, n, k)] = F.avg(_COL[measure]).over(ctx.w.rowsBetween(-(k + n), -(k + 1)))
    return out


class _K:
    """Candle k bars back (0 = current) inside a pattern expression."""

    def __init__(self, ctx: Ctx, k: int):
        self.ctx, self.k = ctx, k

    def v(self, short: str) -> Column:
        return F.col(_PARTS[short]) if self.k == 0 else F.col(f"_cdl_{short}_{self.k}")

    o = property(lambda s: s.v("o"))
    h = property(lambda s: s.v("h"))
    l = property(lambda s: s.v("l"))  # noqa: E741
    c = property(lambda s: s.v("c"))
    body = property(lambda s: s.v("body"))
    up = property(lambda s: s.v("up"))
    lo = property(lambda s: s.v("lo"))
    col = property(lambda s: s.v("col"))
    top = property(lambda s: F.greatest(s.o, s.c))
    bot = property(lambda s: F.least(s.o, s.c))

    def avg(self, setting: str) -> Column:
        """factor × mean of the setting's measure over the candles before this one."""
        measure, n, factor = SETTINGS[setting]
        if n == 0:
            return self.body * factor
        a = F.col(_avg_name(measure, n, self.k)) * factor
        return a / 2 if measure == "shadows" else a


def _pattern(name: str, lookback: int, fn) -> Indicator:
    def st(ctx: Ctx) -> dict[str, Column]:
        out = fn(ctx, lambda k: _K(ctx, k))
        return {name: F.when(ctx.ready(lookback), F.coalesce(out, F.lit(0))).otherwise(F.lit(0))}
    return Indicator(name, max(lookback, MAX_BACK + 10), [_base, _prep, st], [name], group="candle")


def _doji(ctx, K):
    k = K(0)
    return F.when(k.body <= k.avg("body_doji"), 100).otherwise(0)


def _dragonfly(ctx, K):
    k = K(0)
    return F.when((k.body <= k.avg("body_doji")) & (k.up < k.avg("shadow_very_short"))
                  & (k.lo > k.avg("shadow_very_short")), 100).otherwise(0)


def _gravestone(ctx, K):
    k = K(0)
    return F.when((k.body <= k.avg("body_doji")) & (k.lo < k.avg("shadow_very_short"))
                  & (k.up > k.avg("shadow_very_short")), 100).otherwise(0)


def _longlegged(ctx, K):
    k = K(0)
    return F.when((k.body <= k.avg("body_doji")) & ((k.lo > k.avg("shadow_long")) | (k.up > k.avg("shadow_long"))),
                  100).otherwise(0)


def _marubozu(ctx, K):
    k = K(0)
    return F.when((k.body > k.avg("body_long")) & (k.up < k.avg("shadow_very_short"))
                  & (k.lo < k.avg("shadow_very_short")), k.col * 100).otherwise(0)


def _spinningtop(ctx, K):
    k = K(0)
    return F.when((k.body < k.avg("body_short")) & (k.up > k.body) & (k.lo > k.body), k.col * 100).otherwise(0)


def _engulfing(ctx, K):
    a, b = K(1), K(0)
    bull = (b.col == 1) & (a.col == -1) & (b.c > a.o) & (b.o < a.c)
    bear = (b.col == -1) & (a.col == 1) & (b.o > a.c) & (b.c < a.o)
    return F.when(bull, 100).when(bear, -100).otherwise(0)


def _hammer_shape(k):
    return (k.body < k.avg("body_short")) & (k.lo > k.avg("shadow_long")) & (k.up < k.avg("shadow_very_short"))


def _hammer(ctx, K):
    a, b = K(1), K(0)
    return F.when(_hammer_shape(b) & (b.bot <= a.l + a.avg("near")), 100).otherwise(0)


def _hangingman(ctx, K):
    a, b = K(1), K(0)
    return F.when(_hammer_shape(b) & (b.bot >= a.h - a.avg("near")), -100).otherwise(0)


def _star_shape(k):
    return (k.body < k.avg("body_short")) & (k.up > k.avg("shadow_long")) & (k.lo < k.avg("shadow_very_short"))


def _shootingstar(ctx, K):
    a, b = K(1), K(0)
    return F.when(_star_shape(b) & (b.bot > a.top), -100).otherwise(0)


def _invertedhammer(ctx, K):
    a, b = K(1), K(0)
    return F.when(_star_shape(b) & (b.top < a.bot), 100).otherwise(0)


def _harami(ctx, K):
    a, b = K(1), K(0)
    inside = (b.top < a.top) & (b.bot > a.bot)
    return F.when((a.body > a.avg("body_long")) & (b.body <= b.avg("body_short")) & inside,
                  -a.col * 100).otherwise(0)


def _piercing(ctx, K):
    a, b = K(1), K(0)
    cond = ((a.col == -1) & (a.body > a.avg("body_long")) & (b.col == 1) & (b.body > b.avg("body_long"))
            & (b.o < a.l) & (b.c < a.o) & (b.c > a.c + a.body * 0.5))
    return F.when(cond, 100).otherwise(0)


def _darkcloud(ctx, K):
    a, b = K(1), K(0)
    cond = ((a.col == 1) & (a.body > a.avg("body_long")) & (b.col == -1)
            & (b.o > a.h) & (b.c > a.o) & (b.c < a.c - a.body * 0.5))
    return F.when(cond, -100).otherwise(0)


def _morningstar(ctx, K, pen=0.3):
    a, m, b = K(2), K(1), K(0)
    cond = ((a.col == -1) & (a.body > a.avg("body_long")) & (m.body <= m.avg("body_short")) & (m.top < a.bot)
            & (b.col == 1) & (b.body > b.avg("body_short")) & (b.c > a.c + a.body * pen))
    return F.when(cond, 100).otherwise(0)


def _eveningstar(ctx, K, pen=0.3):
    a, m, b = K(2), K(1), K(0)
    cond = ((a.col == 1) & (a.body > a.avg("body_long")) & (m.body <= m.avg("body_short")) & (m.bot > a.top)
            & (b.col == -1) & (b.body > b.avg("body_short")) & (b.c < a.c - a.body * pen))
    return F.when(cond, -100).otherwise(0)


def _three_soldiers(ctx, K):
    x, y, z = K(2), K(1), K(0)
    cond = ((x.col == 1) & (y.col == 1) & (z.col == 1) & (y.c > x.c) & (z.c > y.c)
            & (y.o > x.o) & (y.o <= x.c) & (z.o > y.o) & (z.o <= y.c)
            & (x.up < x.avg("shadow_very_short")) & (y.up < y.avg("shadow_very_short"))
            & (z.up < z.avg("shadow_very_short")))
    return F.when(cond, 100).otherwise(0)


def _three_crows(ctx, K):
    w, x, y, z = K(3), K(2), K(1), K(0)
    cond = ((w.col == 1) & (x.col == -1) & (y.col == -1) & (z.col == -1)
            & (x.lo < x.avg("shadow_very_short")) & (y.lo < y.avg("shadow_very_short"))
            & (z.lo < z.avg("shadow_very_short"))
            & (y.o < x.o) & (y.o > x.c) & (z.o < y.o) & (z.o > y.c)
            & (w.h > x.c) & (x.c > y.c) & (y.c > z.c))
    return F.when(cond, -100).otherwise(0)


def _long_short(k, long_body: bool):
    body = (k.body > k.avg("body_long")) if long_body else (k.body < k.avg("body_short"))
    return body & (k.up < k.avg("shadow_short")) & (k.lo < k.avg("shadow_short"))


def _longline(ctx, K):
    k = K(0)
    return F.when(_long_short(k, True), k.col * 100).otherwise(0)


def _shortline(ctx, K):
    k = K(0)
    return F.when(_long_short(k, False), k.col * 100).otherwise(0)


def _highwave(ctx, K):
    k = K(0)
    return F.when((k.body < k.avg("body_short")) & (k.up > k.avg("shadow_very_long"))
                  & (k.lo > k.avg("shadow_very_long")), k.col * 100).otherwise(0)


def _rickshawman(ctx, K):
    k = K(0)
    mid = k.l + (k.h - k.l) / 2
    return F.when((k.body <= k.avg("body_doji")) & (k.lo > k.avg("shadow_long")) & (k.up > k.avg("shadow_long"))
                  & (k.bot <= mid + k.avg("near")) & (k.top >= mid - k.avg("near")), 100).otherwise(0)


def _takuri(ctx, K):
    k = K(0)
    return F.when((k.body <= k.avg("body_doji")) & (k.up < k.avg("shadow_very_short"))
                  & (k.lo > k.avg("shadow_very_long")), 100).otherwise(0)


def _closing_marubozu(ctx, K):
    k = K(0)
    close_side = F.when(k.col == 1, k.up).otherwise(k.lo)
    return F.when((k.body > k.avg("body_long")) & (close_side < k.avg("shadow_very_short")), k.col * 100).otherwise(0)


def _belthold(ctx, K):
    k = K(0)
    open_side = F.when(k.col == 1, k.lo).otherwise(k.up)
    return F.when((k.body > k.avg("body_long")) & (open_side < k.avg("shadow_very_short")), k.col * 100).otherwise(0)


def _dojistar(ctx, K):
    a, b = K(1), K(0)
    long1, doji = a.body > a.avg("body_long"), b.body <= b.avg("body_doji")
    return (F.when(long1 & doji & (a.col == 1) & (b.bot > a.top), -100)
            .when(long1 & doji & (a.col == -1) & (b.top < a.bot), 100).otherwise(0))


def _haramicross(ctx, K):
    a, b = K(1), K(0)
    return F.when((a.body > a.avg("body_long")) & (b.body <= b.avg("body_doji")) & (b.top < a.top) & (b.bot > a.bot),
                  -a.col * 100).otherwise(0)


def _maru(k):
    return (k.body > k.avg("body_long")) & (k.up < k.avg("shadow_very_short")) & (k.lo < k.avg("shadow_very_short"))


def _kicking(ctx, K):
    a, b = K(1), K(0)
    both = _maru(a) & _maru(b)
    return (F.when(both & (a.col == -1) & (b.col == 1) & (b.l > a.h), 100)
            .when(both & (a.col == 1) & (b.col == -1) & (b.h < a.l), -100).otherwise(0))


def _matchinglow(ctx, K):
    a, b = K(1), K(0)
    return F.when((a.col == -1) & (b.col == -1) & (b.c <= a.c + a.avg("equal")) & (b.c >= a.c - a.avg("equal")),
                  100).otherwise(0)


def _homingpigeon(ctx, K):
    a, b = K(1), K(0)
    return F.when((a.col == -1) & (b.col == -1) & (a.body > a.avg("body_long")) & (b.body <= b.avg("body_short"))
                  & (b.o < a.o) & (b.c > a.c), 100).otherwise(0)


def _neck(ctx, K, kind):
    a, b = K(1), K(0)
    base = (a.col == -1) & (a.body > a.avg("body_long")) & (b.col == 1) & (b.o < a.l)
    eq = a.avg("equal")
    if kind == "in":
        cond = (b.c <= a.c + eq) & (b.c >= a.c)
    elif kind == "on":
        cond = (b.c <= a.l + eq) & (b.c >= a.l - eq)
    else:  # thrusting
        cond = (b.c > a.c + eq) & (b.c <= a.c + a.body * 0.5)
    return F.when(base & cond, -100).otherwise(0)


def _counterattack(ctx, K):
    a, b = K(1), K(0)
    eq = a.avg("equal")
    return F.when((a.col == -b.col) & (a.body > a.avg("body_long")) & (b.body > b.avg("body_long"))
                  & (b.c <= a.c + eq) & (b.c >= a.c - eq), b.col * 100).otherwise(0)


def _separatinglines(ctx, K):
    a, b = K(1), K(0)
    eq = a.avg("equal")
    open_side = F.when(b.col == 1, b.lo).otherwise(b.up)
    return F.when((a.col == -b.col) & (b.o <= a.o + eq) & (b.o >= a.o - eq) & (b.body > b.avg("body_long"))
                  & (open_side < b.avg("shadow_very_short")), b.col * 100).otherwise(0)


def _three_inside(ctx, K):
    x, y, z = K(2), K(1), K(0)
    har = (x.body > x.avg("body_long")) & (y.body <= y.avg("body_short")) & (y.top < x.top) & (y.bot > x.bot)
    return (F.when(har & (x.col == -1) & (z.col == 1) & (z.c > x.o), 100)
            .when(har & (x.col == 1) & (z.col == -1) & (z.c < x.o), -100).otherwise(0))


def _three_outside(ctx, K):
    x, y, z = K(2), K(1), K(0)
    bull = (y.col == 1) & (x.col == -1) & (y.c > x.o) & (y.o < x.c) & (z.c > y.c)
    bear = (y.col == -1) & (x.col == 1) & (y.o > x.c) & (y.c < x.o) & (z.c < y.c)
    return F.when(bull, 100).when(bear, -100).otherwise(0)


def _two_crows(ctx, K):
    x, y, z = K(2), K(1), K(0)
    cond = ((x.col == 1) & (x.body > x.avg("body_long")) & (y.col == -1) & (y.bot > x.top)
            & (z.col == -1) & (z.o < y.o) & (z.o > y.c) & (z.c > x.o) & (z.c < x.c))
    return F.when(cond, -100).otherwise(0)


def _identical_three_crows(ctx, K):
    x, y, z = K(2), K(1), K(0)
    cond = ((x.col == -1) & (y.col == -1) & (z.col == -1)
            & (x.lo < x.avg("shadow_very_short")) & (y.lo < y.avg("shadow_very_short"))
            & (z.lo < z.avg("shadow_very_short")) & (x.c > y.c) & (y.c > z.c)
            & (y.o <= x.c + x.avg("equal")) & (y.o >= x.c - x.avg("equal"))
            & (z.o <= y.c + y.avg("equal")) & (z.o >= y.c - y.avg("equal")))
    return F.when(cond, -100).otherwise(0)


def _doji_star3(ctx, K, bull: bool, pen=0.3):
    a, m, b = K(2), K(1), K(0)
    if bull:
        cond = ((a.col == -1) & (a.body > a.avg("body_long")) & (m.body <= m.avg("body_doji")) & (m.top < a.bot)
                & (b.col == 1) & (b.body > b.avg("body_short")) & (b.c > a.c + a.body * pen))
        return F.when(cond, 100).otherwise(0)
    cond = ((a.col == 1) & (a.body > a.avg("body_long")) & (m.body <= m.avg("body_doji")) & (m.bot > a.top)
            & (b.col == -1) & (b.body > b.avg("body_short")) & (b.c < a.c - a.body * pen))
    return F.when(cond, -100).otherwise(0)


def _tristar(ctx, K):
    x, y, z = K(2), K(1), K(0)
    doji = (x.body <= x.avg("body_doji")) & (y.body <= x.avg("body_doji")) & (z.body <= x.avg("body_doji"))
    return (F.when(doji & (y.bot > x.top) & (z.top < y.top), -100)
            .when(doji & (y.top < x.bot) & (z.bot > y.bot), 100).otherwise(0))


def _upsidegap2crows(ctx, K):
    x, y, z = K(2), K(1), K(0)
    cond = ((x.col == 1) & (x.body > x.avg("body_long")) & (y.col == -1) & (y.body <= y.avg("body_short"))
            & (y.bot > x.top) & (z.col == -1) & (z.o > y.o) & (z.c < y.c) & (z.c > x.c))
    return F.when(cond, -100).otherwise(0)


def _three_line_strike(ctx, K):
    w, x, y, z = K(3), K(2), K(1), K(0)
    up = ((w.col == 1) & (x.col == 1) & (y.col == 1) & (x.c > w.c) & (y.c > x.c)
          & (z.col == -1) & (z.o > y.c) & (z.c < w.o))
    dn = ((w.col == -1) & (x.col == -1) & (y.col == -1) & (x.c < w.c) & (y.c < x.c)
          & (z.col == 1) & (z.o < y.c) & (z.c > w.o))
    return F.when(up, 100).when(dn, -100).otherwise(0)


def _abandoned_baby(ctx, K, pen=0.3):
    a, m, b = K(2), K(1), K(0)
    base = (a.body > a.avg("body_long")) & (m.body <= m.avg("body_doji")) & (b.body > b.avg("body_short"))
    bull = (a.col == -1) & (m.h < a.l) & (b.col == 1) & (b.l > m.h) & (b.c > a.c + a.body * pen)
    bear = (a.col == 1) & (m.l > a.h) & (b.col == -1) & (b.h < m.l) & (b.c < a.c - a.body * pen)
    return F.when(base & bull, 100).when(base & bear, -100).otherwise(0)


def _breakaway(ctx, K):
    v, w, x, y, z = K(4), K(3), K(2), K(1), K(0)
    long1 = v.body > v.avg("body_long")
    bull = (long1 & (v.col == -1) & (w.col == -1) & (w.top < v.bot) & (x.h < w.h) & (x.l < w.l)
            & (y.h < x.h) & (y.l < x.l) & (z.col == 1) & (z.c > w.top) & (z.c < v.bot))
    bear = (long1 & (v.col == 1) & (w.col == 1) & (w.bot > v.top) & (x.h > w.h) & (x.l > w.l)
            & (y.h > x.h) & (y.l > x.l) & (z.col == -1) & (z.c < w.bot) & (z.c > v.top))
    return F.when(bull, 100).when(bear, -100).otherwise(0)


def _conceal_baby_swallow(ctx, K):
    w, x, y, z = K(3), K(2), K(1), K(0)
    cond = ((w.col == -1) & (x.col == -1) & (y.col == -1) & (z.col == -1) & _maru(w) & _maru(x)
            & (y.o < x.c) & (y.h > x.c) & (z.h > y.h) & (z.l < y.l))
    return F.when(cond, 100).otherwise(0)


def _gap_side_side_white(ctx, K):
    x, y, z = K(2), K(1), K(0)
    pair = ((y.col == 1) & (z.col == 1) & (F.abs(z.body - y.body) < y.avg("near"))
            & (F.abs(z.o - y.o) < y.avg("equal")))
    return (F.when(pair & (y.bot > x.top) & (z.bot > x.top), 100)
            .when(pair & (y.top < x.bot) & (z.top < x.bot), -100).otherwise(0))


def _kicking_by_length(ctx, K):
    a, b = K(1), K(0)
    both = _maru(a) & _maru(b)
    longer = F.when(b.body > a.body, b.col).otherwise(a.col)
    return F.when(both & (a.col == -1) & (b.col == 1) & (b.l > a.h), longer * 100).when(
        both & (a.col == 1) & (b.col == -1) & (b.h < a.l), longer * 100).otherwise(0)


def _ladder_bottom(ctx, K):
    v, w, x, y, z = K(4), K(3), K(2), K(1), K(0)
    cond = ((v.col == -1) & (w.col == -1) & (x.col == -1) & (w.o < v.o) & (w.c < v.c) & (x.o < w.o) & (x.c < w.c)
            & (y.col == -1) & (y.up > y.avg("shadow_very_short")) & (z.col == 1) & (z.o > y.o) & (z.c > y.h))
    return F.when(cond, 100).otherwise(0)


def _mat_hold(ctx, K, pen=0.5):
    v, w, x, y, z = K(4), K(3), K(2), K(1), K(0)
    small = lambda k: k.body < k.avg("body_short")
    cond = ((v.col == 1) & (v.body > v.avg("body_long")) & small(w) & small(x) & small(y) & (w.col == -1)
            & (w.bot > v.top) & (F.least(x.bot, y.bot) > v.c - v.body * pen)
            & (z.col == 1) & (z.o > y.c) & (z.c > F.greatest(w.h, x.h, y.h)))
    return F.when(cond, 100).otherwise(0)


def _rise_fall_three(ctx, K):
    v, w, x, y, z = K(4), K(3), K(2), K(1), K(0)
    small = lambda k: k.body < k.avg("body_short")
    inside = lambda k: (k.top < v.h) & (k.bot > v.l)
    mid = small(w) & small(x) & small(y) & inside(w) & inside(x) & inside(y)
    rise = ((v.col == 1) & (v.body > v.avg("body_long")) & (w.col == -1) & (y.col == -1) & mid
            & (z.col == 1) & (z.body > z.avg("body_long")) & (z.o > y.c) & (z.c > v.c))
    fall = ((v.col == -1) & (v.body > v.avg("body_long")) & (w.col == 1) & (y.col == 1) & mid
            & (z.col == -1) & (z.body > z.avg("body_long")) & (z.o < y.c) & (z.c < v.c))
    return F.when(rise, 100).when(fall, -100).otherwise(0)


def _stalled(ctx, K):
    x, y, z = K(2), K(1), K(0)
    cond = ((x.col == 1) & (y.col == 1) & (z.col == 1) & (y.c > x.c) & (z.c > y.c)
            & (x.body > x.avg("body_long")) & (y.body > y.avg("body_long"))
            & (y.up < y.avg("shadow_very_short")) & (y.o > x.o) & (y.o <= x.c + x.avg("near"))
            & (z.body < z.avg("body_short")) & (z.o >= y.c - z.body - y.avg("near")))
    return F.when(cond, -100).otherwise(0)


def _stick_sandwich(ctx, K):
    x, y, z = K(2), K(1), K(0)
    eq = x.avg("equal")
    cond = ((x.col == -1) & (y.col == 1) & (z.col == -1) & (y.l > x.c)
            & (z.c <= x.c + eq) & (z.c >= x.c - eq))
    return F.when(cond, 100).otherwise(0)


def _tasuki_gap(ctx, K):
    x, y, z = K(2), K(1), K(0)
    near = F.abs(y.body - z.body) < y.avg("near")
    up = ((x.col == 1) & (y.col == 1) & (y.bot > x.top) & (z.col == -1) & (z.o < y.c) & (z.o > y.o)
          & (z.c < y.o) & (z.c > x.top) & near)
    dn = ((x.col == -1) & (y.col == -1) & (y.top < x.bot) & (z.col == 1) & (z.o < y.o) & (z.o > y.c)
          & (z.c > y.o) & (z.c < x.bot) & near)
    return F.when(up, 100).when(dn, -100).otherwise(0)


def _unique_three_river(ctx, K):
    x, y, z = K(2), K(1), K(0)
    cond = ((x.col == -1) & (x.body > x.avg("body_long")) & (y.col == -1) & (y.c > x.c) & (y.o <= x.o)
            & (y.l < x.l) & (z.col == 1) & (z.body < z.avg("body_short")) & (z.o > y.l) & (z.c < y.c))
    return F.when(cond, 100).otherwise(0)


def _xside_gap_three(ctx, K):
    x, y, z = K(2), K(1), K(0)
    up = ((x.col == 1) & (y.col == 1) & (y.bot > x.top) & (z.col == -1) & (z.o < y.c) & (z.o > y.o)
          & (z.c < x.c) & (z.c > x.o))
    dn = ((x.col == -1) & (y.col == -1) & (y.top < x.bot) & (z.col == 1) & (z.o < y.o) & (z.o > y.c)
          & (z.c > x.c) & (z.c < x.o))
    return F.when(up, 100).when(dn, -100).otherwise(0)


def _hikkake_flag(ctx: Ctx) -> dict[str, Column]:
    """+1 / -1 on the bar that breaks out of an inside bar falsely, else 0."""
    m, ins, b = _K(ctx, 2), _K(ctx, 1), _K(ctx, 0)
    inside = (ins.h < m.h) & (ins.l > m.l)
    return {"_cdl_hk": F.when(inside & (b.h < ins.h) & (b.l < ins.l), 1)
            .when(inside & (b.h > ins.h) & (b.l > ins.l), -1).otherwise(0)}


def _hikkake(ctx, K):
    """Inside bar, then a false breakout (±100); a close beyond the inside
    bar within the next three bars confirms it (±200) unless a newer
    pattern came first or an earlier close already confirmed it."""
    return _confirmed(ctx, K, "_cdl_hk")


def _advance_block(ctx, K):
    """Three rising white candles, each opening inside the body before,
    losing strength: shrinking bodies or long upper shadows."""
    x, y, z = K(2), K(1), K(0)
    rising = ((x.col == 1) & (y.col == 1) & (z.col == 1) & (y.c > x.c) & (z.c > y.c)
              & (y.o > x.o) & (y.o <= x.c) & (z.o > y.o) & (z.o <= y.c) & (x.body > x.avg("body_long")))
    weak = (((y.body < x.body) & (z.body < y.body)) | (y.up > y.avg("shadow_long")) | (z.up > z.avg("shadow_long")))
    return F.when(rising & weak, -100).otherwise(0)


def _three_stars_south(ctx, K):
    x, y, z = K(2), K(1), K(0)
    cond = ((x.col == -1) & (y.col == -1) & (z.col == -1) & (x.body > x.avg("body_long"))
            & (x.lo > x.avg("shadow_long")) & (y.body < x.body) & (y.o > x.c) & (y.o <= x.h) & (y.l > x.l)
            & (z.body < z.avg("body_short")) & (z.up < z.avg("shadow_very_short"))
            & (z.lo < z.avg("shadow_very_short")) & (z.l > y.l) & (z.h < y.h))
    return F.when(cond, 100).otherwise(0)


def _hikkake_mod_flag(ctx: Ctx) -> dict[str, Column]:
    """Two nested inside bars, the second closing near its low (bullish) or
    high (bearish), then a false breakout of the second: +1 / -1."""
    m, i1, i2, b = _K(ctx, 3), _K(ctx, 2), _K(ctx, 1), _K(ctx, 0)
    nested = (i1.h < m.h) & (i1.l > m.l) & (i2.h < i1.h) & (i2.l > i1.l)
    near = i2.avg("near")
    bull = nested & (i2.c <= i2.l + near) & (b.h < i2.h) & (b.l < i2.l)
    bear = nested & (i2.c >= i2.h - near) & (b.h > i2.h) & (b.l > i2.l)
    return {"_cdl_hkm": F.when(bull, 1).when(bear, -1).otherwise(0)}


def _confirmed(ctx, K, flag_col: str):
    flag = [F.col(flag_col)] + [F.lag(flag_col, j).over(ctx.w) for j in (1, 2, 3)]
    close = [F.col("close")] + [F.lag("close", j).over(ctx.w) for j in (1, 2)]
    out = F.when(flag[0] != 0, flag[0] * 100)
    for j in (1, 2, 3):
        hi, lo = K(j + 1).h, K(j + 1).l
        ok = F.lit(True)
        for k in range(1, j):
            ok = ok & (flag[k] == 0)
        bull = ok & (flag[j] == 1) & (close[0] > hi)
        bear = ok & (flag[j] == -1) & (close[0] < lo)
        for k in range(1, j):
            bull = bull & (close[k] <= hi)
            bear = bear & (close[k] >= lo)
        out = out.when(bull, 200).when(bear, -200)
    return out.otherwise(0)


ALL = [
    _pattern("cdldoji", 10, _doji),
    _pattern("cdldragonflydoji", 10, _dragonfly),
    _pattern("cdlgravestonedoji", 10, _gravestone),
    _pattern("cdllongleggeddoji", 10, _longlegged),
    _pattern("cdlmarubozu", 10, _marubozu),
    _pattern("cdlspinningtop", 10, _spinningtop),
    _pattern("cdlengulfing", 1, _engulfing),
    _pattern("cdlhammer", 11, _hammer),
    _pattern("cdlhangingman", 11, _hangingman),
    _pattern("cdlshootingstar", 11, _shootingstar),
    _pattern("cdlinvertedhammer", 11, _invertedhammer),
    _pattern("cdlharami", 11, _harami),
    _pattern("cdlpiercing", 11, _piercing),
    _pattern("cdldarkcloudcover", 11, _darkcloud),
    _pattern("cdlmorningstar", 12, _morningstar),
    _pattern("cdleveningstar", 12, _eveningstar),
    _pattern("cdl3whitesoldiers", 12, _three_soldiers),
    _pattern("cdl3blackcrows", 13, _three_crows),
    _pattern("cdllongline", 10, _longline),
    _pattern("cdlshortline", 10, _shortline),
    _pattern("cdlhighwave", 10, _highwave),
    _pattern("cdlrickshawman", 10, _rickshawman),
    _pattern("cdltakuri", 10, _takuri),
    _pattern("cdlclosingmarubozu", 10, _closing_marubozu),
    _pattern("cdlbelthold", 10, _belthold),
    _pattern("cdldojistar", 11, _dojistar),
    _pattern("cdlharamicross", 11, _haramicross),
    _pattern("cdlkicking", 11, _kicking),
    _pattern("cdlmatchinglow", 6, _matchinglow),
    _pattern("cdlhomingpigeon", 11, _homingpigeon),
    _pattern("cdlinneck", 11, lambda ctx, K: _neck(ctx, K, "in")),
    _pattern("cdlonneck", 11, lambda ctx, K: _neck(ctx, K, "on")),
    _pattern("cdlthrusting", 11, lambda ctx, K: _neck(ctx, K, "thrusting")),
    _pattern("cdlcounterattack", 11, _counterattack),
    _pattern("cdlseparatinglines", 11, _separatinglines),
    _pattern("cdl3inside", 12, _three_inside),
    _pattern("cdl3outside", 2, _three_outside),
    _pattern("cdl2crows", 12, _two_crows),
    _pattern("cdlidentical3crows", 12, _identical_three_crows),
    _pattern("cdlmorningdojistar", 12, lambda ctx, K: _doji_star3(ctx, K, True)),
    _pattern("cdleveningdojistar", 12, lambda ctx, K: _doji_star3(ctx, K, False)),
    _pattern("cdltristar", 12, _tristar),
    _pattern("cdlupsidegap2crows", 12, _upsidegap2crows),
    _pattern("cdl3linestrike", 3, _three_line_strike),
    _pattern("cdlabandonedbaby", 12, _abandoned_baby),
    _pattern("cdlbreakaway", 14, _breakaway),
    _pattern("cdlconcealbabyswall", 13, _conceal_baby_swallow),
    _pattern("cdlgapsidesidewhite", 7, _gap_side_side_white),
    _pattern("cdlkickingbylength", 11, _kicking_by_length),
    _pattern("cdlladderbottom", 14, _ladder_bottom),
    _pattern("cdlmathold", 14, _mat_hold),
    _pattern("cdlrisefall3methods", 14, _rise_fall_three),
    _pattern("cdlstalledpattern", 12, _stalled),
    _pattern("cdlsticksandwich", 7, _stick_sandwich),
    _pattern("cdltasukigap", 7, _tasuki_gap),
    _pattern("cdlunique3river", 12, _unique_three_river),
    _pattern("cdlxsidegap3methods", 2, _xside_gap_three),
    _pattern("cdladvanceblock", 12, _advance_block),
    _pattern("cdl3starsinsouth", 12, _three_stars_south),
    Indicator("cdlhikkakemod", MAX_BACK + 10, [_base, _prep, _hikkake_mod_flag,
                                               lambda ctx: {"cdlhikkakemod": F.when(ctx.ready(9), F.coalesce(
                                                   _confirmed(ctx, lambda k: _K(ctx, k), "_cdl_hkm"), F.lit(0)))
                                                   .otherwise(F.lit(0))}],
              ["cdlhikkakemod"], group="candle"),
    Indicator("cdlhikkake", MAX_BACK + 10, [_base, _prep, _hikkake_flag,
                                            lambda ctx: {"cdlhikkake": F.when(ctx.ready(5), F.coalesce(
                                                _hikkake(ctx, lambda k: _K(ctx, k)), F.lit(0))).otherwise(F.lit(0))}],
              ["cdlhikkake"], group="candle"),
]
