"""Indicators by name, all in as few passes as possible.

``add_indicators(bars, names)`` puts every finite-frame indicator into one
blocked window pass (one exchange, one sort: stage i of all indicators is
one ``select``), the cumulative ones into one ``running`` pass, and the
recursive ones into affine-scan passes. Volume indicators are left out when
the bars have no volume column, as the reference's loop skips functions
that fail.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import series
from . import candles, cumulative, pointwise, rolling
from .base import Ctx, Indicator

FINITE: dict[str, Indicator] = {i.name: i for i in pointwise.ALL + rolling.ALL + candles.ALL}


def _recursive():
    from . import recursive
    return recursive.REGISTRY


def available(has_volume: bool = True) -> list[str]:
    names = [n for n, i in FINITE.items() if has_volume or not i.volume]
    names += list(cumulative.NAMES) if has_volume else []
    names += [n for n, i in _recursive().items() if has_volume or not i.volume]
    return names


def outputs(name: str) -> list[str]:
    if name in FINITE:
        return FINITE[name].outputs
    if name in cumulative.NAMES:
        return [name]
    return _recursive()[name].outputs


def indicator(name: str) -> Indicator:
    """The spec of one indicator by name."""
    return FINITE[name] if name in FINITE else _recursive()[name]


def add_indicators(bars: DataFrame, names: Sequence[str] | None = None,
                   keys: Sequence[str] = ("symbol",), numbered: bool = False) -> DataFrame:
    """``bars`` with the outputs of the named indicators (all by default). With ``numbered`` the bars
    have their position ``_rn`` already and keep it."""
    keys = list(keys)
    has_volume = "volume" in bars.columns
    names = list(names) if names is not None else available(has_volume)
    if not has_volume:
        names = [n for n in names if n in available(False)]
    d = bars if numbered else series.number_rows(bars, keys)
    fin = [FINITE[n] for n in names if n in FINITE]
    if fin:
        depth = max(len(i.stages) for i in fin)
        stages = []
        for k in range(depth):
            def st(w, k=k):
                ctx = Ctx(w)
                cols = {}
                for i in fin:
                    if k < len(i.stages):
                        cols.update(i.stages[k](ctx))
                return cols
            stages.append(st)
        d = series.staged(d, keys, stages, back=max(i.back for i in fin), numbered=True, keep_rn=True)
        d = d.drop(*[c for c in d.columns if c.startswith("_") and c != series.RN])
    cum = [n for n in names if n in cumulative.NAMES]
    if cum:
        if "obv" in cum:
            d = series.staged(d, keys, [lambda w: {"_obv_t": cumulative.obv_term(w)}], back=1,
                              numbered=True, keep_rn=True)
        specs = {}
        if "ad" in cum:
            specs["ad"] = ("sum", cumulative.ad_term())
        if "obv" in cum:
            specs["obv"] = ("sum", F.col("_obv_t"))
        d = series.running(d, keys, specs)
    rec = [n for n in names if n in _recursive()]
    if rec:
        from . import recursive
        d = recursive.add_recursive(d, rec, keys)
    drop = [c for c in d.columns if c.startswith("_") and not (numbered and c == series.RN)]
    return d.drop(*drop)
