"""Row-wise indicators (I1 price transforms, I2 math transforms)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import Indicator, safe_div



def _one(name: str, col_fn, group: str) -> Indicator:
    return Indicator(name, 0, [lambda ctx: {name: col_fn()}], [name], group=group)


PRICE = [
    _one("avgprice", lambda: (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4, "price"),
    _one("medprice", lambda: (F.col("high") + F.col("low")) / 2, "price"),
    _one("typprice", lambda: (F.col("high") + F.col("low") + F.col("close")) / 3, "price"),
    _one("wclprice", lambda: (F.col("high") + F.col("low") + F.col("close") * 2) / 4, "price"),
    _one("bop", lambda: safe_div(F.col("close") - F.col("open"), F.col("high") - F.col("low")), "price"),
]


def _domain(fn, lo=None, hi=None, positive=False) -> Column:
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col("close") >= lo)
    if hi is not None:
        cond = cond & (F.col("close") <= hi)
    if positive:
        cond = cond & (F.col("close") > 0)
    return F.when(cond, fn(F.col("close")))


# Out-of-domain inputs give NULL (rule N1: no NaN leaves the library).
MATH = [
    _one("acos", lambda: _domain(F.acos, -1, 1), "math"),
    _one("asin", lambda: _domain(F.asin, -1, 1), "math"),
    _one("atan", lambda: F.atan(F.col("close")), "math"),
    _one("ceil", lambda: F.ceil(F.col("close")).cast("double"), "math"),
    _one("cos", lambda: F.cos(F.col("close")), "math"),
    _one("cosh", lambda: F.cosh(F.col("close")), "math"),
    _one("exp", lambda: F.exp(F.col("close")), "math"),
    _one("floor", lambda: F.floor(F.col("close")).cast("double"), "math"),
    _one("ln", lambda: _domain(F.ln, positive=True), "math"),
    _one("log10", lambda: _domain(F.log10, positive=True), "math"),
    _one("sin", lambda: F.sin(F.col("close")), "math"),
    _one("sinh", lambda: F.sinh(F.col("close")), "math"),
    _one("sqrt", lambda: _domain(F.sqrt, lo=0), "math"),
    _one("tan", lambda: F.tan(F.col("close")), "math"),
    _one("tanh", lambda: F.tanh(F.col("close")), "math"),
    _one("add", lambda: F.col("high") + F.col("low"), "math"),
    _one("sub", lambda: F.col("high") - F.col("low"), "math"),
    _one("mult", lambda: F.col("high") * F.col("low"), "math"),
    _one("div", lambda: F.try_divide(F.col("high"), F.col("low")), "math"),
]

ALL = PRICE + MATH
