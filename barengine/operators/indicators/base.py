"""Indicator specs: named column builders over the blocked series window.

An indicator is a list of *stages*; each stage maps a ``Ctx`` to named
columns and may use the columns of earlier stages (names starting with ``_``
are intermediate and dropped). ``back`` is the number of rows behind the
current one that the whole chain reads; it sizes the halo of the blocked
layout. Output columns are NULL until the indicator's lookback is reached,
as in the public TA-Lib definitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..series import BLK, RN, _rows


class Ctx:
    """Window helpers for one blocked series window ``w`` (ordered by _rn)."""

    def __init__(self, w: Window):
        self.w = w

    def frame(self, n: int) -> Window:
        return self.w.rowsBetween(-(n - 1), 0)

    @staticmethod
    def ready(lookback: int) -> Column:
        """True from the first row with ``lookback`` rows before it."""
        return F.col(RN) >= lookback

    def roll(self, agg: Callable[[Column], Column], col: str | Column, n: int, lookback: int | None = None) -> Column:
        c = F.col(col) if isinstance(col, str) else col
        lb = n - 1 if lookback is None else lookback
        return F.when(self.ready(lb), agg(c).over(self.frame(n)))

    def sma(self, col, n, lookback=None):
        return self.roll(F.avg, col, n, lookback)

    def lag(self, col: str | Column, k: int = 1) -> Column:
        return F.lag(col, k).over(self.w)

    def local_x(self) -> Column:
        """Row position relative to the block: consecutive inside a block
        partition (halo rows get negative values), small numbers for
        regressions regardless of the series length."""
        return (F.col(RN) - F.col(BLK) * F.lit(_rows(None))).cast("double")

    def collect(self, col: str | Column, n: int) -> Column:
        return F.collect_list(col).over(self.frame(n))


Stage = Callable[[Ctx], dict[str, Column]]


@dataclass
class Indicator:
    name: str
    back: int
    stages: list[Stage]
    outputs: list[str]
    volume: bool = False
    group: str = ""
    doc: str = ""
    extra: dict = field(default_factory=dict)


def safe_div(n: Column, d: Column, zero: float | None = 0.0) -> Column:
    """n / d, or ``zero`` when d is 0 (the TA-Lib convention); NULL stays NULL."""
    return F.when(n.isNull() | d.isNull(), F.lit(None)).when(d != 0, n / d).otherwise(F.lit(zero))


def true_range(ctx: Ctx) -> Column:
    c1 = ctx.lag("close")
    return F.when(c1.isNotNull(), F.greatest(F.col("high") - F.col("low"),
                                             F.abs(F.col("high") - c1), F.abs(F.col("low") - c1)))
