"""Twins of registered queries whose plans use blocks of 128 rows.

The hour bars of the driver's tables have up to 720 rows per series, less than one block of
the default size. With 128 rows the same queries cross block borders (halos, carries, scan
levels); their oracles are those of the plain queries.
"""

from __future__ import annotations

from functools import wraps

from ..operators import series
from . import q_backtest, q_candles, q_features, q_indicators, q_labels, q_learn, q_recursive  # noqa: F401  (register the originals)
from .registry import ORACLES, QUERIES, QueryFn

BLOCK_ROWS = 128
TWINS = ("label_t3", "embedding_64", "linreg", "obv", "candles", "ema", "t3", "kama", "adx", "positions_fills",
         "equity_curve", "ema_with_gaps", "rsi_with_gaps", "asof_spread", "asof_ticks_hot_key", "cv_fold_metrics")


def _twin(fn: QueryFn) -> QueryFn:
    @wraps(fn)
    def run(spark, sf_dir):
        with series.block_size(BLOCK_ROWS):
            return fn(spark, sf_dir)
    return run


for _name in TWINS:
    QUERIES[f"{_name}_blocked"] = _twin(QUERIES[_name])
    ORACLES[f"{_name}_blocked"] = ORACLES[_name]
