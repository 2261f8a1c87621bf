"""Named queries over the driver's tables and their DuckDB oracles."""

from __future__ import annotations

from . import (q_backtest, q_bars, q_blocked, q_candles, q_features, q_indicators, q_io, q_labels, q_learn,  # noqa: F401
               q_load, q_recursive, q_stream)
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
