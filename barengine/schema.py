"""Fixed schemas of the bar store and names shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Tick rows after an adapter: one trade/quote per row, total order (ts, seq).
TICKS = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("size", T.DoubleType(), True),
])

# Bar rows: one (symbol, ts) per bar; volume and adj_close optional.
BARS = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("open", T.DoubleType(), True),
    T.StructField("high", T.DoubleType(), True),
    T.StructField("low", T.DoubleType(), True),
    T.StructField("close", T.DoubleType(), True),
    T.StructField("volume", T.DoubleType(), True),
])

OHLCV = ("open", "high", "low", "close", "volume")
KEY = ("symbol",)

# Fixed values of the reference pipeline.
INTERVAL_CODES = {"minute": "1m", "hour": "1h", "day": "1d"}
MAX_MINUTE_SPAN_DAYS = 8          # download chunk length
MINUTE_LOOKBACK_DAYS = 30         # start clamp for minute data
COMPACT_AFTER_DAYS = 90           # minute rows older than this become 5-minute bars
TRADING_DAYS = 252
SLIPPAGE = 0.0005
COMMISSION = 0.0004
START_CASH = 10_000.0
SCORE_KEEP = 0.6
