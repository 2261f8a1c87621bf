"""Operator unit tests: the reference's asserted behaviours and our fixtures
(FIXTURES.md parts 1 and 3), on small DataFrames."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from barengine.operators import asof, backtest, bars, calendar, embeddings, labels, learn, scan, series
from barengine.operators import price_action as PA
from barengine.operators.indicators import suite
from barengine.functions import scalar
from helpers import bars_df, close, col_list


def test_window_embedding_basic(spark):
    """Rows 1-2 missing, row 3 has 3 values, row 4 mean 0."""
    df = spark.createDataFrame([("A", datetime(2021, 1, i + 1), r) for i, r in enumerate([0.0, 0.1, -0.1, 0.2])],
                               "symbol string, ts timestamp, ret double")
    out = series.with_series_columns(df, ["symbol"], lambda w: {"e": embeddings.window_embedding("ret", 3, w)},
                                     back=2).orderBy("ts").select("e").collect()
    assert all(v is None for v in out[0].e) and all(v is None for v in out[1].e)
    assert len(out[2].e) == 3
    assert abs(sum(out[3].e) / 3) < 1e-12


def test_embedding_of_constant_series_is_zero(spark):
    """32 equal closes → std 0 is replaced by 1, all values 0."""
    df = bars_df(spark, [5.0] * 40)
    d = series.number_rows(df, ["symbol"])
    e = series.staged(d, ["symbol"], [lambda w: {"ret": labels.simple_return(w)},
                                      lambda w: {"e": embeddings.window_embedding("ret", 32, w)}], back=32,
                      numbered=True)
    last = e.orderBy(F.col("ts").desc()).first().e
    assert last == [0.0] * 32


def test_exogenous_spread(spark):
    """OHLC 1,2,3 daily, exogenous = 2 × → spread -1, -2, -3; rows kept."""
    b = bars_df(spark, [1.0, 2.0, 3.0])
    exo = bars_df(spark, [2.0, 4.0, 6.0]).select("ts", "close")
    out = asof.exogenous_spread(b, exo)
    assert col_list(out, "exo_spread") == [-1.0, -2.0, -3.0]


def test_asof_keeps_null_value_and_counts_equal_time(spark):
    """the matching right row has a NULL value → NULL is kept; equal ts matches."""
    left = spark.createDataFrame([("A", datetime(2021, 1, 2)), ("A", datetime(2021, 1, 4))],
                                 "symbol string, ts timestamp")
    right = spark.createDataFrame([(datetime(2021, 1, 1), 1.0), (datetime(2021, 1, 2), 2.0),
                                   (datetime(2021, 1, 3), None)], "ts timestamp, close double")
    out = asof.asof_join(left, right).orderBy("ts").collect()
    assert out[0].exo_close == 2.0 and out[0].exo_ts == datetime(2021, 1, 2)
    assert out[1].exo_close is None and out[1].exo_ts == datetime(2021, 1, 3)


def test_labels(spark):
    """Closes 1.0, 1.02, 0.99, 1.01, thresh 0.01."""
    df = bars_df(spark, [1.0, 1.02, 0.99, 1.01])
    out = labels.add_labels(df, thresh=0.01)
    assert col_list(out, "label_b1") == [1, 0, 1, 0]
    assert col_list(out, "label_t3") == [1, -1, 1, 0]
    r = col_list(out, "label_r")
    assert r[-1] == 0.0 and all(math.isfinite(x) for x in r)


def test_holiday_flag(spark):
    """2021-12-27 not a session → 1, 2021-12-29 a session → 0; no calendar → 0."""
    df = spark.createDataFrame([("A", datetime(2021, 12, 27)), ("A", datetime(2021, 12, 29))],
                               "symbol string, ts timestamp")
    sessions = spark.createDataFrame([(datetime(2021, 12, 28).date(),), (datetime(2021, 12, 29).date(),)],
                                     "trade_date date")
    assert col_list(calendar.holiday_flag(df, sessions), "holiday_flag") == [1, 0]
    assert col_list(calendar.holiday_flag(df, None), "holiday_flag") == [0, 0]


def test_calendar_columns(spark):
    df = spark.createDataFrame([("A", datetime(2021, 1, 31)), ("A", datetime(2021, 2, 1))], "symbol string, ts timestamp")
    out = df.select(*[c.alias(n) for n, c in calendar.calendar_columns().items()]).collect()
    assert [(r.weekday, r.month_end) for r in out] == [(6, 1), (0, 0)]


def test_naive_time_becomes_utc(spark):
    """Naive values are read as UTC instants (session time zone UTC)."""
    df = spark.createDataFrame([("2022-01-01 00:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    out = df.select(calendar.as_utc("ts").alias("u"))
    assert dict(out.dtypes)["u"] == "timestamp"
    assert out.select(F.unix_timestamp("u")).first()[0] == 1640995200


def test_flat_bar_ratios(spark):
    """zero range → wick ratios NULL, BOP 0; zero close does not raise."""
    df = spark.createDataFrame([("A", datetime(2021, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0),
                                ("A", datetime(2021, 1, 2), 0.0, 0.0, 0.0, 0.0, 1.0)],
                               "symbol string, ts timestamp, open double, high double, low double, close double, "
                               "volume double")
    out = df.select(PA.wick_ratio_upper().alias("r")).collect()
    assert [x.r for x in out] == [None, None]
    s = suite.add_indicators(df, ["bop", "roc", "natr"]).orderBy("ts").collect()
    assert s[0].bop == 0.0


def test_dedup_keeps_last_load(spark):
    """the same (symbol, ts) loaded three times → load 3 wins."""
    df = spark.createDataFrame([("A", datetime(2021, 1, 1), float(i), i) for i in (1, 2, 3)],
                               "symbol string, ts timestamp, close double, load_seq int")
    out = bars.dedup_keep_last(df).collect()
    assert len(out) == 1 and out[0].close == 3.0


def test_no_empty_bars_over_gaps(spark):
    """20 minutes without ticks produce no bars."""
    ticks = spark.createDataFrame([("A", datetime(2021, 1, 1, 0, m), m, 1.0 + m, 1.0) for m in (0, 1, 25, 26)],
                                  "symbol string, ts timestamp, seq long, price double, size double")
    out = bars.bars_from_ticks(ticks, "5 minutes").orderBy("ts").collect()
    assert [r.ts.minute for r in out] == [0, 25]
    assert (out[0].open, out[0].close, out[0].volume) == (1.0, 2.0, 2.0)


def test_resample_keeps_first_and_last(spark):
    b = spark.createDataFrame(
        [("A", datetime(2021, 1, 1, 0, m), 1.0 + m, 9.0, 0.5, 2.0 + m, 1.0) for m in range(6)],
        "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    out = bars.resample_bars(b, "5 minutes").orderBy("ts").collect()
    assert (out[0].open, out[0].close, out[0].volume) == (1.0, 6.0, 5.0)
    assert (out[1].open, out[1].close) == (6.0, 7.0)


def test_compact_old(spark):
    """Rows older than 90 days become 5-minute bars, recent ones stay."""
    b = spark.createDataFrame([("A", datetime(2020, 1, 1, 0, m), 1.0, 1.0, 1.0, 1.0, 1.0) for m in range(10)] +
                              [("A", datetime(2020, 6, 1, 0, m), 1.0, 1.0, 1.0, 1.0, 1.0) for m in range(3)],
                              "symbol string, ts timestamp, open double, high double, low double, close double, "
                              "volume double")
    out = bars.compact_old(b, "2020-06-02 00:00:00")
    assert out.count() == 2 + 3


def test_time_chunks(spark):
    """A 45-day span cuts into pieces of at most 8 days."""
    df = spark.createDataFrame([(datetime(2020, 1, 1), datetime(2020, 2, 15))], "s timestamp, e timestamp")
    ch = df.select(F.explode(scalar.time_chunks("s", "e")).alias("c")).select("c.*").collect()
    assert len(ch) >= 2
    assert all((c.chunk_end - c.chunk_start).days <= 8 for c in ch)
    assert ch[0].chunk_start == datetime(2020, 1, 1) and ch[-1].chunk_end == datetime(2020, 2, 15)


def test_interval_code(spark):
    out = spark.createDataFrame([("minute",), ("hour",), ("day",)], "f string").select(scalar.interval_code("f"))
    assert [r[0] for r in out.collect()] == ["1m", "1h", "1d"]


def test_gradient_descent_matches_rows():
    """GD on the Gram matrix equals GD on rows (X 20×2, y = 1.5x0 - 2x1)."""
    rng = np.random.default_rng(0)
    X = rng.normal(size=(20, 2))
    y = 1.5 * X[:, 0] - 2 * X[:, 1]
    w = np.zeros(2)
    for _ in range(5):
        w -= 0.1 * X.T.dot(X.dot(w) - y) / len(y)
    g = learn.gd_from_gram(X.T @ X, X.T @ y, 20, 0.1, 5)
    assert np.allclose(w, g, atol=1e-15)


def test_gram_stats_spark(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(30, 2))
    y = X @ np.array([0.5, -1.0])
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(X, y)], "x0 double, x1 double, y double")
    w = learn.linear_gd(df, ["x0", "x1"], "y", lr=0.1, epochs=7)
    ref = np.zeros(2)
    for _ in range(7):
        ref -= 0.1 * X.T.dot(X.dot(ref) - y) / 30
    assert np.allclose(w, ref, atol=1e-12)


def test_search_space_ranges(spark):
    """[1, 3] draws integers, [0.0, 1.0] floats; one value fixed; text a choice."""
    t = learn.expand_search_space(spark, {"a": [1, 3], "b": [0.0, 1.0], "c": [7], "d": ["x", "y"], "e": 2}, 50, 0)
    assert all(isinstance(p["a"], int) and 1 <= p["a"] <= 3 for p in t)
    assert all(isinstance(p["b"], float) and 0.0 <= p["b"] <= 1.0 for p in t)
    assert all(p["c"] == 7 and p["d"] in ("x", "y") and p["e"] == 2 for p in t)


def test_config_combinations(spark):
    """27 allowed model × label × frequency rows."""
    assert learn.config_combinations(spark).count() == 27


def test_lag_matrix_and_prediction(spark):
    """5 prices, weights 1,2,3 → 5×3 lag matrix and one prediction per row."""
    df = bars_df(spark, [100.0, 101.0, 99.0, 102.0, 103.0]).withColumn("freq", F.lit("d"))
    x = backtest.lag_features(df, 3)
    rows = x.orderBy("ts").collect()
    assert len(rows) == 5 and all(len(r.x) == 3 for r in rows)
    assert rows[0].x == [0.0, 0.0, 0.0]
    models = spark.createDataFrame([("m", "d", [1.0, 2.0, 3.0])], "model string, freq string, weights array<double>")
    s = backtest.score(x, models).orderBy("ts").collect()
    r = rows[3].x
    assert close(s[3].pred, r[0] + 2 * r[1] + 3 * r[2])


def test_backtest_metric_columns(spark):
    """OHLC 1, 2 daily with ten weights → the metric columns exist."""
    df = bars_df(spark, [1.0, 2.0]).withColumn("freq", F.lit("d"))
    models = spark.createDataFrame([("m", "d", [1.0] * 10)], "model string, freq string, weights array<double>")
    m = backtest.backtest(df, models, 10)["metrics"]
    for c in ("accuracy", "balanced_accuracy", "f1", "sharpe", "sortino", "max_drawdown", "cagr", "final_score"):
        assert c in m.columns


def test_one_period_has_no_sharpe_or_score(spark):
    """a one-period return series → Sharpe, Sortino and score missing."""
    df = bars_df(spark, [1.0, 2.0]).withColumn("freq", F.lit("d"))
    df = df.withColumn("ts", F.when(F.col("close") == 1.0, F.lit("2021-01-01 01:00:00"))
                       .otherwise(F.lit("2021-01-01 02:00:00")).cast("timestamp"))
    models = spark.createDataFrame([("m", "d", [1.0])], "model string, freq string, weights array<double>")
    r = backtest.backtest(df, models, 1)["metrics"].first()
    assert r.n_periods == 1 and r.sharpe is None and r.sortino is None and r.final_score is None


def test_balanced_accuracy_single_class(spark):
    """truth has only class 1 → balanced accuracy = recall of class 1."""
    df = bars_df(spark, [1.0, 2.0, 3.0, 4.0, 5.0]).withColumn("freq", F.lit("d"))
    models = spark.createDataFrame([("m", "d", [1.0])], "model string, freq string, weights array<double>")
    x = backtest.score(backtest.lag_features(df, 1), models)
    cm = backtest.class_metrics(x).first()
    # truth: always up (4 rows); pred > 0 on rows 2-4 (row 1 has return 0) → recall 3/4
    assert close(cm.balanced_accuracy, 0.75) and close(cm.accuracy, 0.75)


def test_affine_scan_across_blocks(spark):
    """3 × block size rows of one symbol: blocked scan = sequential loop."""
    n = 3 * 16
    df = spark.createDataFrame([("A", i, 0.9 if i % 3 else 0.5, float(i % 7)) for i in range(n)],
                               "symbol string, _rn long, a double, b double")
    out = scan.affine_scan(df, ["symbol"], {"y": (F.col("a"), F.col("b"))}, block_rows=16)
    got = [r.y for r in out.orderBy("_rn").collect()]
    y, ref = 0.0, []
    for i in range(n):
        y = (0.9 if i % 3 else 0.5) * y + float(i % 7)
        ref.append(y)
    assert np.allclose(got, ref, rtol=0, atol=1e-12)


def test_running_and_blocked_windows_match_plain(spark):
    """Blocked windows with halos and carries equal plain windows."""
    closes = [float((i * 37) % 11 + 1) for i in range(50)]
    df = bars_df(spark, closes)
    d = series.number_rows(df, ["symbol"])
    s = series.staged(d, ["symbol"], [lambda w: {"m": F.avg("close").over(w.rowsBetween(-4, 0)),
                                                 "nx": F.lead("close").over(w)}],
                      back=4, fwd=1, numbered=True, keep_rn=True, block_rows=7)
    s = series.running(s, ["symbol"], {"cs": ("sum", F.col("close")), "mx": ("max", F.col("close"))}, block_rows=7)
    rows = s.orderBy("ts").collect()
    for i, r in enumerate(rows):
        win = closes[max(0, i - 4): i + 1]
        assert close(r.m, sum(win) / len(win))
        assert r.nx == (closes[i + 1] if i + 1 < len(closes) else None)
        assert close(r.cs, sum(closes[: i + 1])) and r.mx == max(closes[: i + 1])


def test_indicator_suite_runs_all_names(spark):
    """Every available indicator on a short series, NULL until its lookback."""
    closes = [10 + math.sin(i / 3) + i * 0.05 for i in range(120)]
    df = bars_df(spark, closes, volumes=[100.0 + i for i in range(120)])
    out = suite.add_indicators(df)
    names = suite.available(True)
    assert len(names) > 80
    row = out.orderBy(F.col("ts").desc()).first().asDict()
    for n in ("rsi", "macd_macd", "atr", "adx", "kama", "t3", "sma", "cdldoji", "obv"):
        assert row[n] is not None, n
    first = out.orderBy("ts").first()
    assert first.sma is None and first.rsi is None


def test_no_volume_skips_volume_indicators(spark):
    df = bars_df(spark, [1.0 + i for i in range(40)]).drop("volume")
    out = suite.add_indicators(df)
    assert "mfi" not in out.columns and "obv" not in out.columns and "sma" in out.columns


@pytest.mark.parametrize("sig,side", [(1, "BUY"), (-1, "SELL"), (0, "HOLD")])
def test_side_label(spark, sig, side):
    from barengine.operators.leaderboard import side_label
    assert spark.createDataFrame([(sig,)], "signal int").select(side_label()).first()[0] == side


def test_affine_scan_many_levels(spark):
    """Block maps scanned over several levels (300 rows, 4-row blocks, two series)."""
    rows = [(s, i, 0.97 if (i + len(s)) % 5 else 0.3, float((i * 7) % 11) - 5) for s in ("A", "BB") for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, _rn long, a double, b double")
    out = scan.affine_scan(df, ["symbol"], {"y": (F.col("a"), F.col("b"))}, block_rows=4)
    got = {(r.symbol, r._rn): r.y for r in out.collect()}
    for s in ("A", "BB"):
        y = 0.0
        for i in range(300):
            y = (0.97 if (i + len(s)) % 5 else 0.3) * y + float((i * 7) % 11) - 5
            assert abs(got[(s, i)] - y) < 1e-9


def _candles(spark, rows):
    """rows: (open, high, low, close); 12 quiet bars of body 1 and range 2 come first."""
    base = [(10.0, 11.5, 9.5, 11.0)] * 12
    data = [("A", datetime(2021, 1, 1 + i), o, h, lo, c, 1.0) for i, (o, h, lo, c) in enumerate(base + rows)]
    return spark.createDataFrame(data, "symbol string, ts timestamp, open double, high double, low double, "
                                       "close double, volume double")


def test_candle_doji_and_engulfing(spark):
    df = _candles(spark, [(11.0, 11.6, 10.4, 10.5), (10.4, 11.8, 10.3, 11.7), (11.0, 11.9, 10.1, 11.01)])
    out = suite.add_indicators(df, ["cdldoji", "cdlengulfing"]).orderBy("ts").collect()
    assert out[13].cdlengulfing == 100     # white body engulfs the black one before
    assert out[14].cdldoji == 100          # body 0.01 against a 2.0 average range


def test_candle_advance_block_and_three_stars(spark):
    adv = _candles(spark, [(10.0, 13.0, 9.9, 12.9), (12.0, 14.5, 11.9, 13.6), (13.2, 15.5, 13.1, 13.8)])
    out = suite.add_indicators(adv, ["cdladvanceblock"]).orderBy("ts").collect()
    assert out[-1].cdladvanceblock == -100
    south = _candles(spark, [(14.0, 14.1, 7.0, 11.0), (11.8, 12.0, 9.8, 10.5), (10.4, 10.4, 10.2, 10.2)])
    out = suite.add_indicators(south, ["cdl3starsinsouth"]).orderBy("ts").collect()
    assert out[-1].cdl3starsinsouth == 100


def test_stream_upsert_newest_load_wins(spark, tmp_path):
    """Two micro-batches merged into the table; overlapping keys take
    the newer batch, untouched symbols stay as they were."""
    from barengine.streaming.bars_stream import read_upserted, upsert_batch
    target = str(tmp_path / "t")
    fn = upsert_batch(target, key=("symbol", "seq"), order="seq")
    s = "symbol string, seq long, price double"
    fn(spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 5.0)], s), 0)
    fn(spark.createDataFrame([("A", 2, 20.0), ("A", 3, 30.0)], s), 1)
    got = sorted(tuple(r) for r in read_upserted(spark, target).select("symbol", "seq", "price").collect())
    assert got == [("A", 1, 1.0), ("A", 2, 20.0), ("A", 3, 30.0), ("B", 1, 5.0)]


def test_materialize_and_drop(spark):
    """Lineage cuts are written under spark.checkpoint.dir and can be dropped."""
    import os
    from barengine.session import app_dir, drop_materialized, materialize
    df = materialize(spark.range(10), "t")
    assert df.count() == 10
    mine = app_dir(spark)
    other = os.path.join(os.path.dirname(mine), "another-application")
    os.makedirs(other, exist_ok=True)
    assert os.path.isdir(mine)
    drop_materialized(spark)
    assert not os.path.exists(mine) and os.path.isdir(other)


def test_asof_carry_across_empty_buckets(spark):
    """Right rows only in hour 0 and hour 5: left rows in hours 2-4 take the
    hour-0 row by carry; two left series share the right series."""
    right = spark.createDataFrame([(datetime(2021, 1, 1, 0, 10), 1.0), (datetime(2021, 1, 1, 0, 50), 2.0),
                                   (datetime(2021, 1, 1, 5, 30), 3.0)], "ts timestamp, close double")
    left = spark.createDataFrame([(s, datetime(2021, 1, 1, h, 40)) for s in ("A", "B") for h in (0, 2, 4, 5)] +
                                 [("A", datetime(2021, 1, 1, 0, 5))], "symbol string, ts timestamp")
    got = {(r.symbol, r.ts.hour, r.ts.minute): r.exo_close for r in asof.asof_join(left, right).collect()}
    assert got[("A", 0, 5)] is None
    for s in ("A", "B"):
        assert got[(s, 0, 40)] == 1.0 and got[(s, 2, 40)] == 2.0 and got[(s, 4, 40)] == 2.0
        assert got[(s, 5, 40)] == 3.0


def test_gram_matrix_takes_complete_rows_only(spark):
    """A NULL feature takes its row out of every sum and of the count."""
    rows = [(float(i), float(2 * i)) if i % 3 else (None, 5.0) for i in range(9)]
    df = spark.createDataFrame(rows, "x double, y double")
    full = df.where("x IS NOT NULL")
    assert learn.gram_stats(df, ["x"], "y").first() == learn.gram_stats(full, ["x"], "y").first()
    assert np.allclose(learn.linear_gd(df, ["x"], "y", lr=0.01), learn.linear_gd(full, ["x"], "y", lr=0.01))


def test_random_search_needs_validation_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, "train")], "x double, y double, split string")
    with pytest.raises(ValueError):
        learn.random_search(spark, df, ["x"], "y", {"lr": [0.1, 0.2]}, n_trials=2)


def test_upsert_fails_when_the_table_cannot_be_read(spark, tmp_path):
    """An unreadable table is no first batch; nothing is overwritten."""
    from barengine.streaming.bars_stream import upsert_batch
    target = tmp_path / "t"
    (target / "symbol=A").mkdir(parents=True)
    (target / "symbol=A" / "part-0.parquet").write_bytes(b"not parquet")
    batch = spark.createDataFrame([("A", 1, 2.0)], "symbol string, seq long, price double")
    with pytest.raises(Exception):
        upsert_batch(str(target), key=("symbol", "seq"), order="seq")(batch, 0)
    assert (target / "symbol=A" / "part-0.parquet").read_bytes() == b"not parquet"


def test_scan_passes_nan_through_at_every_block_size(spark):
    """After a NaN the rest of its series is missing, whatever the blocks."""
    from barengine.operators.scan import affine_scan
    rows = [("A", i, float("nan") if i == 5 else 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "symbol string, _rn long, b double")
    got = [[r.y for r in affine_scan(df, ["symbol"], {"y": (F.lit(0.5), F.col("b"))}, block_rows=n)
            .orderBy("_rn").collect()] for n in (4, 100)]
    assert [[v is None or math.isnan(v) for v in g] for g in got] == [[i >= 5 for i in range(20)]] * 2
    assert got[0][:5] == got[1][:5]


def test_decimal_running_sum_is_exact_at_every_block_size(spark):
    """Running cash in decimals is the same for every block size, and keeps all ten digits."""
    df = spark.range(40).select(F.lit("a").alias("symbol"), F.col("id").alias("_rn"),
                                (F.col("id") / 7).cast("decimal(27,10)").alias("x"))
    got = []
    for n in (3, 7, 64):
        with series.block_size(n):
            out = series.running(df, ["symbol"], {"s": ("sum", F.col("x"))})
            got.append([r.s for r in out.orderBy("_rn").collect()])
    total, exp = 0, []
    for r in df.orderBy("_rn").collect():
        total += r.x
        exp.append(total)
    assert got == [exp, exp, exp]


def test_block_size_holds_only_inside_its_context():
    with series.block_size(5):
        assert series._rows(None) == 5 and series._rows(9) == 9
    assert series._rows(None) == series.BLOCK_ROWS
