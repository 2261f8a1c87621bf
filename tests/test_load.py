"""Landing of mixed CSV files, the bucketed feature table and the model store against plain expectations."""
import math
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barengine.operators import feature_table as FT, model_store as MS
from barengine.sources import files, landing

from helpers import bars_df


def _write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_files_of_several_layouts_and_bad_records(spark, tmp_path):
    d = str(tmp_path)
    _write(d, "AAA.csv", ",Open,High,Low,Close\n2020-01-01 00:00:00+00:00,1,3,0.5,2\n2020-01-02 00:00:00+00:00,2,2,2,\n")
    _write(d, "B+ [1].csv", '\n"Volume","Close",low,HIGH,Open,Date,"a, b"\n10,2,0.5,3,1,2020-01-01,"x, y"\n'
                            "n/a,2,0.5,3,1,2020-01-02,z\n1,2,3\n5,2,0.5,NaN,1,notime,z\n5,2,0.5,NaN,1,2020-01-03,z\n")
    _write(d, "C.csv", "a,b\n1,2\n")
    _write(d, "ONLY.csv", "ts,open,high,low,close,volume\n")
    _write(d, "EMPTY.csv", "")
    bars, bad = landing.land_market_files(spark, d, freq="1d")
    got = {(r.symbol, r.ts.day): (r.open, r.high, r.low, r.close, r.volume) for r in bars.collect()}
    assert got == {("AAA", 1): (1.0, 3.0, 0.5, 2.0, None), ("AAA", 2): (2.0, 2.0, 2.0, None, None),
                   ("B+ [1]", 1): (1.0, 3.0, 0.5, 2.0, 10.0), ("B+ [1]", 3): (1.0, None, 0.5, 2.0, 5.0)}
    assert {r.freq for r in bars.collect()} == {"1d"}
    assert sorted((r.symbol, r.reason, r.record) for r in bad.collect()) == [
        ("B+ [1]", "fields", "1,2,3"), ("B+ [1]", "number", "n/a,2,0.5,3,1,2020-01-02,z"),
        ("B+ [1]", "time", "5,2,0.5,NaN,1,notime,z"), ("C", "header", None)]


def test_no_files_that_can_be_read(spark, tmp_path):
    _write(str(tmp_path), "X.csv", "")
    bars, bad = landing.land_market_files(spark, str(tmp_path))
    assert bars.count() == 0 and bad.count() == 0


def test_layout_of_a_file_of_many_splits(spark, tmp_path):
    """Only the first split holds the header; the records of the others keep its columns and their order."""
    lines = "".join(f"{i % 7},{i},{datetime(2020, 1, 1 + i % 28).date()} 00:{i // 28 % 60:02d}:{i // 1680:02d},{i},{i},{i}\n" for i in range(3000))
    _write(str(tmp_path), "S.csv", "volume,close,ts,low,high,open\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        bars, bad = landing.land_market_files(spark, str(tmp_path))
        assert bad.count() == 0
        assert bars.select("file_start").distinct().count() > 3
        assert [int(r.close) for r in bars.orderBy(*landing.LOAD_ORDER).collect()] == list(range(3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_load_keeps_the_last_record_and_merges(spark, tmp_path):
    store, one, two = (str(tmp_path / x) for x in ("store", "one", "two"))
    _write(one, "A.csv", "ts,open,high,low,close\n2020-01-01,1,1,1,1\n2020-01-02,2,2,2,2\n2020-01-01,9,9,9,9\n")
    _write(one, "B.csv", "ts,open,high,low,close\n2020-01-01,5,5,5,5\n")
    assert landing.load_bars(spark, one, store, "1d", "2020-02-01").count() == 0
    _write(two, "A.csv", "close,ts,open,high,low\n7,2020-01-02,7,7,7\n8,2020-01-03,8,8,8\nbad,2020-01-04,8,8,8\n")
    assert landing.load_bars(spark, two, store, "1d", "2020-02-01").count() == 1
    got = {(r.symbol, r.ts.day): r.close for r in files.read_bars(spark, store, "1d").collect()}
    assert got == {("A", 1): 9.0, ("A", 2): 7.0, ("A", 3): 8.0, ("B", 1): 5.0}


def test_minute_loads_are_compacted(spark, tmp_path):
    store, one = str(tmp_path / "store"), str(tmp_path / "one")
    _write(one, "A.csv", "ts,open,high,low,close,volume\n" + "".join(f"2020-01-01 00:0{i}:00,{i},{i},{i},{i},1\n" for i in range(7)))
    landing.load_bars(spark, one, store, "1m", "2021-01-01")
    got = [(r.ts.minute, r.open, r.close, r.volume) for r in files.read_bars(spark, store, "1m").orderBy("ts").collect()]
    assert got == [(0, 0.0, 4.0, 5.0), (5, 5.0, 6.0, 2.0)]


@pytest.fixture
def bars(spark):
    return bars_df(spark, [100 + 5 * math.sin(i / 3) for i in range(90)]).unionByName(
        bars_df(spark, [50.0 + i % 9 for i in range(70)], symbol="B"))


def test_feature_tables_join_without_exchange(spark, bars, tmp_path):
    exo = bars.where("symbol = 'B'").select("ts", "close")
    f = FT.compute_features(bars, exo, None, ["sma", "ema", "obv"], (4,))
    assert f.count() == 160 and not [c for c in f.columns if c.startswith("_")]
    left = FT.write_feature_table(f, "t_features", str(tmp_path / "f"), 4)
    right = FT.write_feature_table(FT.label_table(bars), "t_labels", str(tmp_path / "l"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = FT.join_features(left, right)
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        rows = {(r.symbol, r.ts.timetuple().tm_yday, r.ts.year): r for r in j.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 160
    r = rows[("B", 40, 2021)]
    assert (r.close, r.label_b1, r.exo_spread) == (50 + 39 % 9, 1, 0.0)
    assert sum(r.emb_4) == pytest.approx(0.0) and rows[("B", 3, 2021)].emb_4 == [None] * 4
    spark.sql("DROP TABLE t_features")
    again = FT.open_feature_table(spark, "t_features", str(tmp_path / "f"), 4)
    assert again.count() == 160 and set(again.columns) == set(f.columns)


def _models(spark, rows):
    return spark.createDataFrame(rows, MS.MODELS)


def test_model_versions_and_best(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(ValueError):
        MS.load_models(spark, root)
    assert MS.save_models(_models(spark, [("a", "1h", "R", [1.0]), ("b", "1h", "R", [2.0])]), root) == 1
    assert MS.save_models(_models(spark, [("a", "1h", "R", [3.0])]), root) == 2
    assert [r.weights for r in MS.load_models(spark, root).collect()] == [[3.0]]
    assert MS.load_models(spark, root, 1).count() == 2
    with pytest.raises(ValueError):
        MS.load_models(spark, root, 9)
    assert MS.best_folder(spark, root) is None
    metrics = spark.createDataFrame([("a", "X", 0.7), ("a", "Y", 0.1), ("b", "X", None)], "model string, symbol string, final_score double")
    curves = spark.createDataFrame([("a", "X", datetime(2021, 1, 1), 1.5), ("a", "Y", datetime(2021, 1, 1), 0.5)],
                                   "model string, symbol string, period timestamp, cum double")
    assert MS.promote(MS.discover_models(spark, root), metrics, curves, root, 0.6) == 1
    best = MS.best_folder(spark, root)
    kept = files.read_metrics(spark, f"{best}/metrics", "symbol string, final_score double, model string").collect()
    assert [(r.model, r.symbol, r.final_score) for r in kept] == [("a", "X", 0.7)]
    curve = files.read_equity(spark, f"{best}/equity", "period timestamp, cum double, model string, symbol string").collect()
    assert [(r.label, r.cum) for r in curve] == [("a/X", 1.5)]
    # rows in the best folder are no saved models
    assert sorted((r.model, r.version, r.weights) for r in MS.discover_models(spark, root).collect()) == [("a", 2, [3.0]), ("b", 1, [2.0])]
    assert MS.discover_models(spark, root, newest=False).count() == 3
    # a later promotion that keeps nothing moves the pointer too
    assert MS.promote(MS.discover_models(spark, root), metrics.where(F.lit(False)), curves, root) == 2
    assert MS.best_folder(spark, root).endswith("version=2")


def test_a_half_written_version_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "store")
    MS.save_models(_models(spark, [("a", "1h", "R", [1.0])]), root)
    _models(spark, [("a", "1h", "R", [8.0])]).write.parquet(f"{root}/models/_made-broken")
    assert MS.versions(spark, f"{root}/models") == [1]
    assert [r.weights for r in MS.discover_models(spark, root, newest=False).collect()] == [[1.0]]
