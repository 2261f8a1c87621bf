"""Durable streams: one identity over runs, replayed and failing epochs, totals over all reports, hot symbols in blocks."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barengine.streaming import bars_stream as ST

T0 = datetime(2024, 1, 1)
TICKS = "symbol string, ts timestamp, seq long, price double"


def test_runs_on_one_checkpoint_are_one_query(spark, tmp_path):
    """The second run reads only new files, keeps the query's identity and the open window's state."""
    base, src = str(tmp_path / "s"), str(tmp_path / "in")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    row = lambda i, minute, v: (i, T0 + timedelta(minutes=minute), 1, "A", v, None)
    runs = []
    for part in ([row(0, 0, 5.0), row(1, 11, 1.0)], [row(2, 12, 9.0), row(3, 60, 2.0)], []):
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        bars = ST.stream_bars(ST.read_event_stream(spark, src, "*.parquet"), "5 minutes", "10 minutes")
        path, run = ST.run_available_now(bars, "t", base=base)
        runs.append((run.query_id, run.input_rows))
    assert len({q for q, _ in runs}) == 1 and [n for _, n in runs] == [2, 2, 0]
    got = sorted((r.ts.minute, r.open, r.close) for r in spark.read.parquet(path).collect())
    assert got == [(0, 5.0, 5.0), (10, 1.0, 9.0)]  # the window of minute 10 began in the first run


def test_totals_count_reports_that_the_query_forgot(spark, tmp_path):
    """Six batches while the query keeps two reports."""
    src = str(tmp_path / "in")
    for i in range(6):
        spark.createDataFrame([(i, T0, 1, "A", 1.0, None)], "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                              "value double, props string").coalesce(1).write.mode("append").parquet(src)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    try:
        ticks = ST.read_event_stream(spark, src, "*.parquet", max_files=1)
        _, run = ST.run_available_now(ticks, "totals")
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert run.input_rows == 6 and run.batches >= 6


def test_refresh_goes_on_in_its_folder(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, T0, 1, "A", 1.0, None)], "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                          "value double, props string").write.parquet(src)
    for _ in range(2):
        q = ST.refresh_every(ST.read_event_stream(spark, src, "*.parquet"), "r", seconds=1, base=str(tmp_path / "r"))
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert spark.read.parquet(str(tmp_path / "r/out")).count() == 1


def ticks(seed, n=200):
    r = random.Random(seed)
    return [(r.choice(["hot"] * 6 + ["b", None]), T0 + timedelta(hours=seed * 100 + i // 4), seed * 1000 + i, r.choice([0.0, 1.0, 2.0, 5.0]))
            for i in range(n)]


@pytest.mark.parametrize("block", [2, 16, 1000])
def test_returns_carry_over_batches_and_blocks(spark, tmp_path, block):
    """Any block size, an epoch run twice, a symbol that skips a batch: the same returns as over all ticks."""
    target, fn = str(tmp_path / "t"), None
    batches = [ticks(0), [t for t in ticks(1) if t[0] != "b"], ticks(2)]
    for epoch, rows in enumerate(batches):
        fn = ST.returns_batch(target, block_rows=block)
        df = spark.createDataFrame(rows, TICKS).repartition(3)
        fn(df, epoch)
        if epoch == 1:
            fn(df, epoch)
    want, last = {}, {}
    for s, ts, seq, p in sorted((t for b in batches for t in b), key=lambda t: (t[1], t[2])):
        want[seq] = p / last[s] - 1 if last.get(s) else 0.0
        last[s] = p
    got = {r.seq: r.ret for r in ST.read_returns(spark, target).collect()}
    assert got == pytest.approx(want)


def test_upsert_survives_a_failure_between_data_and_manifest(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    fn = ST.upsert_batch(target, key=("symbol", "seq"), order="seq")
    day = lambda d, *rows: spark.createDataFrame([(s, T0 + timedelta(days=d), q, p) for s, q, p in rows], TICKS)
    table = lambda: sorted(((r.symbol or "", r.seq, r.price) for r in ST.read_upserted(spark, target).collect()))
    fn(day(0, ("A", 1, 1.0), (None, 2, 2.0), ("1", 7, 7.0)).unionByName(day(1, ("A", 5, 5.0))), 0)
    before = table()
    commit = ST._commit
    monkeypatch.setattr(ST, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    second = day(1, ("A", 5, 50.0), ("A", 6, 6.0)).unionByName(day(0, (None, 2, 20.0)))
    with pytest.raises(RuntimeError):
        fn(second, 1)
    assert table() == before  # new files are there, the manifest does not name them
    monkeypatch.setattr(ST, "_commit", commit)
    fn(second, 1)
    want = [("", 2, 20.0), ("1", 7, 7.0), ("A", 1, 1.0), ("A", 5, 50.0), ("A", 6, 6.0)]
    assert table() == want
    fn(second, 1)
    assert table() == want
    fn(day(3, ("A", 9, 9.0)), 2)
    assert table() == sorted([*want, ("A", 9, 9.0)])
    assert ST.vacuum_upserted(spark, target) == 0  # every epoch still has a current partition
    fn(second.unionByName(day(0, ("1", 7, 8.0), ("A", 1, 1.5))), 3)
    assert ST.vacuum_upserted(spark, target) == 2 and len(table()) == 6


def test_upsert_reads_only_touched_dates(spark, tmp_path):
    """The files of an untouched date are gone, and a batch for another date does not miss them."""
    import shutil
    target = str(tmp_path / "t")
    fn = ST.upsert_batch(target, key=("symbol", "seq"), order="seq")
    fn(spark.createDataFrame([("A", T0 + timedelta(days=d), d, 1.0) for d in range(3)], TICKS), 0)
    shutil.move(f"{target}/data/epoch=0/symbol=A/_date=2024-01-01", str(tmp_path / "away"))
    fn(spark.createDataFrame([("A", T0 + timedelta(days=2), 2, 2.0)], TICKS), 1)
    shutil.move(str(tmp_path / "away"), f"{target}/data/epoch=0/symbol=A/_date=2024-01-01")
    assert sorted((r.seq, r.price) for r in ST.read_upserted(spark, target).collect()) == [(0, 1.0), (1, 1.0), (2, 2.0)]
