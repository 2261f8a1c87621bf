import math

import __spark_entry__ as E

from conftest import SF001


def _rows(records, cols):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])

    def n(v):
        return round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(n(r[i]) for i in idx) for r in records), key=repr)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert set(df.columns) >= {"symbol", "bars", "share_up"}


def test_every_query_has_a_name_and_runs(spark):
    qs = E.queries()
    assert len(qs) >= 10
    for name in ["bars_1h", "label_b1"]:
        assert qs[name](spark, SF001).count() > 0


def test_queries_match_oracle_at_sf0001(spark, duck):
    """The driver's check, on the smallest data: every query with SQL."""
    qs, sqls = E.queries(), E.oracle_sql()
    for t in ("region nation customer supplier part lineitem documents pages benchmark conversations").split():
        duck.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    bad = []
    for name, sql in sorted(sqls.items()):
        df = qs[name](spark, SF001)
        got = _rows([tuple(r) for r in df.collect()], df.columns)
        rel = duck.sql(sql)
        exp = _rows(rel.fetchall(), rel.columns)
        if sorted(df.columns) != sorted(rel.columns) or got != exp:
            bad.append(name)
    assert not bad, bad
