"""Language models: formulas in plain Python, held-out accuracy."""
import collections
import math
import os
import pathlib
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from barengine.llm import common, decontamination, language_model, quality_model, tokens

from corpus_rows import SF01, docs, empty, rows  # noqa: F401


def words(text):
    return [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]


def fold(key):
    return zlib.crc32(("null" if key is None else str(key)).encode()) % 7


def test_token_hashes(monkeypatch):
    texts = [None, "", " ", "A b\tc\x0bd  é Ünï ", "x" * 500, "a " * 300, "\n\nq"]
    off, data = tokens.text_buffer(pa.array(texts, pa.string()))
    row, h, n = tokens.range_words(off, data, 0, len(texts))
    exp = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert row.tolist() == [i for i, _ in exp] and n.tolist() == [len(words(t)) for t in texts]
    seen = {}
    assert all(seen.setdefault(w, x) == x for (_, w), x in zip(exp, h.tolist())) and len(set(seen.values())) == len(seen)
    monkeypatch.setattr(tokens, "PIECE", 32)
    assert (tokens.range_words(off, data, 0, len(texts))[1] == h).all()


def test_hashing_stays_in_the_cache(monkeypatch):
    """Before, arrays of eight bytes for each byte of a whole piece: three times the memory and twice the time."""
    r = np.random.default_rng(4)
    vocab = ["".join(chr(97 + x) for x in r.integers(0, 26, n)) for n in r.integers(1, 12, 3000)]
    texts = [" ".join(vocab[i] for i in r.integers(0, len(vocab), 300)) for _ in range(500)]
    texts += [None, "", "y" * (3 * tokens.STEP + 5) + " z", "z " + "y" * (3 * tokens.STEP + 5), "A" * tokens.STEP, "a" * tokens.STEP]
    off, data = tokens.text_buffer(pa.array(texts, pa.string()))
    tracemalloc.start()
    row, h, n = tokens.range_words(off, data, 0, len(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14 * len(data) and n.tolist() == [len(words(t)) for t in texts] and row.tolist() == np.repeat(np.arange(len(n)), n).tolist()
    seen = {}
    assert all(seen.setdefault(w, x) == x for w, x in zip((w for t in texts for w in words(t)), h.tolist()))
    assert len(set(seen.values())) == len(seen)
    for step in (7, 300, 5000):  # the same hashes however texts are cut, and however rows are copied
        monkeypatch.setattr(tokens, "STEP", step)
        monkeypatch.setattr(tokens, "LONG_ROW", step)
        some = tokens.range_words(off, data, 490, 505)
        lo, hi = n[:490].sum(), n[:505].sum()
        assert (some[1] == h[lo:hi]).all() and (some[0] == row[lo:hi] - 490).all() and (some[2] == n[490:505]).all()


def test_document_frequencies(docs, rows, monkeypatch):
    for piece in (decontamination.PIECE, 200):
        monkeypatch.setattr(decontamination, "PIECE", piece)
        weight, n = decontamination.idf(docs, "text")
        df = collections.Counter(w for r in rows for w in set(words(r[1])))
        off, data = tokens.text_buffer(pa.array([" ".join(df)]))
        at = decontamination._features(tokens.range_words(off, data, 0, 1)[1])
        exp = np.bincount(at, list(df.values()), minlength=len(weight))
        assert n == len(rows) and len(set(at.tolist())) == len(df)  # none of these words share a number
        assert np.allclose(weight, decontamination.FLOOR_WEIGHT + np.log((n + 1) / (exp + 1)))


def test_deleted_interpolation(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(language_model, "CHUNK", 700)  # the long text lies in several chunks
    got = language_model.score_corpus(docs).collect()
    text = {r: words(r[1]) + [""] for r in rows}
    c, pairs, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    c3, pairs3, ctx3 = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        w = text[r]
        if fold(r[0]) != 2:
            for store, store2, store3 in ((c, pairs, ctx), (c3, pairs3, ctx3)):
                if store is c or fold(r[0]) == 3:
                    store.update(w)
                    store2.update(zip([None, *w], w))
                    store3.update([None, *w[:-1]])
    total, types = sum(c.values()), len(c)
    held = sum(c3.values())
    cells = []
    for (v, w), n in pairs3.items():
        cv, cw, cp = ctx[v] - ctx3[v], c[w] - c3[w], pairs[v, w] - pairs3[v, w]
        b = 0 if not cv else 1 + int(math.log2(cv))
        q2, q1 = (cp / cv if cv else 0), cw / (total - held)
        cells.append((b, 1 if q2 else -1, 1 if q1 else -1, n, n * math.log(q2 or 1), n * math.log(q1 or 1)))
    lam = language_model.em_weights(cells, types)
    exp = collections.Counter()
    for r in rows:
        base = score = 0.0
        for v, w in zip([None, *text[r]], text[r]):
            base += math.log10((c[w] + 1) / (total + types + 1))
            cv = ctx[v]
            wt = lam[0 if not cv else 1 + int(math.log2(cv))]
            score += math.log10(wt[0] * (pairs[v, w] / cv if cv else 0) + wt[1] * c[w] / total + wt[2] / (types + 1))
        exp[(r[0], fold(r[0]) == 2, len(text[r]), sum(c[w] > 0 for w in text[r]), total, round(base, 6))] += 1
        near = [g for g in got if g.doc_id == r[0] and g.n_tokens == len(text[r])]
        assert any(abs(g.score - score) < 0.02 * abs(score) + 0.1 for g in near), (r[0], score, near)
    assert collections.Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6))
                               for g in got) == exp
    assert language_model.score_corpus(empty).count() == 0


def test_em_finds_the_weights():
    rng = np.random.default_rng(1)
    q = rng.dirichlet([1, 1], size=200)
    cells = [(3, 1, 1, n, n * math.log(a), n * math.log(b)) for (a, b) in q.tolist()
             for n in [1000 * (0.7 * a + 0.3 * b)]]
    lam = language_model.em_weights(cells, types=10 ** 9)
    before = sum(n * math.log(0.5 * a + 0.5 * b) for (a, b), (_, _, _, n, *_) in zip(q.tolist(), cells))
    after = sum(n * math.log(lam[3][0] * a + lam[3][1] * b) for (a, b), (_, _, _, n, *_) in zip(q.tolist(), cells))
    assert after >= before and abs(lam.sum(axis=1) - 1).max() < 1e-9


def plain_kneser_ney(train):
    pairs = collections.Counter()
    for t in train:
        w = words(t) + [""]
        pairs.update(zip([None, *w], w))
    d = quality_model._discounts(collections.Counter(n for n in pairs.values() if n <= 4))
    cont = collections.Counter(w for _, w in pairs)
    e = quality_model._discounts(collections.Counter(n for n in cont.values() if n <= 4))
    cv, kinds = collections.Counter(), collections.defaultdict(collections.Counter)
    for (v, _), n in pairs.items():
        cv[v] += n
        kinds[v][min(n, 3)] += 1
    total, types = sum(cont.values()), len(cont)
    unknown = sum(e[min(n, 3) - 1] for n in cont.values()) / total / (types + 1)

    def p(v, w):
        low = unknown + (max(cont[w] - e[min(cont[w], 3) - 1], 0) / total if cont[w] else 0)
        if not cv[v]:
            return low
        gamma = sum(d[k - 1] * n for k, n in kinds[v].items()) / cv[v]
        n = pairs[v, w]
        return (n - d[min(n, 3) - 1] if n else 0) / cv[v] + gamma * low
    return p, cont


def test_kneser_ney(spark, docs, rows, empty):
    train = [r[1] for r in rows[28:50]]
    model = quality_model.KneserNey(spark.createDataFrame([(t,) for t in train], "t string"))
    p, cont = plain_kneser_ney(train)
    for v in (None, words(train[0])[0]):  # probabilities of all words and of one unknown word add up to one
        assert abs(sum(p(v, w) for w in cont) + p(v, "never seen") - 1) < 1e-9
    exp = collections.Counter()
    for r in rows:
        w = words(r[1]) + [""]
        exp[(r[0], len(w), round(sum(math.log10(p(a, b)) for a, b in zip([None, *w], w)), 3))] += 1
    got = quality_model.score(docs, model, "doc_id", "text", "lang").collect()
    assert collections.Counter((g.doc_id, g.n_tokens) for g in got) == collections.Counter((k, n) for k, n, _ in exp.elements())
    a = sorted((g.doc_id is None, g.doc_id, g.n_tokens, g.log10_prob) for g in got)
    b = sorted((k is None, k, n, x) for k, n, x in exp.elements())
    assert all(abs(x[3] - y[3]) < 1e-3 * abs(y[3]) + 2e-3 for x, y in zip(a, b))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert quality_model.classify(docs, labels).count() == len(rows)
    assert quality_model.classify(empty, labels.limit(0)).count() == 0


def test_oversized_documents_leave_room_in_the_sample(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    order = [r.key_ for r in quality_model.trusted(labels, "doc_id").where("fold_ <> 0").orderBy("order_", "key_").collect()]
    big, hot = order[0], order[1]
    rows = [(i, "word " * 5000 if i == big else f"some own words of {i}") for i in range(40)]
    rows += [(hot, f"some own words of {hot}")] * 300 + [(hot, "other text")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = quality_model.training_keys(d, labels, "doc_id", "text", max_tokens=1000).collect()
    assert sorted(r.key_ for r in got) == sorted(order[1:])
    assert not quality_model.training_keys(d, labels, "doc_id", "text", max_tokens=0).count()


def test_classifier_learns_from_all_trusted_documents(spark):
    n = 9000  # more than the 8,192 documents that once were the limit
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    d = labels.selectExpr("doc_id", "concat('word', doc_id, ' of ', doc_id % 3) AS text", "'en' AS lang")
    d = d.union(d.where("doc_id % 100 = 1")).union(d.where("doc_id = 7").selectExpr("doc_id", "'other text'", "lang"))
    train = quality_model.trusted(labels, "doc_id").where("fold_ <> 0")
    ids = quality_model.training_keys(d, labels, "doc_id", "text")
    assert sorted(r.key_ for r in ids.collect()) == sorted(r.key_ for r in train.collect())
    assert quality_model.training_texts(d, ids, "doc_id", "text").count() == train.count()  # one text a key
    got = quality_model.classify(d, labels).join(train.withColumnRenamed("key_", "doc_id"), "doc_id").where("doc_id <> 7")
    # a trained text has the one word that only it holds, and so the same probability as all the others of its kind
    assert got.count() > train.count() and max(r.m - r.l for r in got.groupBy(got.doc_id % 3).agg(
        {"log10_prob": "max"}).withColumnRenamed("max(log10_prob)", "m").join(got.groupBy(got.doc_id % 3).agg(
            {"log10_prob": "min"}).withColumnRenamed("min(log10_prob)", "l"), "(doc_id % 3)").collect()) < 1e-6


def test_scoring_gives_its_disk_back(spark, docs, rows, monkeypatch):
    """Before, chunks of all texts, questions and answers lay on disk together until the session ended."""
    folder = pathlib.Path(common.app_dir(spark).removeprefix("file://"))

    def tables(name):
        return {p for p in folder.glob(f"{name}-*")}
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    chunks, answers, most, keep, got = tables("lm-chunks"), tables("kn-answers"), [], common.Scratch.keep, {}
    monkeypatch.setattr(common.Scratch, "keep", lambda self, df, name: (
        keep(self, df, name), most.append(len(tables("lm-chunks") - chunks)))[0])
    for n in (1, 5):
        monkeypatch.setattr(quality_model, "SLICES", n)
        result = quality_model.classify(docs, labels)
        assert tables("lm-chunks") == chunks and tables("kn-answers") == answers and max(most) == 1
        got[n] = sorted((r.doc_id is None, r.doc_id, r.text_hash, r.lang or "", r.n_tokens, round(r.log10_prob, 6), r.kept)
                        for r in result.collect())
    assert len(got[1]) == len(rows) and got[1] == got[5]


def test_shuffle_files_of_a_kept_table_go(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {f for f in str(disk.getAllFiles().mkString(" ")).split() if "shuffle_" in f}
    old, conf = shuffles(), spark.conf.get(common.Scratch.CLEANUP, None)
    scratch = common.Scratch(spark)
    kept = scratch.keep(spark.range(1000).selectExpr("id % 7 AS k", "id").repartition(3, "k"), "test")
    until = time.time() + 20
    while [f for f in shuffles() - old if f.endswith(".data")] and time.time() < until:  # they go a moment after the job
        time.sleep(0.2)
    assert not [f for f in shuffles() - old if f.endswith(".data")]
    assert kept.count() == 1000 and spark.conf.get(common.Scratch.CLEANUP, None) == conf
    path = pathlib.Path(scratch.paths["test"][0].removeprefix("file://"))
    assert path.exists()
    scratch.drop("test")
    assert not path.exists()


def test_kept_tables_take_little_memory(spark):
    """Before, a writer held up to 100 rows of packed arrays whatever their size, and 30 MB of text were one Arrow batch."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([os.urandom(1 << 20)], pa.binary())], names=["n", "data"])
    scratch = common.Scratch(spark)
    texts = spark.range(3000, numPartitions=1).selectExpr("id", "repeat(cast(id as string), 10000 div length(cast(id as string))) AS t")
    kept = scratch.keep(texts.select("t").mapInArrow(sizes, "n long, data binary"), "test")
    most = [r.n for r in kept.select("n").collect()]
    assert len(most) >= 6 and max(most) < 2 * common.BATCH_BYTES
    rows = scratch.keep(spark.range(40, numPartitions=1).mapInArrow(
        lambda bs: (pa.RecordBatch.from_arrays([pa.array([i]), pa.array([os.urandom(1 << 20)], pa.binary())], names=["n", "data"])
                    for b in bs for i in b.column(0).to_pylist()), "n long, data binary"), "rows")
    files = [pq.ParquetFile(f) for f in pathlib.Path(scratch.paths["rows"][0].removeprefix("file://")).glob("*.parquet")]
    groups = [f.metadata.row_group(i).total_byte_size for f in files for i in range(f.num_row_groups)]
    assert rows.count() == 40 and max(groups) < 30 << 20
    for name in ("test", "rows"):
        scratch.drop(name)


def test_classifier_on_labelled_documents(spark):
    d, lab = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.classify(d, lab).join(lab, "doc_id").select("quality", "toxic", "kept").collect()
    good = [r.kept for r in got if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.6 * len(bad)
