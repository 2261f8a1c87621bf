"""Runs of words: every stretch against a plain search over all periods, the contract's digests, edge cases."""
import hashlib
import random
import zlib

import numpy as np
import pytest

from barengine.llm import periodicity as P
from barengine.llm.common import table
from tests.llm.corpus_rows import SF01, docs, empty, rows  # noqa: F401


def plain_runs(w):
    """(start, length, period) of all runs, by comparing words at every distance."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(
                    all(w[i + x] == w[i + x + d] for x in range(length - d)) for d in range(1, q) if q % d == 0):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(w, key):
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def expected(key, text):
    w = planted([x for x in (text or "").encode().split()], key)
    runs = plain_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return (key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest())


def found(texts):
    """Runs of lists of numbers, all in one piece."""
    n = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(n + 1) - n - 1
    c = np.array([x for i, t in enumerate(texts) for x in [*t, -1 - i]], np.int64)
    of, runs = P.find_runs(c, first, n)
    out = [[] for _ in texts]
    for i, r in zip(of.tolist(), runs.tolist()):
        out[i].append(tuple(r))
    return out


def test_all_runs_of_random_texts():
    r = random.Random(5)
    texts = []
    for _ in range(400):
        t = [r.randrange(r.choice([2, 3, 50])) for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):  # runs of any period beside each other, with inner repeats and defects
            unit = [r.randrange(r.choice([2, 40])) for _ in range(r.randrange(1, 70))]
            if r.random() < 0.3:
                unit = unit + unit[:len(unit) // 2 + 1]
            t += (unit * 6)[:r.randrange(2 * len(unit), 6 * len(unit) + 1)]
            if r.random() < 0.3:
                t[r.randrange(len(t))] = 7
        texts.append(t)
    texts += [[], [1], [1] * 5, [1] * 6, [1] * 3000, [1, 2, 3] * 400, list(range(200)) * 4, list(range(200)) * 3 + list(range(199)),
              [0, 1] * 3, [0, 1] * 4, list(range(8)) * 4, list(range(9)) * 4, list(range(16)) * 4, list(range(17)) * 4]
    got = found(texts)
    assert got == [plain_runs(t) for t in texts]
    assert {q for g in got for _, _, q in g} >= {1, 2, 8, 9, 16, 17, 200}  # direct and scaled periods


@pytest.mark.parametrize("q", [9, 16, 31, 32, 33, 64, 100])
def test_exactly_four_periods(q):
    """The shortest stretch that counts is found at every offset of the scales; one word less is not."""
    texts = []
    for lead in range(0, 40, 3):
        head, unit, tail = [1000 + i for i in range(lead)], list(range(q)), [2000 + i for i in range(30)]
        texts += [head + unit * 4 + tail, head + (unit * 4)[:-1] + tail]
    got = found(texts)
    assert got[0::2] == [[(lead, 4 * q, q)] for lead in range(0, 40, 3)]
    assert not any(got[1::2])


def test_query_against_plain_search(spark):
    d = table(spark, SF01, "documents").where("length(text) < 6000")
    got = {tuple(r) for r in P.run_report(P.with_planted_runs(d)).collect()}
    assert got == {expected(r.doc_id, r.text) for r in d.collect()}
    assert sum(r[1] > 0 for r in got) > 20


def test_edges(spark, rows, docs, empty):  # noqa: F811
    """Null and repeated keys, null and empty texts, long texts, clashing columns, an empty table."""
    got = sorted(map(tuple, P.run_report(P.with_planted_runs(docs)).collect()), key=str)
    assert got == sorted((expected(r[0], r[1]) for r in rows), key=str)
    clash = docs.withColumn("runs", docs.node).withColumn("collapsed", docs.node).withColumn("__k", docs.node) \
        .withColumn("n_words", docs.node).withColumn("start", docs.node)
    assert sorted(map(tuple, P.run_report(clash).collect()), key=str) == sorted(map(tuple, P.run_report(docs).collect()), key=str)
    assert P.run_report(P.with_planted_runs(empty)).collect() == []
    r = P.collapse_runs(spark.createDataFrame([(1, "a b A b A b A b A b c  c")], "doc_id long, text string")).first()
    assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (12, [(1, 9, 2)], "a b A c c")


def test_long_text(spark):
    """A text of several pieces with one run over piece borders."""
    unit = " ".join(f"word{i}" for i in range(50_000))
    text = "lead " + " ".join([unit] * 5) + " end"
    r = P.collapse_runs(spark.createDataFrame([(1, text), (2, "x y")], "doc_id long, text string")).where("doc_id = 1").first()
    assert [tuple(x) for x in r.runs] == [(1, 250_000, 50_000)] and r.collapsed == "lead " + unit + " end"
