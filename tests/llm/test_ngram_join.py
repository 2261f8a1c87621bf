"""Near duplicates against all pairs in plain Python."""
import collections
import re

import pytest
from barengine.llm import ngram_join

from corpus_rows import docs, empty, rows  # noqa: F401


def shingles(text, k):
    w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, percent):
    sets = [shingles(r[1], k) for r in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                comp[find(i)] = find(j)
    out = collections.Counter()
    for i, r in enumerate(rows):
        if not sets[i]:
            out[(r[0], 0, r[0])] += 1
            continue
        keys = [rows[j][0] for j in range(len(rows)) if sets[j] and find(j) == find(i) and rows[j][0] is not None]
        out[(r[0], len(sets[i]), min(keys, default=None))] += 1
    return out


@pytest.mark.parametrize("k,percent,block", [(3, 90, 1024), (5, 80, 3)])
def test_components(docs, rows, monkeypatch, k, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "HEAVY_IN_PIECE", 2)
    got = ngram_join.near_duplicates(docs, k=k, percent=percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, k, percent)


def test_one_of_each(docs, rows):
    comps = brute(rows, 5, 80)
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    kept = collections.Counter(r.doc_id for r in got.collect())
    assert set(kept) == {k for k, _, c in comps if k == c} and max(kept.values()) == 1


@pytest.mark.parametrize("limit", [500_000, 0])
def test_other_texts_under_one_key_stay(spark, docs, rows, monkeypatch, limit):
    monkeypatch.setattr(ngram_join, "BROADCAST_KEYS", limit)
    import corpus_pipeline
    own = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(60)]
    keyed = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in own]  # a third null, a third one key
    near = own[1][1] + " end"  # near copies: under the hot key, a key of its own and no key
    blank = [(7, ""), (7, ""), (8, None), (None, " ")]
    d = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in keyed + [(7, near), (500, near), (None, near)] + blank],
                              "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, d.repartition(3), "")
    assert got.columns == d.columns
    got = collections.Counter((r.doc_id, r.text) for r in got.collect())
    twin = {(7, own[1][1]), (7, near)}
    assert len(twin & set(got)) == 1 and max(got.values()) == 1
    assert set(got) - twin == (set(keyed) | set(blank)) - twin
    # one row of each component of the common rows, two texts of one key among them
    sets = [shingles(r[1], 5) for r in rows]
    kept = [r for r in ngram_join.one_per_component(docs).collect()]
    left = [shingles(r.text, 5) for r in kept]
    link = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    assert not any(link(a, b) for i, a in enumerate(left) for b in left[:i])
    alone = [r[:2] for r, s in zip(rows, sets) if s and sum(bool(link(s, x)) for x in sets) == 1]
    assert set(alone) <= {(r.doc_id, r.text) for r in kept}
    assert sum(r.doc_id == rows[4][0] for r in kept) == 2


def test_empty(empty):
    assert ngram_join.one_per_component(empty).count() == 0
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.one_of_each(empty).count() == 0
