"""Phrase mining against plain counting, whole results; chunks of a few words; edge cases."""
import re
from collections import Counter

import pytest

from barengine.llm import common
from barengine.llm import phrases as S
from tests.llm.corpus_rows import docs, empty, rows  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(texts, min_count, top=2000, longest=4):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase of (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in texts:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[(lang, *w[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    over = Counter()
    for p, a in cand.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                q = (p[0], *p[i:i + m])
                over[q] = max(over[q], a)
    out = []
    for p, a in cand.items():
        if 100 * over[p] >= 80 * a:
            continue
        score, cut = min((2000000 * a // (f[p[:c + 1]] + f[(p[0], *p[c + 1:])]), c) for c in range(1, len(p) - 1))
        out.append((p[0], " ".join(p[1:]), a, f[p[:cut + 1]], f[(p[0], *p[cut + 1:])], n[p[0]], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(lang, i + 1, *o[1:]) for i, o in enumerate(own[:top])]
    return sorted(ranked)


@pytest.mark.parametrize("min_count, chunk, top", [(2, 1 << 22, 2000), (3, 50, 2000), (2, 1, 5)])
def test_all_phrases(rows, docs, min_count, chunk, top):  # noqa: F811
    """Null languages, texts and keys, copies, repeated rows, long texts; results do not depend on the chunks."""
    d = docs.withColumn("chunk", docs.node).withColumn("word", docs.node).withColumn("n", docs.node)
    got = sorted(map(tuple, S.collocations(d, min_count=min_count, chunk_words=chunk, top=top).collect()))
    want = plain([(r[1], r[2]) for r in rows], min_count, top)
    assert len(want) > 10 and got == want


def test_pieces_marks_and_longer_candidates(spark):
    """Phrases end at marks and line ends; a part of a longer phrase goes only from 80 percent on."""
    texts = [("New York City. new york city; NEW york\tCity", "en")] * 4 + [("new york", "en")] * 2 + [
        ("a b\x0bc d", None), ("a b, c d", None), ("Été Été", "fr"), (None, "fr"), ("", "xx")] * 3
    d = spark.createDataFrame(texts, "text string, lang string")
    got = sorted(map(tuple, S.collocations(d, min_count=3).collect()))
    assert got == plain(texts, 3)
    kept = {r[2] for r in got}
    assert "new york city" in kept and "new york" not in kept and "b c" not in kept and {"a b", "c d"} <= kept
    assert any(r[0] == "und" for r in got)


def test_exact_beyond_64_bits(spark):
    """Scores and shares of counts near 10^15 are computed without overflow."""
    r = spark.sql("SELECT cast(2000000 as decimal(18,0)) * cast(9000000000000000 as decimal(20,0)) div "
                  "(cast(9000000000000001 as decimal(20,0)) + cast(9000000000000002L as bigint)) AS s").first()
    assert r.s == 2000000 * 9000000000000000 // (9000000000000001 + 9000000000000002)


def test_nothing_frequent(spark, docs, empty):  # noqa: F811
    assert S.collocations(empty).collect() == []
    assert S.collocations(docs, min_count=10 ** 6).collect() == []
    blank = spark.createDataFrame([(" \n.,", "en"), (None, None)], "text string, lang string")
    assert S.collocations(blank, min_count=1).collect() == []


def test_a_word_in_every_text(spark):
    """One word on all rows: it has one group row per chunk, whatever its count."""
    texts = [(" ".join(["the"] * 30 + [f"w{i % 7}"]), "en") for i in range(300)]
    d = spark.createDataFrame(texts, "text string, lang string").repartition(5)
    assert sorted(map(tuple, S.collocations(d, min_count=5, chunk_words=200).collect())) == plain(texts, 5)


def test_chunks_of_many_words_are_cut(spark, monkeypatch):
    """Before, all 1.2 million words were one row, and a task's arrays for it took some 200 MB."""
    keep, rows = common.Scratch.keep, {}

    def counted(self, df, name):
        out = keep(self, df, name)
        rows[name] = out.count()
        return out
    monkeypatch.setattr(common.Scratch, "keep", counted)
    d = spark.range(300, numPartitions=1).selectExpr("repeat(concat('a b c', id % 3, ' d '), 1000) AS text", "'en' AS lang")
    got = S.collocations(d).collect()
    assert rows["r0"] == 3
    assert got and sorted(got) == sorted(S.collocations(d, chunk_words=1 << 21).collect()) and rows["r0"] == 1
