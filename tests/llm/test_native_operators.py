"""Sharding, mixing and quality rules against plain Python."""
import collections
import hashlib
import math
import re
import zlib

from pyspark.sql import functions as F
from barengine.llm import mixing, quality, sharding

from corpus_rows import docs, empty, rows  # noqa: F401


def split_words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def jump(seed, n):
    key, b, j = seed, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = math.floor((b + 1) * (2.0 ** 31 / ((key >> 33) + 1)))
    return b


def seed_of(key):
    return int(hashlib.md5(("null" if key is None else str(key)).encode()).hexdigest()[:16], 16)


def test_shards_follow_the_published_algorithm(docs, rows):
    for n in (1, 5, 40, 1000):
        got = collections.Counter((r.doc_id, r.s, r.g) for r in
                                  sharding.with_shard(docs, "doc_id", n, "s", "g").select("doc_id", "s", "g").collect())
        assert got == collections.Counter((r[0], jump(seed_of(r[0]), n), jump(seed_of(r[0]), n + 1)) for r in rows)


def test_shard_table(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 2)
    out = sharding.shard_table(docs, n_shards=7, carry=("lang",)).collect()
    size = {(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in out} == size and len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 7) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = sharding.shard_table(docs.repartition(5), n_shards=7, carry=("lang",)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    assert sharding.shard_table(empty).count() == 0


def fill(sizes, weights, cap=3):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, budget = set(), sum(sizes.values())
    while True:
        rest = budget - sum(cap * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in full else t[s] for s in order}
        full.update(over)


def test_mix_matches_a_plain_queue(docs, rows, empty):
    n = {r: len(split_words(r[1])) for r in rows}
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += n[r]
    target = fill(sizes, (5, 2, 1))
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)

    def place(r):
        k = "null" if r[0] is None else str(r[0])
        c = zlib.crc32((r[1] or "").encode())
        return int(hashlib.md5(f"{k}|{c}|0".encode()).hexdigest()[:8], 16), k, c
    times = collections.defaultdict(list)
    for s in sizes:
        mine = sorted((r for r in rows if r[3] == s), key=place)
        for r in mine:
            cum = sum(n[x] for x in mine if place(x) <= place(r))
            for e in range(3):
                if n[r]:
                    times[(cum + e * sizes[s]) / target[s]].append(n[r])
    left, cut = sum(sizes.values()), -1
    for t in sorted(times):
        left -= sum(times[t])
        if left < 0:
            break
        cut = t
    exp = collections.Counter()
    for s in sizes:
        mine = sorted((r for r in rows if r[3] == s), key=place)
        for r in mine:
            cum = sum(n[x] for x in mine if place(x) <= place(r))
            c = sum((cum + e * sizes[s]) / target[s] <= cut for e in range(3)) if n[r] else 0
            exp[(r[0], n[r], sizes[s], round(target[s], 6), c * n[r])] += 1
    assert collections.Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == exp
    # the mixed rows are the documents the report takes
    copies = collections.Counter((r.doc_id, r.text) for r in mixing.mix(docs).collect())
    taken = {(r.doc_id, r["size"]): r.taken for r in got if r["size"]}
    keys = {(r[0], r[1]) for r in rows}
    for k in keys:
        words = len(split_words(k[1]))
        twins = sum((r[0], r[1]) == k for r in rows)
        if words:
            assert copies[k] * words == taken[(k[0], words)] * twins
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_hot_keys_spread_over_the_queue(spark):
    """A third of the rows under no key, a third equal: the order's largest bucket stays small, equal rows are one entry."""
    rows = [(None, f"text {i}", "s") for i in range(1000)] + [(7, "one text of five words", "s")] * 1000
    rows += [(10 + i, f"more {i}", "t") for i in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    decided, _ = mixing.queue(d)
    shares = [r["count"] for r in decided.groupBy("__src", F.shiftright("__h", 22)).count().collect()]
    assert decided.count() == 2001 and max(shares) < 20
    got = mixing.mix_report(d).groupBy("doc_id", "taken").count().collect()
    assert sum(r["count"] for r in got) == 3000 and len([r for r in got if r.doc_id == 7]) == 1


def plain_rules(text):
    w = split_words(text)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(tri)
    repeat = {j for i, t in enumerate(tri) if c[t] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if split_words(x)]
    return (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)),
            len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w))


def test_quality_rules(docs, rows, empty):
    got = quality.line_frequency(docs, line_docs=1).collect()
    host_lines = collections.defaultdict(set)

    def norm(x):
        return re.sub("[ \t-\r]+", " ", re.sub("[1-9]", "0", x.lower())).strip(" ")
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if split_words(x):
                host_lines[(r[3], norm(x))].add((r[0], r[1]))
    exp = collections.Counter()
    for r in rows:
        base = plain_rules(r[1])
        lost = sum(len(split_words(x)) for x in (r[1] or "").split("\n")
                   if split_words(x) and len(host_lines[(r[3], norm(x))]) > 1)
        exp[(r[0], *base, not base[5] and lost <= 0.5 * base[0])] += 1
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert collections.Counter((r.doc_id, *[r[c] for c in cols]) for r in got) == exp
    assert quality.line_frequency(empty).count() == 0


def test_passage_in_one_percent_of_a_large_host(spark):
    passage = " ".join(f"legal{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}" for i in range(60))
    letters = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    own = F.concat_ws(" ", *[F.concat(letters, F.lit(x)) for x in "qrstuv"])
    d = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("h").alias("source"), F.when(
        F.col("id") % 100 == 0, F.concat(own, F.lit("\n" + passage))).otherwise(own).alias("text"))
    got = {(r.n_words > 50, r.removed_share > 0.5, r.kept): r["count"] for r in quality.line_frequency(d).groupBy(
        "n_words", "removed_share", "kept").count().collect()}
    assert got == {(True, True, False): 1000, (False, False, False): 99_000}


def test_copies_of_one_text_count_as_documents(spark):
    body = "\n".join(" ".join(f"{c}{x}" for x in "abcdefghijklm") for c in "pqrstuv")
    rows = [(i, body, "h") for i in range(1000)] + [(i, body + " own", "few") for i in range(quality.LINE_DOCS)]
    rows += [(5, body, "one")] * 500  # one document, repeated
    rows += [(None, body, "gone")] * 500
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id if r.doc_id is None or r.doc_id < 20 else 20, r.kept): r["count"]
           for r in quality.line_frequency(d).groupBy("doc_id", "kept").count().collect()}
    assert got[(5, True)] == 501 and got[(5, False)] == 1 and got[(0, True)] == 1 and got[(None, True)] == 500
    assert (20, True) not in got and quality.line_frequency(d).where("NOT kept").count() == 1000


def test_lines_above_the_limits_leave_the_text(spark):
    d = spark.createDataFrame([(i, f"own {i} text\nMenu 1 Home\nmore {i}", "h") for i in range(6)] + [(9, None, "h")],
                              "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in quality.cleaned(d, line_docs=4).collect()}
    # digits are folded, so "own i text" and "more i" recur as well
    assert got[9] is None and all(got[i] == "" for i in range(6))
    d = spark.createDataFrame([(i, f"{'abcdef'[i]} text\nMenu {i} Home", "h") for i in range(6)],
                              "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in quality.cleaned(d, line_docs=4).collect()}
    assert got == {i: f"{'abcdef'[i]} text" for i in range(6)}
