"""Decontamination, WARC bundles, HTML extraction, license scan, pipeline."""
import collections
import hashlib
import random
import time
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import zstandard
from barengine.llm import decontamination, extraction, html_tree, licenses, tokens, warc

from corpus_rows import SF001, docs, empty, rows  # noqa: F401


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    r = random.Random(0)
    for _ in range(50):
        a, b = ([r.randrange(5) for _ in range(r.randrange(12))] for _ in range(2))
        assert decontamination.lcs_length(a, b) == lcs(a, b)


def test_product_with_the_gram_matrix_is_light_on_the_driver(spark):
    """The driver holds the factor and its pickled copy, or the result: not the collected rows, their sum and its product beside it."""
    n, cols = 3000, 256
    rng = np.random.default_rng(3)
    rows = []
    for s in range(0, n, decontamination.GRAM_ROWS):
        i = np.arange(s, min(n, s + decontamination.GRAM_ROWS))
        b = decontamination._slice(0, s, (i - s) * n + i, rng.random(len(i)), 0).to_pylist()[0]
        rows.append((0, s, b["at"], b["v"]))
    diagonal = np.concatenate([np.frombuffer(r[3], np.float32) for r in rows])
    cells = spark.createDataFrame(rows, "kind long, s long, at binary, v binary")
    own, q = rng.random(n).astype(np.float32), rng.random((n, cols)).astype(np.float32)
    tracemalloc.start()
    try:
        z = decontamination._product(cells, (1.0, 1.0), own, q)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert z.dtype == np.float32
    assert np.allclose(z, q * (2 * diagonal * own ** 2)[:, None], rtol=1e-4)
    assert peak < 3.6 * q.nbytes


def test_decontamination(spark, empty):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]

    def text(n):
        return [r.choice(vocab) for _ in range(n)]
    items = [text(n) for n in (15, 30, 45, 60, 200)]
    docs, exp = [], {}
    for i in range(120):
        w = text(r.randint(20, 400))
        if i % 4 == 0:
            k = (i // 4) % len(items)
            q = list(items[k])
            if i % 8 == 0:  # a paraphrase: one word in seven is another one
                for j in range(0, len(q), 7):
                    q[j] = r.choice(vocab)
            at = r.randrange(len(w))
            w[at:at] = q
            exp[i] = k
        docs.append((i, " ".join(w), "extra"))
    docs += [(None, " ".join(items[0]), "x"), (500, None, "x"), (501, "", "x"), (502, " ".join(text(30000)), "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, " ")],
                              "item_id long, text string")
    got = {x.doc_id: x for x in decontamination.contaminated(d, b).collect()}
    assert len(got) == len(docs)
    assert {k: x.item for k, x in got.items() if x.contaminated} == {**exp, None: 0}
    # brute force over all documents and items agrees that nothing else reaches the limit
    for i, t, _ in docs[:30]:
        if i not in exp:
            w = t.split()
            assert all(lcs(q, w[s:s + 3 * len(q)]) < 0.6 * len(q) for q in items for s in range(0, len(w), len(q)))
    assert decontamination.contaminated(empty, b).count() == 0
    assert not [x for x in decontamination.contaminated(d, b.limit(0)).collect() if x.contaminated]


def test_item_in_a_third_of_the_rows(spark):
    r = random.Random(8)
    rare = (f"{x:06x}" for x in r.sample(range(1 << 24), 60000))
    common = ["".join(r.choice("klmnop") for _ in range(5)) for _ in range(40)]  # each in nearly all documents
    items = [[next(rare) for _ in range(n)] for n in (12, 30, 50)] + [r.sample(common, 14)]
    docs, exp = [], {}
    for i in range(300):
        w = [next(rare) for _ in range(r.randint(60, 120))]
        for c in r.sample(common, 36):
            w.insert(r.randrange(len(w) + 1), c)
        k = 0 if i % 3 == 0 else {1: 1, 4: 2, 7: 3}.get(i % 90)
        if k is not None:
            at = r.randrange(len(w))
            w[at:at] = items[k]
            exp[i] = k
        docs.append((i, " ".join(w)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = decontamination.contaminated(d, b).where("contaminated").collect()
    assert {x.doc_id: x.item for x in got} == exp


def test_long_clean_topical_document(spark):
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    items = [r.sample(vocab, n) for n in (15, 18, 40)]
    long = [r.choice(vocab) for _ in range(20000)]
    for q in items:  # a few words of each item at places far apart
        for at in (1000, 7000, 19000):
            long[at:at + len(q) // 3] = q[:len(q) // 3]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(200))) for i in range(60)] + [(100, " ".join(long))]
    docs += [(101 + i, " ".join(long[:9000] + q + long[9000:])) for i, q in enumerate(items)]
    for q in items:
        assert lcs(q, long[1000:7000]) >= 0.6 * len(q) and all(
            lcs(q, long[s:s + 3 * len(q)]) < 0.6 * len(q) for s in range(0, len(long), len(q)))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {x.doc_id: x.item for x in decontamination.contaminated(d, b).collect() if x.contaminated}
    assert got == {101: 0, 102: 1, 103: 2}


def test_many_long_items(spark):
    r = random.Random(13)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(20000)]

    def text(n):
        return [r.choice(vocab) for _ in range(n)]
    items = [text(500) for _ in range(256)]
    docs = [(i, " ".join(text(200) + items[4 * i] + text(100))) for i in range(64)]
    docs += [(None, " ".join(items[9])), (None, " ".join(text(300)))] + [(100 + i, " ".join(text(700))) for i in range(8)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = decontamination.contaminated(d, b).collect()
    assert len(got) == len(docs)  # null keys are judged row by row, also over many blocks
    assert collections.Counter((x.doc_id, x.item) for x in got if x.contaminated) == collections.Counter(
        [*[(i, 4 * i) for i in range(64)], (None, 9)])


@pytest.mark.parametrize("cells", [1 << 25, 1 << 12])
def test_space_is_fitted_on_all_passages_of_all_documents(spark, monkeypatch, cells):
    monkeypatch.setattr(decontamination, "GRAM_CELLS", cells)  # the second value: several passes over the rows
    monkeypatch.setattr(decontamination, "ITEM_WEIGHT", 0.0)
    r = random.Random(17)
    vocab = [f"w{i}" for i in range(120)]
    # each document has its own words, so any sample of them misses directions
    docs = [(i, " ".join(r.choices(vocab[i % 20 * 6:i % 20 * 6 + 9], k=r.choice([3, 48, 49, 70, 2000])))) for i in range(160)]
    docs += [(None, None), (900, ""), (901, "unheard " * 60)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)

    def hashes(t):
        return tokens.range_words(*tokens.text_buffer(pa.array([t])), 0, 1)[1]
    items = [hashes(" ".join(vocab))]
    weight = np.random.default_rng(2).random(1 << decontamination.FEATURE_BITS) + 0.5
    place, basis = decontamination.fit_space(d, items, weight, "text", dims=12)
    n = int((place >= 0).sum())
    own, gram = weight[place >= 0], np.zeros((n, n))
    for _, t in docs:
        for p in decontamination._passages(hashes(t or "")):
            at = place[decontamination._features(p)]
            x = np.bincount(at[at >= 0], minlength=n) * own
            norm = (own[at[at >= 0]] ** 2).sum()
            gram += np.outer(x, x) / norm if norm else 0
    v = basis / own[:, None]
    assert np.allclose(v.T @ v, np.eye(12), atol=1e-3)
    assert np.trace(v.T @ gram @ v) > 0.98 * np.linalg.eigvalsh(gram)[-12:].sum()


@pytest.mark.parametrize(("lo", "hi"), [(0, 30), (4, 11)])
def test_word_pairs_take_half_a_matrix(lo, hi):
    """Before, a task held all n * n cells though only those from the diagonal on are counted."""
    r = np.random.default_rng(5)
    n, counts = 30, np.array([0, 5, 24, 60, 48])
    place = np.full(1 << decontamination.FEATURE_BITS, -1)
    place[:n] = np.arange(n)
    words = r.integers(0, 40, counts.sum())
    weight = r.random(n) + 0.5
    total = np.zeros(sum(n - x for x in range(lo, hi)), np.float32)
    h = words.astype(np.uint64) << np.uint64(64 - decontamination.FEATURE_BITS)
    decontamination._add_passages(total, h, counts, place, weight, n, lo, hi)
    want = np.zeros((n, n))
    for c, e in zip(counts, np.cumsum(counts)):
        for p in decontamination._passages(words[e - c:e]):
            x = np.bincount(p[p < n], minlength=n)
            if x.any():
                want += np.outer(x, x) / (weight[p[p < n]] ** 2).sum()
    want[np.diag_indices(n)] /= 2
    got = np.zeros((n, n))
    rows, cols = np.triu_indices(n)
    mine = (rows >= lo) & (rows < hi)
    got[rows[mine], cols[mine]] = total
    assert np.allclose(got[lo:hi], np.triu(want)[lo:hi], rtol=1e-4)


def test_blocks_of_items_agree(spark, monkeypatch):
    d, b = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {(x.doc_id, x.contaminated, x.item) for x in decontamination.contaminated(d, b).collect()}
    monkeypatch.setattr(decontamination, "ITEM_BLOCK", 15)
    assert {(x.doc_id, x.contaminated, x.item) for x in decontamination.contaminated(d, b).collect()} == whole


PAGES = "page_id long, url string, html string, text string, n_chars string"


def page_rows():
    big = "<p>" + "same payload " * 20
    return [(3, "http://a/1", big), (1, "http://a/2", big), (2, None, big), (4, "http://a/\n%x", "short"),
            (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "é" * 200_000),
            (1, "http://a/2", big), (9, "u", "unique " * 30)]


def test_warc_roundtrip(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).repartition(2)
    got = warc.roundtrip(pages).collect()
    first = {}
    for k, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and k is not None:
            first[b] = min(k, first.get(b, k))
    exp = collections.Counter()
    for k, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        revisit = f is not None and k != f
        exp[(k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None)] += 1
    assert collections.Counter(map(tuple, got)) == exp
    index = warc.write_bundles(pages, f"file://{tmp_path}/w", date="2024-01-31T12:00:00Z")
    back = warc.read_records(index).collect()
    assert collections.Counter((r.page_key, r.url) for r in back) == collections.Counter(
        (None if k is None else str(k), u) for k, u, _ in rows)
    # every frame can be decompressed alone, and all of them make up the bundle
    for path in {r.bundle for r in index.collect()}:
        fs, where = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(where) as f:
            table = warc.seek_table(f)
            plain = b"".join(zstandard.ZstdDecompressor().decompress(f.read_at(n, at)) for at, n, _ in table)
            whole = f.read_at(f.size(), 0)
        assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(whole) == plain
        assert plain.startswith(b"WARC/1.1")
        records = plain.count(b"\r\nWARC-Record-ID: ")
        assert records == plain.count(b"\r\nWARC-Date: 2024-01-31T12:00:00Z\r\n") == plain.count(b"\r\nContent-Type: text/html; charset=utf-8\r\n")
    assert warc.roundtrip(pages.limit(0)).count() == 0


def test_extraction(spark):
    t = lambda h: extraction.main_text(h, set())
    assert t('<header>Site</header><main><h1>T &amp; U</h1><p>a  b\n c<br>d<p>e</p><div class="cookie-notice">n</div>'
             '<section id="comments"><p>c</p></section><form>f</form></main><footer>z</footer>') == "T & U\na b c d\ne"
    assert t('<div class="has-sidebar"><article><header><h1>H</h1></header><p>x<script>a<b</script>y</p>'
             '<ul><li>1<li>2</ul></article></div><aside>s</aside>') == "H\nxy\n1\n2"
    assert t("plain &lt;text") == "plain <text" and t("") == "" and t("<p>a</p><p>b") == "a\nb"
    assert t("<table><tr><td>1<td>2<tr><td>3</table><!-- no --><p>a<![CDATA[<b>]]>") == "1\n2\n3\na<b>"
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<body><div>Buy our things<b>now</b></div><div><p>text {i} of page</p></div>")
            for i in range(30)]
    rows += [(40, "http://h0.org/c", "<p>copy</p>")] * 9
    rows += [(50, None, None), (51, "x", ""), (52, "http://h3/", "<article>" + "<p>w</p>" * 20000)]
    for i in range(60, 70):  # a passage that all articles of a host share stays
        rows.append((i, f"http://n.org/{i}", f"<article><p>shared words</p><p>own {i}</p><div class='box'>Follow us</div></article>"))
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    got = extraction.extract(pages).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert all(by[i] == f"text {i} of page" for i in range(30)) and by[40] == "copy" and by[50] == by[51] == ""
    assert by[52] == "\n".join(["w"] * 20000) and all(by[i] == f"shared words\nown {i}" for i in range(60, 70))
    assert extraction.extract(pages.limit(0)).count() == 0


def test_names_forms_and_junk_of_pages():
    t = lambda h, x=(): extraction.main_text(h, set(x))
    assert t('<article><div class="entry-header"><h1>Title</h1></div><p>body</p></article>') == "Title\nbody"
    assert t('<article><div class="share-price"><p>price rose</p></div><div class="share-bar">Share</div>'
             '<p class="alert">flood</p><div class="search-results-study"><p>found</p></div></article>') == "price rose\nflood\nfound"
    assert t('<form action="/"><div class="site-footer">foot</div><article><p>in a form</p></article></form>') == "in a form"
    prose = "some words of an article " * 20
    assert t(f'<body><form><div><h2>H</h2><p>{prose}</p></div><select><option>x</select></form></body>') == "H\n" + prose.strip()
    assert t(f"<body><form><p>Log in</p><input></form><p>{prose}</p></body>") == prose.strip()
    start = time.time()
    n = 100_000
    for junk in ("<b>" * n + "</i>" * n, "<b><div>" + "<i>" * n + "</b>" * n, "<p><table>" + "<b>" * n + "<p>" * n):
        html_tree.parse(junk)
    assert time.time() - start < 15


def test_templates_against_a_plain_count(spark):
    """Pages without main or article: recurring subtrees decide, as a plain count of subtrees says."""
    rng = random.Random(4)
    boxes = [f"<div><span>box {i}</span><b>more</b></div>" for i in range(12)]
    rows = []
    for i in range(160):
        body = "".join(b for j, b in enumerate(boxes) if rng.random() < j / 20)
        rows.append((i, f"https://h{i % 3}.net/p{i}", f"<body>{body}<div><p>own {i}</p><p>and {i}</p></div></body>"))
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], PAGES)
    count = collections.Counter((i % 3, b) for i, _, h in rows for b in boxes if b in h)
    by = {r.page_id: r.text for r in extraction.extract(pages).collect()}
    shown = 0
    for i, _, h in rows:
        left = [f"box {j}more" for j, b in enumerate(boxes) if b in h and count[(i % 3, b)] < extraction.MIN_PAGES]
        shown += len(left)
        assert by[i] == "\n".join([*left, f"own {i}", f"and {i}"])
    assert shown and max(count.values()) > extraction.MIN_PAGES


def test_box_on_one_percent_of_a_large_host(spark):
    box = "<div class='mid'>Read <b>our</b> offers</div>"
    rows = [(i, f"http://big.org/{i}", f"<body>{box if i % 100 == 0 else ''}<div><p>text {i} of page</p></div>")
            for i in range(3000)]
    rows += [(5000 + i, "http://few.org/", f"<body>{box if i < 4 else ''}<div><p>text {i}</p></div>") for i in range(100)]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], PAGES)
    by = {r.page_id: r.text for r in extraction.extract(pages).collect()}
    assert all(by[i] == f"text {i} of page" for i in range(3000))
    assert by[5000] == "Read our offers\ntext 0" and by[5099] == "text 99"


def test_licenses(spark):
    noise = "some words that speak of quite other things than rights and terms\n" * 4
    rows = [("r/LICENSE", "Released under the MIT License"), ("r/a/x.py", noise), ("r/a/b/y.py", noise),
            ("r/a/b/COPYING", noise + "This work is licensed under the GNU General Public License, version 3."),
            ("r/a/z.py", "code\n# Licensed under the Apache License,\n# Version 2.0\n" + noise), ("q/n.py", noise),
            ("r/e.py", ""), ("r/f.py", None), (None, noise), (None, None), ("r/a/x.py", noise)]
    rows += [(f"m/{i}", noise) for i in range(60)]
    f = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(rows)], "id long, path string, text string, license string")
    got = {r.id: r for r in licenses.scan_licenses(f, "id", "path", "text").collect()}
    assert len(got) == len(rows)
    lic = [got[i].license for i in range(11)]
    assert lic == ["MIT", "MIT", "GPL-3.0", "GPL-3.0", "Apache-2.0", None, "MIT", "MIT", None, None, "MIT"]
    assert got[0].is_license_file and got[3].is_license_file and got[2].license_dir == "r/a/b"
    assert licenses.scan_licenses(f.limit(0), "id", "path", "text").count() == 0


def test_header_in_a_third_of_the_files(spark):
    r = random.Random(2)
    head = ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in "
            "compliance with the License.\n# You may obtain a copy of the License at\n")
    noise = lambda: " ".join(f"w{r.randrange(3000)}" for _ in range(60))
    rows = [(i, f"r/{i % 7}/{i}.py", f"the code of {i}\n" + (head if i % 3 == 0 else "") + noise()) for i in range(300)]
    rows += [(300, "q/LICENSE", head + noise()), (301, "q/a.py", noise()), (302, "p/a.py", "use of the file under version")]
    f = spark.createDataFrame(rows, "id long, path string, text string")
    got = {x.id: x for x in licenses.scan_licenses(f, "id", "path", "text").collect()}
    assert {i for i, x in got.items() if x.own_license == "Apache-2.0"} == {*range(0, 300, 3), 300}
    assert got[300].is_license_file and got[301].license == "Apache-2.0" and got[302].license is None


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    now, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF001)
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), docs.schema)
        sizes.append(now.count())
    clean = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    kept = corpus_pipeline.quality(spark, docs, SF001).select("doc_id").collect()
    assert len(clean - {r.doc_id for r in kept}) <= max(1, 0.03 * len(clean))
    assert sizes[1] >= sizes[2] >= sizes[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, now, SF001)
    assert out.count() == sizes[4] and {"doc_id", "shard", "slot"} <= set(out.columns)
    # one row per copy and the same rows from the run as a whole
    assert sorted(map(repr, corpus_pipeline.run(spark, SF001).collect())) == sorted(map(repr, out.collect()))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty2 = stage(spark, empty, SF001)
        assert empty2.count() == 0
