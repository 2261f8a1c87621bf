"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are counted over all documents. A word weighs ``FLOOR_WEIGHT``
   plus the logarithm of its inverse frequency, so a passage that very many documents hold, or one of
   common words, still weighs; words that the benchmark does not have weigh nothing beside it.
2. A randomised SVD of TF-IDF passages gives the latent space: rows are the
   benchmark's passages, weighed ``ITEM_WEIGHT`` times, and all passages of all documents, which together weigh
   as much as ``CORPUS_PASSAGES``; columns are the benchmark's words. Tasks count the word pairs of their passages, the
   cells of this Gram matrix are added up by slices of rows, tasks multiply the slices with the current basis, and
   the driver orthogonalises a matrix of (words of a block of items) x (dimensions + 16).
3. Every document is walked whole in blocks of 32 words. Windows of two blocks are projected, and the projection's
   product with each benchmark passage, divided by the norms of both TF-IDF vectors, is their cosine.
   Windows that no passage can match are passed over before (``windows`` states the bound).
4. Candidates (per document and item the runs of adjacent windows above ``MIN_COSINE``, cut into
   stretches of ``REACH`` item lengths that overlap) are checked by the longest common subsequence of words:
   a document is contaminated by an item if at least ``LCS_SHARE`` of the item's words occur
   in order in one stretch; from ``PARAPHRASE_SHARE`` on also if ``ANSWER_SHARE`` of the words of the item's answer (its last sentence) do.

The benchmark is a stated query set. Items are cut into parts of ``ITEM_WORDS`` words and taken in
blocks of at most ``ITEM_BLOCK`` parts and about ``BLOCK_PASSAGES`` passages, so that the dimensions span
all passages of a block; a block's words and vectors go to all tasks.

Defined results
* null, empty or blank texts: not contaminated; items without a word match nothing;
* a document hit by several items names the one with the highest share, then the smallest item;
* null keys and repeated rows are judged row by row; empty tables: nothing is contaminated;
* a document without a stretch that may be a copy has share and cosine 0;
* columns besides key and text are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as T
from .common import materialize, settings
from .packing import pack, pack_sorted, unpack, unpack_sorted

ROW = "__row"
PIECE = 1 << 20
#: Blocks of words that a task compares with all passages at once.
STEP_BLOCKS = 2048
FEATURE_BITS = 18
DIMENSIONS = 320
OVERSAMPLE = 16
POWER_ROUNDS = 2
#: Weight of a benchmark passage in the fit, and the passages of weight 1 that all of the corpus together count as.
ITEM_WEIGHT = 8.0
CORPUS_PASSAGES = 1024
#: Weight of a word that all documents hold; rarer ones weigh more by the logarithm of their inverse frequency.
FLOOR_WEIGHT = 0.25
FIT_PARTS = 4
SLICE = 4096
#: Cells of the Gram matrix that a task counts in one pass, rows in a slice of it, and tasks summed in the first step.
GRAM_CELLS = 1 << 25
GRAM_ROWS = 256
GRAM_PARTS = 32
#: Windows are two blocks of words.
BLOCK = 32
#: The most frequent words of a block of items, whose products are bounded instead of added up.
LIGHT = 256
#: Words of a benchmark passage, and of an item at most (longer items are cut into several items).
PASSAGE = 48
ITEM_WORDS = 2048
ITEM_BLOCK = 256
#: Passages after which a block ends. Blocks have DIMENSIONS, or SPARE_DIMENSIONS more than passages if that is more.
BLOCK_PASSAGES = 250
SPARE_DIMENSIONS = 64
MIN_COSINE = 0.5
#: Item lengths of text that one check reads; a copy drawn out to one length less lies in one stretch.
REACH = 3
LCS_SHARE = 0.6
PARAPHRASE_SHARE = 0.4
ANSWER_SHARE = 0.8


def _features(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def idf(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """(damped inverse document frequencies of the hashed words, documents). All documents are counted."""
    def count(batches: Iterator[pa.RecordBatch]):
        pa.default_memory_pool().release_unused()
        df, n = np.zeros(1 << FEATURE_BITS, np.uint32), 0
        for b in batches:
            off, data = T.text_buffer(b.column("t"))
            n += b.num_rows
            for a, z in T.row_pieces(off, PIECE):
                row, h, _ = T.range_words(off, data, a, z)
                pairs = np.sort((row << FEATURE_BITS) | _features(h))
                once = np.flatnonzero(np.diff(pairs, prepend=-1))
                df += np.bincount(pairs[once] & ((1 << FEATURE_BITS) - 1), minlength=len(df)).astype(np.uint32)
        for s in range(0, len(df), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array([s >> 14], pa.int64()),
                                              pa.array([pack(df[s:s + (1 << 14)])], pa.binary()),
                                              pa.array([n if s == 0 else 0], pa.int64())], names=["s", "df", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(1 << 14, np.uint64)
        for x in t["df"]:
            total += unpack(x.as_py())
        return pa.Table.from_arrays([pa.array([t["s"][0].as_py()], pa.int64()), pa.array([pack(total)], pa.binary()),
                                     pa.array([sum(t["n"].to_pylist())], pa.int64())], names=["s", "df", "n"])
    schema = "s long, df binary, n long"
    with settings(docs.sparkSession):
        rows = (docs.select(F.col(text).alias("t")).mapInArrow(count, schema).groupBy("s")
                .applyInArrow(add, schema).collect())  # 2^18 counters, whatever the input
    df, n = np.zeros(1 << FEATURE_BITS), 0
    for r in rows:
        df[r.s << 14:(r.s + 1) << 14] = unpack(r.df)
        n += r.n
    return FLOOR_WEIGHT + np.log((n + 1) / (df + 1)), n


# -- latent space ------------------------------------------------------------

def _passages(h: np.ndarray, size: int = PASSAGE) -> list[np.ndarray]:
    if not len(h):
        return []
    return [h[i:i + size] for i in range(0, max(1, len(h) - size // 2), size // 2)]


def _orthonormal(z: np.ndarray) -> np.ndarray:
    """Orthonormal basis of the columns (Cholesky QR, twice; dependent columns are left out)."""
    for _ in range(2):
        gram = np.zeros((z.shape[1], z.shape[1]))
        for s in range(0, len(z), SLICE):  # in blocks of rows: no copy of z in double precision
            block = z[s:s + SLICE].astype(np.float64)
            gram += block.T @ block
        val, vec = np.linalg.eigh(gram)
        good = val > val.max() * 1e-10 if len(val) and val.max() > 0 else np.zeros(len(val), bool)
        z = (z @ (vec[:, good] / np.sqrt(val[good])).astype(np.float32)).astype(np.float32, copy=False)
    return z


def _row_starts(lo: int, hi: int, n: int) -> np.ndarray:
    """Where rows lo..hi of an upper triangle of n rows begin in an array that begins with row lo (the last: its length)."""
    x = np.arange(lo, hi + 1)
    at = x * n - x * (x - 1) // 2
    return at - at[0]


def _add_passages(total: np.ndarray, h: np.ndarray, counts: np.ndarray, place: np.ndarray, weight: np.ndarray, n: int,
                  lo: int, hi: int) -> int:
    """Adds the word pairs of all passages of some texts, and returns the number of passages with words of the benchmark.

    ``total`` is the upper triangle U of the Gram matrix D (U + U') D of the passages' TF-IDF rows of norm 1 (D: the weights of
    the ``n`` words), rows lo..hi-1 one after another, each from its diagonal on. A passage is two blocks of PASSAGE / 2 words,
    the second also the first one of the next passage.
    """
    half = PASSAGE // 2
    n_blocks = -(-counts // half)
    first = np.cumsum(n_blocks) - n_blocks
    last = np.zeros(int(n_blocks.sum()) + 1, bool)
    last[(first + n_blocks)[n_blocks > 0] - 1] = True
    alone = np.zeros(len(last), bool)
    alone[first[n_blocks == 1]] = True
    in_row = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = place[_features(h)]
    known = at >= 0
    blk, at = (np.repeat(first, counts) + in_row // half)[known], at[known]
    energy = np.bincount(blk, weight[at] ** 2, minlength=len(last))
    energy[:-1] += np.where(last[:-1], 0.0, energy[1:])
    use = (energy > 0) & (~last | alone)
    share = np.divide(1.0, energy, out=np.zeros(len(last)), where=use)
    across = np.where(last, 0.0, share).astype(np.float32)
    within = share.astype(np.float32)
    within[1:] += across[:-1]
    mine = (at >= lo) & (at < hi) if (lo, hi) != (0, n) else None
    row_start = _row_starts(lo, hi, n)[:-1] - np.arange(lo, hi)

    def add(x: np.ndarray, y: np.ndarray, value: np.ndarray) -> None:
        x, y = np.minimum(x, y), np.maximum(x, y)
        if mine is not None:
            own = (x >= lo) & (x < hi)
            x, y, value = x[own], y[own], value[own]
        np.add.at(total, row_start[x - lo] + y, value)
    add(at, at, within[blk] * np.float32(0.5))
    i = np.arange(len(at))
    for d in range(1, PASSAGE):
        i = i[:np.searchsorted(i, len(at) - d)]
        gap = blk[i + d] - blk[i]
        near = gap <= 1
        i, gap = i[near], gap[near]
        if not len(i):
            break
        value = np.where(gap == 0, within[blk[i]], across[blk[i]])
        add(at[i], at[i + d], value)
    return int(use.sum())


def _gram(texts: DataFrame, kind: int, held, n: int) -> DataFrame:
    """Pairs of words of all passages of ``texts`` (t: text, or word hashes as binary): kind, s, at, v, passages.

    Per slice of GRAM_ROWS rows of U (see ``_add_passages``), from row s: places of its cells, their values, number of passages.
    """
    hashed = dict(texts.dtypes)["t"] == "binary"
    width = max(1, GRAM_CELLS // n)

    def count(lo: int):
        hi = min(n, lo + width)

        def run(batches: Iterator[pa.RecordBatch]):
            pa.default_memory_pool().release_unused()
            place, weight = held.value
            starts = _row_starts(lo, hi, n)
            total, passages = np.zeros(starts[-1], np.float32), 0
            for b in batches:
                if hashed:
                    for x in b.column("t"):
                        h = np.frombuffer(x.as_buffer(), np.uint64)
                        passages += _add_passages(total, h, np.array([len(h)]), place, weight, n, lo, hi)
                    continue
                off, data = T.text_buffer(b.column("t"))
                for a, z in T.row_pieces(off, PIECE):
                    _, h, counts = T.range_words(off, data, a, z)
                    passages += _add_passages(total, h, counts, place, weight, n, lo, hi)
            part = TaskContext.get().partitionId() // GRAM_PARTS
            for s in range(lo, hi, GRAM_ROWS):
                e = min(hi, s + GRAM_ROWS)
                first = starts[s - lo:e - lo] - starts[s - lo]
                cells = total[starts[s - lo]:starts[e - lo]]
                found = np.flatnonzero(cells)
                row = np.searchsorted(first, found, side="right") - 1
                yield _slice(part, s, found - first[row] + row * (n + 1) + s, cells[found], passages if s == 0 else 0)
        return run

    def add(t: pa.Table) -> pa.Table:
        total = None
        for at, v in zip(t["at"], t["v"]):
            at, v = unpack_sorted(at.as_py()).astype(np.int64), np.frombuffer(v.as_buffer(), np.float32)
            total = np.zeros(GRAM_ROWS * n, np.float64) if total is None else total
            total[at] += v
        found = np.flatnonzero(total)
        return pa.Table.from_batches([_slice(t["part"][0].as_py(), t["s"][0].as_py(), found, total[found],
                                             sum(t["passages"].to_pylist()))])
    schema = "part long, s long, at binary, v binary, passages long"
    out = None
    for lo in range(0, n, width):  # one pass where U fits a task
        got = texts.mapInArrow(count(lo), schema)
        out = got if out is None else out.union(got)
    out = out.groupBy("part", "s").applyInArrow(add, schema).withColumn("part", F.lit(0).cast("long"))
    return out.groupBy("part", "s").applyInArrow(add, schema).select(F.lit(kind).alias("kind"), "s", "at", "v", "passages")


def _slice(part: int, s: int, at: np.ndarray, value: np.ndarray, passages: int) -> pa.RecordBatch:
    """Cells of the rows from s: ``at`` counts from the first cell of row s, n to a row."""
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([s], pa.int64()), pa.array([pack_sorted(at.astype(np.uint64))], pa.binary()),
         pa.array([value.astype(np.float32).tobytes()], pa.binary()), pa.array([passages], pa.int64())],
        names=["part", "s", "at", "v", "passages"])


def fit_space(docs: DataFrame, items: list[np.ndarray], weight: np.ndarray, text: str,
              dims: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(place of each feature in the basis or -1, basis: features x dimensions, times the IDF weights).

    All passages of all documents are in the fit; together they weigh as much as CORPUS_PASSAGES of weight 1.
    """
    spark = docs.sparkSession
    seen = np.zeros(1 << FEATURE_BITS, bool)
    for h in items:
        seen[_features(h)] = True
    place = np.full(len(seen), -1, np.int64)
    place[seen] = np.arange(seen.sum())
    n = int(seen.sum())
    if not n:
        return place, np.zeros((0, 1), np.float32)
    own = weight[seen].astype(np.float32)
    held = spark.sparkContext.broadcast((place, own.astype(np.float64)))
    of_items = spark.createDataFrame([(h.tobytes(),) for h in items if len(h)], "t binary")
    with settings(spark):
        table = materialize(_gram(docs.select(F.col(text).alias("t")), 0, held, n)
                            .union(_gram(of_items, 1, held, n)).repartition(FIT_PARTS, "s"), "lsa-gram")
    held.destroy()
    passages = table.where("kind = 0").agg(F.sum("passages")).first()[0] or 0
    scales = (CORPUS_PASSAGES / max(passages, 1), ITEM_WEIGHT ** 2)
    q = np.random.default_rng(7).standard_normal((n, min(dims + OVERSAMPLE, n)), dtype=np.float32)
    for _ in range(POWER_ROUNDS):
        z = _product(table, scales, own, q)
        del q  # the driver holds one such matrix beside those in work
        q = _orthonormal(z)
        del z
    small = (q.T @ _product(table, scales, own, q)).astype(np.float64)
    val, vec = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(val)[::-1][:dims]
    basis = q @ vec[:, top].astype(np.float32)
    np.multiply(basis, own[:, None], out=basis, casting="same_kind")
    return place, basis


def _product(table: DataFrame, scales: tuple[float, float], own: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Gram matrix times q, added up over all tasks by slices of rows.

    The sums are with the driver when the job ends, so nothing needs the broadcast factor any more. They come as
    Arrow batches of GRAM_ROWS rows, a few hundred KB each, and go straight to their place.
    """
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(q * own[:, None])
    n, cols = q.shape

    def product(batches: Iterator[pa.RecordBatch]):
        q = shared.value
        total = np.zeros((n, cols), np.float32)
        for b in batches:
            for kind, s, at, v in zip(*(b.column(c) for c in ("kind", "s", "at", "v"))):
                s = s.as_py()
                rows = np.zeros((min(GRAM_ROWS, n - s), n), np.float32)
                rows.ravel()[unpack_sorted(at.as_py()).astype(np.int64)] = np.frombuffer(v.as_buffer(), np.float32)
                rows *= np.float32(scales[kind.as_py()])
                total[s:s + len(rows)] += rows @ q
                total += rows.T @ q[s:s + len(rows)]
        for s in range(0, n, GRAM_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([total[s:s + GRAM_ROWS].tobytes()],
                                                                                  pa.binary())], names=["s", "m"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float32) for x in t["m"])
        return pa.Table.from_arrays([pa.array([t["s"][0].as_py()], pa.int64()),
                                     pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["s", "m"])
    with settings(spark):
        parts = table.mapInArrow(product, "s long, m binary").groupBy("s").applyInArrow(add, "s long, m binary").toArrow()
    shared.destroy()
    del shared
    z = np.empty((n, cols), np.float32)
    for s, m in zip(parts["s"].to_pylist(), parts["m"]):
        rows = np.frombuffer(m.as_buffer(), np.float32).reshape(-1, cols)
        z[s:s + len(rows)] = rows
    z *= own[:, None]
    return z


# -- search and checks -------------------------------------------------------

def lcs_length(a: list[int], b: list[int]) -> int:
    """Longest common subsequence, with the places of ``a`` as bits of one integer."""
    if not a or not b:
        return 0
    places: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        places[x] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if x in places:
            u = v & places[x]
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def answer_words(text: str) -> int:
    """Number of words of the last sentence: what follows the last full stop, mark or line end before the end."""
    body = text.rstrip(" \t\n\x0b\x0c\r.?!")
    at = max([m.end() for m in re.finditer(r"[.?!][ \t\n\x0b\x0c\r]|\n", body)], default=0)
    return len([w for w in re.split(r"[\x20\x09-\x0D]+", body[at:]) if w])


def stretches(hits: list[list], length: int, n_words: int):
    """The text to check: (from, to, highest cosine) per run of adjacent windows (from, to, cosine) in ``hits``.

    A run reaches an item's length beyond its windows; longer ones are cut into overlapping
    stretches of REACH item lengths, so that the text between and around windows adds nothing.
    """
    runs: list[list] = []
    for lo, hi, cos in sorted(hits):
        if runs and lo <= runs[-1][1]:
            runs[-1][1:] = [max(hi, runs[-1][1]), max(cos, runs[-1][2])]
        else:
            runs.append([lo, hi, cos])
    for lo, hi, cos in runs:
        lo, hi = max(0, lo - length), min(n_words, hi + length)
        for at in range(lo, max(lo + 1, hi - (REACH - 1) * length), length):
            yield at, min(hi, at + REACH * length), min(1.0, cos)


class _Index:
    """The passages of a block of items: latent vectors, postings of their rarer words, norms of their common ones."""

    def __init__(self, passages: list[np.ndarray], place: np.ndarray, basis: np.ndarray, weight: np.ndarray):
        self.place, self.basis = place, basis
        self.weight = weight[place >= 0]  # by place
        self.vectors = np.zeros((len(passages), basis.shape[1]), np.float32)
        self.light = np.full(len(self.weight), -1)
        lightest = np.argsort(self.weight, kind="stable")[:LIGHT]
        self.light[lightest] = np.arange(len(lightest))
        self.light_weight = self.weight[lightest]
        self.light_norm = np.zeros(len(passages))
        feature, passage, value = [], [], []
        for i, p in enumerate(passages):
            at = place[_features(p)]
            norm = max(np.sqrt((self.weight[at] ** 2).sum()), 1e-12)
            self.vectors[i] = basis[at].sum(axis=0) / norm
            own, count = np.unique(at, return_counts=True)
            v, common = count * self.weight[own] / norm, self.light[own] >= 0
            self.light_norm[i] = np.sqrt((v[common] ** 2).sum())
            feature.append(own[~common])
            passage.append(np.full((~common).sum(), i))
            value.append(v[~common])
        feature, self.passage, self.value = (np.concatenate(x) if x else np.empty(0) for x in (feature, passage, value))
        order = np.argsort(feature, kind="stable")
        self.passage, self.value = self.passage[order].astype(np.int64), self.value[order]
        self.n_posts = np.bincount(feature.astype(np.int64), minlength=len(self.weight))
        self.first_post = np.cumsum(self.n_posts) - self.n_posts


def windows(h: np.ndarray, counts: np.ndarray, index: _Index, min_cosine: float):
    """Windows that some passage may match: (row, first word in row, words, vectors).

    Words that the benchmark does not have weigh nothing. A vector is the projection divided by the norm of the window's
    TF-IDF vector. Only windows that can reach ``min_cosine`` are projected: the products of their rarer words with each
    passage are added up from postings, those of common words are at most the product of their norms (Cauchy-Schwarz).
    """
    n_blocks = -(-counts // BLOCK)
    first = np.cumsum(counts) - counts
    block_row = np.repeat(np.arange(len(counts)), n_blocks)
    in_row = np.arange(len(block_row)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    edges = np.append(first[block_row] + in_row * BLOCK, len(h))
    places = index.place[_features(h)]
    n = len(index.vectors)
    for s in range(0, len(block_row), STEP_BLOCKS):
        e = min(len(block_row), s + STEP_BLOCKS + 1)  # one more: a window goes on into the next block
        at = places[edges[s]:edges[e]]
        known = at >= 0
        blk, at = np.repeat(np.arange(e - s), np.diff(edges[s:e + 1]))[known], at[known]
        w = index.weight[at]
        energy = np.bincount(blk, w * w, minlength=e - s)
        common = index.light[at] >= 0
        light = np.bincount(blk[common] * LIGHT + index.light[at[common]], minlength=(e - s) * LIGHT).reshape(-1, LIGHT).astype(np.float32)
        posts = index.n_posts[at]
        rep = np.repeat(np.arange(len(at)), posts)
        post = np.repeat(index.first_post[at] - np.cumsum(posts) + posts, posts) + np.arange(len(rep))
        heavy = np.bincount(blk[rep] * n + index.passage[post], w[rep] * index.value[post], minlength=(e - s) * n).reshape(-1, n)
        same = np.append(block_row[s + 1:e] == block_row[s:e - 1], False)
        after = np.flatnonzero(same)
        for x in (energy, light, heavy):
            x[after] += x[after + 1].copy()
        norm = np.sqrt(energy)
        norms = np.sqrt(((light[:, :len(index.light_weight)] * index.light_weight) ** 2).sum(axis=1))
        may = (heavy + norms[:, None] * index.light_norm).max(axis=1, initial=0) >= min_cosine * norm
        pick = np.flatnonzero(may[:STEP_BLOCKS] & (norm[:STEP_BLOCKS] > 0))
        if not len(pick):
            continue
        need = np.zeros(e - s, bool)
        need[pick] = True
        need[pick[same[pick]] + 1] = True
        own = need[blk]
        blk, at = blk[own], at[own]
        vec = np.zeros((e - s, index.basis.shape[1]), np.float32)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(blk)) + 1, [len(blk)]])
        for i in range(0, len(cut) - 1, 256):
            part = cut[i:i + 257]
            vec[blk[part[:-1]]] = np.add.reduceat(index.basis[at[part[0]:part[-1]]], part[:-1] - part[0], axis=0)
        out = vec[pick]
        out[same[pick]] += vec[pick[same[pick]] + 1]
        yield block_row[s + pick], in_row[s + pick] * BLOCK, 2 * BLOCK, out / norm[pick][:, None].astype(np.float32)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                 item: str = "item_id", item_text: str = "text", carry: tuple[str, ...] = (),
                 min_cosine: float = MIN_COSINE) -> DataFrame:
    """Per row: key, carried columns, contaminated, item (or null), lcs_share, cosine."""
    b = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    b = materialize(b.mapInArrow(_parts, "item long, h binary, answer long, passages long"), "lsa-items")
    order = Window.orderBy("item", "h")
    nth = F.row_number().over(order) - 1
    before = F.sum("passages").over(order.rowsBetween(Window.unboundedPreceding, -1))
    b = b.select("*", F.floor(nth / ITEM_BLOCK).alias("i"),
                 F.floor(F.coalesce(before, F.lit(0)) / BLOCK_PASSAGES).alias("p"))
    b = materialize(b, "lsa-blocks")
    weight, _ = idf(docs, text)
    blocks = sorted((r.i, r.p) for r in b.select("i", "p").distinct().collect())
    carried = (*carry, ROW) if len(blocks) > 1 else carry
    if len(blocks) > 1:
        docs = docs.withColumn(ROW, F.xxhash64(text))
    parts = [_one_block(docs, b.where((F.col("i") == i) & (F.col("p") == p)), weight, key, text, carried, min_cosine)
             for i, p in blocks]
    if not parts:
        return docs.select(key, *carry, F.lit(False).alias("contaminated"), F.lit(None).cast("long").alias("item"),
                           F.lit(0.0).alias("lcs_share"), F.lit(0.0).alias("cosine"))
    if len(parts) == 1:
        return parts[0]
    # one row per row of docs and block of items; rows are matched by all carried columns and the text's checksum
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = F.max(F.struct("contaminated", "lcs_share", -F.col("item"), "cosine")).alias("b")
    n = len(parts)
    out = out.groupBy(key, *carried).agg(best, F.floor(F.count(F.lit(1)) / n).alias("m"))
    out = out.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m").cast("long"))))
    return out.select(key, *carry, "b.contaminated", (-F.col("b.col3")).alias("item"), "b.lcs_share", "b.cosine")


def _parts(batches: Iterator[pa.RecordBatch]):
    """Items (item, t) -> their parts of ITEM_WORDS words at most: word hashes, words of the answer, passages."""
    for b in batches:
        for item, t in zip(b.column("item").to_pylist(), b.column("t").to_pylist()):
            off, data = T.text_buffer(pa.array([t], pa.string()))
            _, h, _ = T.range_words(off, data, 0, 1)
            cut = [h[i:i + ITEM_WORDS] for i in range(0, len(h), ITEM_WORDS)]
            answer = [0] * (len(cut) - 1) + [answer_words(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(cut), pa.int64()), pa.array([x.tobytes() for x in cut], pa.binary()),
                 pa.array(answer[:len(cut)], pa.int64()), pa.array([len(_passages(x)) for x in cut], pa.int64())],
                names=["item", "h", "answer", "passages"])


def _one_block(docs, items, weight, key, text, carry, min_cosine) -> DataFrame:
    """All documents against one block of items."""
    spark = docs.sparkSession
    rows = items.orderBy("item", "h").collect()  # ITEM_BLOCK parts at most
    ids, answers = [r.item for r in rows], [r.answer for r in rows]
    words = [np.frombuffer(r.h, np.uint64) for r in rows]
    dims = max(DIMENSIONS, sum(r.passages for r in rows) + SPARE_DIMENSIONS)
    place, basis = fit_space(docs, words, weight, text, dims=dims)
    cut = [(i, p) for i, h in enumerate(words) for p in _passages(h)]
    of = np.array([i for i, _ in cut], np.int64)
    # a task's view of the block: its parts' words, its passages and the basis over their words
    shared = spark.sparkContext.broadcast((_Index([p for _, p in cut], place, basis, weight) if cut else None, of,
                                           ids, [w.tolist() for w in words], answers))

    scanned = text if text in carry else "__t"

    def judge(row_words: np.ndarray, hits: dict[int, list[list]]) -> tuple:
        ids, words, answers = shared.value[2:]
        best = (False, 0.0, None, 0.0)
        row = row_words.tolist()
        for i, found in hits.items():
            w = words[i]
            own, ans = set(w), set(w[-answers[i]:]) if answers[i] else set()
            for lo, hi, cos in stretches(found, len(w), len(row)):
                # a subsequence has no more words than are shared and the item's repeats: too few need no check
                near = own.intersection(row[lo:hi])
                most = len(near) + len(w) - len(own)
                if most < PARAPHRASE_SHARE * len(w) or most < LCS_SHARE * len(w) and (
                        not ans or len(near & ans) + answers[i] - len(ans) < ANSWER_SHARE * answers[i]):
                    continue
                near = row[lo:hi]
                share = lcs_length(w, near) / len(w)
                ok = share >= LCS_SHARE
                if not ok and share >= PARAPHRASE_SHARE and answers[i]:
                    ok = lcs_length(w[-answers[i]:], near) >= ANSWER_SHARE * len(w[-answers[i]:])
                rank = (ok, share, -ids[i] if ids[i] is not None else float("-inf"))
                if rank > (best[0], best[1], -best[2] if best[2] is not None else float("-inf")):
                    best = (ok, share, ids[i], cos)
        return best

    def search(batches: Iterator[pa.RecordBatch]):
        index, of = shared.value[:2]
        pa.default_memory_pool().release_unused()  # what an earlier task of this worker has left
        for b in batches:
            off, data = T.text_buffer(b.column(scanned))
            for a, z in T.row_pieces(off, PIECE):
                _, h, counts = T.range_words(off, data, a, z)
                found: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
                if index is not None and len(h):
                    for row, at, size, lat in windows(h, counts, index, min_cosine):
                        cos = lat @ index.vectors.T
                        for w, p in zip(*np.nonzero(cos >= min_cosine)):
                            x, c = int(at[w]), float(cos[w, p])
                            runs = found[int(row[w])][int(of[p])]
                            if runs and runs[-1][0] <= x <= runs[-1][1]:  # windows come in order
                                runs[-1][1:] = [max(x + size, runs[-1][1]), max(c, runs[-1][2])]
                            else:
                                runs.append([x, x + size, c])
                ends = np.cumsum(counts)
                out = [judge(h[ends[r] - counts[r]:ends[r]], found[r]) if r in found else (False, 0.0, None, 0.0)
                       for r in range(z - a)]
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(a, z - a) for c in b.schema.names if c != "__t"],
                     pa.array(cols[0], pa.bool_()), pa.array([x if f else None for x, f in zip(cols[2], cols[0])],
                                                             pa.int64()),
                     pa.array(cols[1], pa.float64()), pa.array(cols[3], pa.float64())],
                    names=[*[c for c in b.schema.names if c != "__t"], "contaminated", "item", "lcs_share", "cosine"])
    # a carried text crosses to Python once
    slim = docs.select(key, *carry) if scanned == text else docs.select(key, *carry, F.col(text).alias("__t"))
    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in (key, *carry)])
    return slim.mapInArrow(search, schema + ", contaminated boolean, item long, lcs_share double, cosine double")
