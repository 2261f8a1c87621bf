"""Deleted interpolation: a bigram language model of the whole corpus.

p(w | v) = l2 * c(v, w) / c(v) + l1 * c(w) / N + l0 / (V + 1); the weights depend
on the frequency of the context v (one bucket per power of two) and are learned
by expectation-maximisation on held-out counts: a fold of the training documents
is deleted from the counts and its tokens are predicted from the rest. The final
counts are those of all training documents.

How the work is spread
* Texts become *chunks* of at most ``CHUNK`` tokens: the chunk's distinct words as
  64-bit hashes and its token sequence as places in that list. Chunks are written once.
* Every chunk asks for the counts of its distinct words and bigrams. Questions go
  to hash buckets of words and bigrams, in packed arrays (a hot word is one entry
  per chunk), are summed there, and the answers go back to the chunk.
* Weights: the answers about held-out bigrams give a histogram over context bucket
  and (logarithmic) estimates, of bounded size, on which EM runs.
* Scores: each chunk scores its tokens with its answers; a long document's chunks are added up.

Nothing but the histogram and the weights passes the driver. A chunk of a document
carries the token before it, so a document of any length is scored as a whole.

Defined results
* null text: empty, that is, one end token; null key: its number for folds is that of the text ``null``;
* rows are scored one by one, so repeated rows and keys give as many rows;
* no training document: N = V = 0, and all weight is on the uniform part;
* empty table: empty result; columns besides key and text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import key_text, materialize
from .packing import pack, pack_sorted, unpack, unpack_sorted

#: Bytes of text gathered for a chunk, tokens in a chunk at most, and entries of a bucket.
PIECE = 12 << 20
CHUNK = 1 << 21
BUCKET = 1 << 20
FOLDS = 7
#: Fold left out of training, and training fold whose counts are held out for the weights.
TEST_FOLD, WEIGHT_FOLD = 2, 3
#: Context buckets, and steps per octave of the histogram's estimates.
CONTEXTS = 48
STEPS = 4
EM_ROUNDS = 60

END = T.mix64(np.array([0x454E44], dtype=np.uint64))[0]
BEGIN = T.mix64(np.array([0x424547494E], dtype=np.uint64))[0]

_CHUNK = ("batch long, rid array<long>, key_ array<long>, fold array<int>, counts array<int>, before array<long>, "
          "words binary, seq binary, n long")


def chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The corpus as chunks (see above), written to the shared folder."""
    slim = docs.select(F.col(key).cast("long").alias("key_"),
                       F.pmod(F.crc32(key_text(F.col(key)).cast("binary")), F.lit(FOLDS)).cast("int").alias("fold"),
                       F.col(text).alias("t"))
    return write_chunks(slim)


def write_chunks(slim: DataFrame, piece: int = PIECE, chunk: int = CHUNK, keep=materialize) -> DataFrame:
    """Chunks of the rows (key_, fold, t; string columns beside them go with the chunk) of ``slim``, written by ``keep``."""
    more = [c for c in slim.columns if c not in ("key_", "fold", "t")]
    schema = _CHUNK + "".join(f", {c} array<string>" for c in more)

    def make(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            off, data = T.text_buffer(b.column("t"))
            keys, folds = b.column("key_").to_pylist(), b.column("fold").to_pylist()
            rest = [b.column(c).to_pylist() for c in more]
            base = uuid.uuid4().int >> 66
            for a, z in T.row_pieces(off, piece):
                _, h, counts = T.range_words(off, data, a, z)
                # each document gets its end token
                ends = np.cumsum(counts + 1)
                h = np.insert(h, np.cumsum(counts), END)
                prev = np.concatenate([[BEGIN], h[:-1]])
                prev[np.concatenate([[0], ends[:-1]])] = BEGIN
                starts = ends - counts - 1
                for lo in range(0, len(h), chunk):
                    hi = min(lo + chunk, len(h))
                    rows = np.arange(np.searchsorted(ends, lo, side="right"), np.searchsorted(starts, hi, side="left"))
                    n = np.minimum(ends[rows], hi) - np.maximum(starts[rows], lo)
                    uw, seq = np.unique(h[lo:hi], return_inverse=True)
                    first = prev[np.maximum(starts[rows], lo)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([uuid.uuid4().int >> 65], pa.int64()),
                        pa.array([[base + a + int(r) for r in rows]], pa.list_(pa.int64())),
                        pa.array([[keys[a + r] for r in rows]], pa.list_(pa.int64())),
                        pa.array([[folds[a + r] for r in rows]], pa.list_(pa.int32())),
                        pa.array([n.astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([first.view(np.int64)], pa.list_(pa.int64())),
                        pa.array([pack_sorted(uw)], pa.binary()), pa.array([pack(seq.astype(np.uint32))], pa.binary()),
                        pa.array([hi - lo], pa.int64()),
                        *[pa.array([[x[a + r] for r in rows]], pa.list_(pa.string())) for x in rest]],
                        names=[x.split()[0] for x in schema.split(", ")])
    return keep(slim.mapInArrow(make, schema), "lm-chunks")


class _Chunk:
    """A chunk's arrays: words (sorted), tokens and contexts as hashes, distinct bigrams (sorted)."""

    def __init__(self, row: dict):
        self.words = unpack_sorted(row["words"])
        self.seq = unpack(row["seq"]).astype(np.int64)
        self.counts = np.array(row["counts"], dtype=np.int64)
        self.fold = np.repeat(np.array(row["fold"], dtype=np.int64), self.counts)
        self.starts = np.cumsum(self.counts) - self.counts
        tok = self.words[self.seq]
        ctx = np.concatenate([tok[:1], tok[:-1]])
        ctx[self.starts] = np.array(row["before"], dtype=np.int64).view(np.uint64)
        self.ctx = ctx
        self.pairs, self.where = np.unique(T.pair_hash(ctx, tok), return_inverse=True)

    def sums(self, where: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(training count, count in the held-out fold) of each distinct entry."""
        train = np.bincount(where[self.fold != TEST_FOLD], minlength=n)
        held = np.bincount(where[self.fold == WEIGHT_FOLD], minlength=n)
        return train.astype(np.uint32), held.astype(np.uint32)

    def context_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct contexts of documents that begin in an earlier chunk are words too: all contexts but BEGIN."""
        return np.unique(np.concatenate([self.words, self.ctx[self.starts]])), self.words


def _questions(bits_w: int, bits_p: int):
    """mapInArrow: chunk -> packed questions per bucket. Buckets of words are even numbers, of bigrams odd ones."""
    def ask(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for row in b.to_pylist():
                c = _Chunk(row)
                words, own = c.context_words()
                at = np.searchsorted(words, own)
                wt, wh = np.zeros(len(words), np.uint32), np.zeros(len(words), np.uint32)
                wt[at], wh[at] = c.sums(c.seq, len(own))
                begin = np.searchsorted(words, BEGIN)
                if begin < len(words) and words[begin] == BEGIN:  # its count is the number of documents begun
                    f = np.array(row["fold"])[c.ctx[c.starts] == BEGIN]
                    wt[begin], wh[begin] = (f != TEST_FOLD).sum(), (f == WEIGHT_FOLD).sum()
                pt, ph = c.sums(c.where, len(c.pairs))
                out = []
                for kind, bits, h, t, held in ((0, bits_w, words, wt, wh), (1, bits_p, c.pairs, pt, ph)):
                    bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
                    edge = np.flatnonzero(np.diff(bucket)) + 1
                    for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(h)]):
                        if hi > lo:
                            out.append((2 * int(bucket[lo]) + kind, row["batch"], pack_sorted(h[lo:hi]),
                                        pack(t[lo:hi]), pack(held[lo:hi])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary(),
                                                                pa.binary()))],
                    names=["bucket", "batch", "h", "t", "held"])
    return ask


def _answers(table: pa.Table) -> pa.Table:
    """All questions of a bucket -> per question the sums over all chunks; for entries with held-out tokens also apart."""
    rows = table.to_pylist()
    h = [unpack_sorted(r["h"]) for r in rows]
    t, held = ([unpack(r[c]) for r in rows] for c in ("t", "held"))
    uniq, where = np.unique(np.concatenate(h), return_inverse=True)
    ct = np.bincount(where, weights=np.concatenate(t), minlength=len(uniq))
    ch = np.bincount(where, weights=np.concatenate(held), minlength=len(uniq))
    kind = rows[0]["bucket"] & 1
    out, at = [], 0
    for i, r in enumerate(rows):
        own = where[at:at + len(h[i])]
        at += len(h[i])
        part = own[held[i] > 0] if kind else own
        out.append((r["bucket"], r["batch"], pack(ct[own].astype(np.uint64)), pack(ct[part].astype(np.uint64)),
                    pack(ch[part].astype(np.uint64)), int((ct > 0).sum() - (kind == 0 and BEGIN in uniq and
                                                                           ct[np.searchsorted(uniq, BEGIN)] > 0))
                    if i == 0 else 0))
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
    return pa.Table.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*out), types)],
                                names=["bucket", "batch", "c", "ec", "eh", "types"])


def _joined(rows: list[dict], kind: int, col: str) -> np.ndarray:
    got = [unpack(r[col]) for r in sorted((r for r in rows if r["bucket"] & 1 == kind), key=lambda r: r["bucket"])]
    return np.concatenate(got).astype(np.float64) if got else np.empty(0)


def _context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the whole part of log2 of its count."""
    out = np.zeros(len(c), np.int64)
    seen = c > 0
    out[seen] = 1 + np.floor(np.log2(c[seen])).astype(np.int64)
    return np.minimum(out, CONTEXTS - 1)


def _held_out(batches: Iterator[pa.RecordBatch]):
    """chunk -> its distinct bigrams with held-out tokens: places of context and word, and counts."""
    for b in batches:
        for row in b.to_pylist():
            c = _Chunk(row)
            mine = c.fold == WEIGHT_FOLD
            _, held = c.sums(c.where, len(c.pairs))
            pick = np.flatnonzero(held)
            one = np.zeros(len(c.pairs), np.int64)
            one[c.where[mine]] = np.flatnonzero(mine)
            words, own = c.context_words()
            v = np.searchsorted(words, c.ctx[one[pick]]).astype(np.uint32)
            w = np.searchsorted(words, own)[c.seq[one[pick]]].astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["batch"]], pa.int64()), *[pa.array([pack(x)], pa.binary()) for x in
                                                         (v, w, held[pick].astype(np.uint32))]],
                names=["batch", "v", "w", "n"])


def _histogram(total: float, held_total: float):
    """cogroup function: held-out bigrams and answers of a chunk -> (context, level of q2, level of q1, sums)."""
    def level(q):
        out = np.full(len(q), -1, np.int64)
        ok = q > 0
        out[ok] = np.round(-np.log2(q[ok]) * STEPS).astype(np.int64)
        return out

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["ctx", "i2", "i1", "n", "s2", "s1"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        e = left.to_pylist()[0] if left.num_rows else None
        if e is None or not len(n := unpack(e["n"]).astype(np.float64)):
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        rows = right.to_pylist()
        cw = _joined(rows, 0, "ec") - _joined(rows, 0, "eh")
        cp = _joined(rows, 1, "ec") - _joined(rows, 1, "eh")
        cv = cw[unpack(e["v"]).astype(np.int64)]
        q2 = np.divide(cp, cv, out=np.zeros(len(cp)), where=cv > 0)
        q1 = cw[unpack(e["w"]).astype(np.int64)] / max(total - held_total, 1.0)
        cells = np.stack([_context_bucket(cv), level(q2), level(q1)], axis=1)
        uniq, where = np.unique(cells, axis=0, return_inverse=True)
        where = where.ravel()
        sums = [np.bincount(where, weights=x, minlength=len(uniq))
                for x in (n, n * np.log(np.where(q2 > 0, q2, 1)), n * np.log(np.where(q1 > 0, q1, 1)))]
        return pa.Table.from_arrays([*[pa.array(uniq[:, i]) for i in range(3)], *[pa.array(s) for s in sums]],
                                    names=names)
    return fn


def em_weights(cells: list[tuple], types: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (l2, l1, l0) per context bucket by expectation-maximisation.

    cells: (context bucket, level of q2, level of q1, tokens, sum of log q2, sum of log q1); level -1 is zero.
    """
    lam = np.tile([0.4, 0.5, 0.1], (CONTEXTS, 1))
    lam[0] = [0.0, 0.9, 0.1]
    if not cells:
        return np.tile([0.0, 0.0, 1.0], (CONTEXTS, 1))
    a = np.array(cells, dtype=np.float64)
    ctx, n = a[:, 0].astype(int), a[:, 3]
    q = np.stack([np.where(a[:, 1] < 0, 0, np.exp(a[:, 4] / n)), np.where(a[:, 2] < 0, 0, np.exp(a[:, 5] / n)),
                  np.full(len(a), 1.0 / (types + 1))], axis=1)
    for _ in range(rounds):
        part = lam[ctx] * q
        part *= (n / part.sum(axis=1))[:, None]
        got = np.stack([np.bincount(ctx, weights=part[:, i], minlength=CONTEXTS) for i in range(3)], axis=1)
        total = got.sum(axis=1)
        lam = np.where(total[:, None] > 0, got / np.maximum(total, 1e-300)[:, None], lam)
    # an unknown word must keep some probability in every bucket
    lam = np.maximum(lam, [0.0, 0.0, 1e-6])
    return lam / lam.sum(axis=1, keepdims=True)


def _scores(total: float, types: int, lam: np.ndarray):
    schema = ["rid", "key_", "held_out", "n_tokens", "n_known", "base_score", "score"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("answers without their chunk")
        row = left.to_pylist()[0]
        c = _Chunk(row)
        rows = right.to_pylist()
        words, own = c.context_words()
        cw, cp = _joined(rows, 0, "c"), _joined(rows, 1, "c")
        if len(cw) != len(words) or len(cp) != len(c.pairs):
            raise ValueError("a chunk lacks answers")
        cv = cw[np.searchsorted(words, c.ctx)]
        cw = cw[np.searchsorted(words, own)][c.seq]
        weights = lam[_context_bucket(cv)]
        p = (weights[:, 0] * np.divide(cp[c.where], cv, out=np.zeros(len(cv)), where=cv > 0)
             + weights[:, 1] * cw / max(total, 1.0) + weights[:, 2] / (types + 1))
        doc = np.repeat(np.arange(len(c.counts)), c.counts)

        def per_doc(x):
            return np.bincount(doc, weights=x, minlength=len(c.counts))
        base = per_doc(np.log10((cw + 1) / (total + types + 1)))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip((
            row["rid"], row["key_"], [f == TEST_FOLD for f in row["fold"]], c.counts,
            per_doc(cw > 0).astype(np.int64), base, per_doc(np.log10(p))), kinds)], names=schema)
    return fn


def score_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Trains on all rows but those of the test fold and scores all rows.

    Returns per row: key, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score
    (log10 probability of the whole text under the interpolated model).
    """
    corpus = chunks(docs, key, text)
    flat = corpus.select(F.explode(F.arrays_zip("fold", "counts")).alias("x")).select("x.fold", "x.counts")
    size = flat.agg(F.sum("counts"), F.sum(F.when(F.col("fold") != TEST_FOLD, F.col("counts"))),
                    F.sum(F.when(F.col("fold") == WEIGHT_FOLD, F.col("counts")))).first()
    everything, total, held = (int(x or 0) for x in size)
    bits = max(0, (everything // BUCKET).bit_length())
    asked = corpus.mapInArrow(_questions(max(0, bits - 3), bits),
                              "bucket long, batch long, h binary, t binary, held binary")
    answers = materialize(asked.groupBy("bucket").applyInArrow(
        _answers, "bucket long, batch long, c binary, ec binary, eh binary, types long"), "lm-answers")
    types = int(answers.where("bucket % 2 = 0").agg(F.sum("types")).first()[0] or 0)
    cells = (corpus.mapInArrow(_held_out, "batch long, v binary, w binary, n binary").groupBy("batch")
             .cogroup(answers.select("bucket", "batch", "ec", "eh").groupBy("batch"))
             .applyInArrow(_histogram(total, held), "ctx long, i2 long, i1 long, n double, s2 double, s1 double")
             .groupBy("ctx", "i2", "i1").agg(F.sum("n"), F.sum("s2"), F.sum("s1")))
    lam = em_weights([tuple(r) for r in cells.orderBy("ctx", "i2", "i1").collect()], types)
    out = (corpus.groupBy("batch").cogroup(answers.select("bucket", "batch", "c").groupBy("batch"))
           .applyInArrow(_scores(float(total), types, lam), "rid long, key_ long, held_out boolean, n_tokens long, "
                                                            "n_known long, base_score double, score double"))
    return (out.groupBy("rid").agg(F.first("key_").alias(key), F.first("held_out").alias("held_out"),
                                   F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
                                   F.lit(total).cast("long").alias("train_tokens"),
                                   F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
            .drop("rid"))
