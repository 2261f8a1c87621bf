"""Runs of repeated words: stretches of a text that repeat their first words again and again.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) and a length of at least ``max(SHORTEST, EXPONENT * q)`` that no neighbouring
word extends keeping period q. Every text is walked whole; the words of a piece of
about ``T.PIECE`` bytes of texts are numbered by a dictionary, so equality is exact.

1. Periods of at most ``DIRECT`` words: words are compared with those q places on, for each q.
2. Longer periods, by scales of 16, 32, 64 ... words. At scale s every place has the hash of
   the s words that start there, and the minima of all windows of s / 2 places are picked. In a
   run with a period q of s / 2 + 1 .. s words the window at a place and that q places on hold the same
   words, so their minima are q apart and carry the same hash; as s >= q, no other place
   between them does. Neighbouring equal minima of a text therefore are the only seeds needed, those with a
   distance of s / 2 + 1 .. s. Two windows and their hashes reach over q + s / 2 + s - 1 < 4 q words,
   so no run is missed. A seed is extended word by word to both sides.
3. A text without two equal minima at a scale has no run of a longer period and is left out of the next scales.

Work is linear in the text for each scale that a text reaches; memory is that of one piece or one text.

Defined results
* null, empty and blank texts: no words, no runs, an empty collapsed text;
* a word is dropped from the collapsed text if some run contains it after that run's first q words;
* rows are judged one by one: null and repeated keys and repeated rows stay as they are, ties do not arise;
* empty table: no rows; columns besides key and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import words

#: Shortest run, and its least length in periods. The scales rely on four periods.
SHORTEST = 6
EXPONENT = 4
#: Periods found by comparing words directly; a power of two.
DIRECT = 8

RUNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Numbers(dict):
    """Words -> numbers in order of arrival."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


@lru_cache(maxsize=4096)
def _prime_divisors(q: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return tuple(out + [q] if q > 1 else out)


def _primitive(c: np.ndarray, s: int, q: int) -> bool:
    """Whether a stretch of period q (four periods at least) has no smaller period; that would divide q."""
    for p in _prime_divisors(q):
        d = q // p
        if np.array_equal(c[s:s + 2 * q - d], c[s + d:s + 2 * q]):
            return False
    return True


def _matching(c: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch of places i around ``at`` (from, to) with c[i] == c[i + lag]."""
    top = len(c) - lag
    hi, step = at, 64
    while hi < top:
        end = min(top, hi + step)
        bad = np.flatnonzero(c[hi:end] != c[hi + lag:end + lag])
        if len(bad):
            hi += int(bad[0])
            break
        hi, step = end, step * 2
    lo, step = at, 64
    while lo > 0:
        start = max(0, lo - step)
        bad = np.flatnonzero(c[start:lo] != c[start + lag:lo + lag])
        if len(bad):
            lo = start + int(bad[-1]) + 1
            break
        lo, step = start, step * 2
    return lo, hi


def _direct(c: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(place, length, period) of the runs with periods up to DIRECT."""
    for q in range(1, min(DIRECT, len(c) - 1) + 1):
        edge = np.diff((c[q:] == c[:-q]).astype(np.int8), prepend=0, append=0)
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for i in np.flatnonzero(hi - lo + q >= max(SHORTEST, EXPONENT * q)):
            if _primitive(c, int(lo[i]), q):
                yield int(lo[i]), int(hi[i] - lo[i]) + q, q


def _doubled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of twice ``size`` words from those of ``size``; what runs over the end equals nothing."""
    after = np.concatenate([h[size:], T.mix64(np.arange(min(size, len(h)), dtype=np.uint64) + np.uint64(1 << 63))])
    return T.mix64(h * np.uint64(0xD6E8FEB86659FD93) + (after ^ (after >> np.uint64(29))))


def _minima(h: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the smallest hash of some window of ``width`` (a power of two) places."""
    if len(h) < width:
        return np.empty(0, np.int64)
    low = h
    step = 1
    while step < width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    edge = np.zeros(width - 1, np.uint64)
    high = np.concatenate([edge, low, edge])
    step = 1
    while step < width:
        high = np.maximum(high[:-step], high[step:])
        step *= 2
    return np.flatnonzero(h == high)


def _scaled(c: np.ndarray, first: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(place, length, period) of the runs with periods over DIRECT; texts start at ``first`` and end in a separator."""
    alive = np.arange(len(n))
    scale = 2 * DIRECT
    h = T.mix64(c.view(np.uint64))
    size = 1
    while size < scale:
        h = _doubled(h, size)
        size *= 2
    at = np.arange(len(c))  # place in c of each place of h
    while True:
        alive = alive[n[alive] >= EXPONENT * (scale // 2 + 1)]
        if not len(alive):
            return
        own = np.zeros(len(n), bool)
        own[alive] = True
        text = np.searchsorted(first, at, side="right") - 1
        keep = own[text]
        h, at, text = h[keep], at[keep], text[keep]
        pick = _minima(h, scale // 2)
        order = pick[np.argsort(h[pick], kind="stable")]
        same = np.flatnonzero((h[order[1:]] == h[order[:-1]]) & (text[order[1:]] == text[order[:-1]]))
        left, right = order[same], order[same + 1]
        alive = np.unique(text[left])
        lag = at[right] - at[left]
        seeds = np.flatnonzero((lag > scale // 2) & (lag <= scale))
        seeds = seeds[np.lexsort((at[left[seeds]], lag[seeds]))]
        done_lag, done_to = 0, 0
        for s in seeds:
            place, q = int(at[left[s]]), int(lag[s])
            if q == done_lag and place < done_to:
                continue
            lo, hi = _matching(c, place, q)
            done_lag, done_to = q, hi
            if hi - lo + q >= max(SHORTEST, EXPONENT * q) and _primitive(c, lo, q):
                yield lo, hi - lo + q, q
        h = _doubled(h, scale)
        scale *= 2


def find_runs(c: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of several texts: (text, (start, length, period)), ordered by text, start, period.

    ``c`` has the word numbers of the texts, each text followed by a negative number of its own.
    """
    found = [*_direct(c), *_scaled(c, first, n)]
    if not found:
        return np.empty(0, np.int64), np.empty((0, 3), np.int64)
    runs = np.array(found, np.int64)
    text = np.searchsorted(first, runs[:, 0], side="right") - 1
    runs[:, 0] -= first[text]
    order = np.lexsort((runs[:, 2], runs[:, 0], text))
    return text[order], runs[order]


def _piece(parts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, list[bytes]]:
    """(words, text of each run, runs, collapsed texts) of the texts of a piece."""
    numbers, split = _Numbers(), [p.split() for p in parts]
    n = np.array([len(w) for w in split], np.int64)
    first = np.cumsum(n + 1) - n - 1
    c = np.empty(int(n.sum()) + len(n), np.int64)
    for i, w in enumerate(split):
        c[first[i]:first[i] + n[i]] = np.fromiter(map(numbers.__getitem__, w), np.int64, len(w))
        c[first[i] + n[i]] = -1 - i
    text, runs = find_runs(c, first, n)
    drop = {}
    for i, (s, length, q) in zip(text.tolist(), runs.tolist()):
        drop.setdefault(i, np.zeros(n[i], bool))[s + q:s + length] = True
    collapsed = [b" ".join(w if i not in drop else [x for x, d in zip(w, drop[i].tolist()) if not d])
                 for i, w in enumerate(split)]
    return n.tolist(), text, runs, collapsed


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, runs (start, length, period; by start, then period), collapsed text."""
    def search(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            off, data = T.text_buffer(b.column("__t"))
            for a, z in T.row_pieces(off, T.PIECE):
                n, of, runs, collapsed = _piece([data[off[i]:off[i + 1]].tobytes() for i in range(a, z)])
                ends = np.searchsorted(of, np.arange(z - a + 1)).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array(runs[:, i].copy()) for i in range(3)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [b.column("__k").slice(a, z - a), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["__k", "n_words", "runs", "collapsed"])
    slim = docs.select(F.col(key).alias("__k"), F.col(text).cast("string").alias("__t"))
    kind = slim.schema["__k"].dataType.simpleString()
    return slim.mapInArrow(search, f"__k {kind}, {RUNS}").withColumnRenamed("__k", key)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equals the first by start, then period. Null if none."""
    first = F.try_element_at(runs, F.lit(1))
    return F.aggregate(runs, first, lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def run_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of ``collapse_runs`` per row: number of runs, the strongest run, checksums of all runs and of the text."""
    r = collapse_runs(docs, key, text).withColumn("__best", strongest(F.col("runs")))
    best = F.col("__best")
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    return r.select(key, F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
                    best["length"].alias("length"), best["period"].alias("period"),
                    F.expr("(1000L * __best.length) div __best.period").alias("exponent_milli"),
                    F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
                           .cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The text of every tenth key (by CRC-32 h of the key) goes on, from word a, by repeating p words.

    With g = floor(h / 10) and n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)); other
    texts, those without words and those under a null key stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    d = docs.withColumn("__g", F.when(h % 10 == 0, F.floor(h / 10)))
    d = d.withColumn("__w", F.when(F.col("__g").isNotNull(), words(F.col(text))))
    d = d.withColumn("__n", F.size("__w").cast("long"))
    d = d.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")))
    d = d.withColumn("__p", 1 + F.expr("(__n - __a) div (3 + __g % 8)"))
    turns = F.expr("cast(ceil((__n - __a) / __p) as int)")
    period = F.slice("__w", (F.col("__a") + 1).cast("int"), F.col("__p").cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, turns)), F.lit(1), (F.col("__n") - F.col("__a")).cast("int"))
    made = F.array_join(F.concat(F.slice("__w", F.lit(1), F.col("__a").cast("int")), tail), " ")
    return (d.withColumn(text, F.when(F.col("__n") > 0, made).otherwise(F.col(text)))
            .drop("__g", "__w", "__n", "__a", "__p"))
