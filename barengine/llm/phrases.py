"""Frequent phrases and collocations by relational mining (SETM) per language.

Texts are cut into pieces (at marks and line ends) and pieces into words. The relations are Spark tables:

* R_k, persisted: the occurrences of frequent phrases of k words in the order of (piece, position). It is stored in
  chunks of at most about ``CHUNK_WORDS`` words of whole texts, one row each, as packed word numbers with a break
  between pieces, so the merge join of an occurrence with that at the next position of its piece is one shift inside a chunk.
* Group counts: a chunk counts its own groups first and sends them, sorted and packed, to ranges of groups (cut by a hash);
  a range adds up the counts of all chunks, keeps groups of ``min_count`` or more, and answers each chunk with one
  bit per group. A group has one entry per chunk at most, however common it is; a range has about RANGE_GROUPS
  occurrences (words: one range per language and shuffle partition). Ranges and chunks both grow with the input, so messages get smaller; there are never more of them than entries.
* Semi-join: with the answers only occurrences of frequent groups enter R_k and are extended.

A phrase of k words is extended from two frequent phrases of k - 1 that overlap (at a position and the next). Words get unique
numbers from the table of frequent words, so groups are compared exactly, not by hashes.

Scores: every cut of a candidate into two phrases is joined with the counts of both parts, which are
frequent too. Arithmetic is decimal. Candidates inside a longer candidate that is nearly as frequent are
dropped by a join of all parts of longer candidates, reduced to their highest count.

Defined results
* null, empty and blank texts have no words; a null language is ``und``; null keys, repeated rows and copies count as they are;
* ties in rank: higher count, then the phrase in the order of its UTF-8 bytes; ties between cuts: the smallest cut;
* empty tables or no frequent phrase: no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as T
from .common import Scratch, partitions
from .packing import pack, pack_sorted, unpack, unpack_sorted

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
#: Score of a candidate that is all there is of its two parts: SCALE * a / (l + r).
SCALE = 2_000_000
#: Share of a candidate's count at which a longer candidate makes it redundant, in percent.
COVERED = 80
CHUNK_WORDS = 1 << 19
#: Occurrences per range of groups that one reducer adds up, about.
RANGE_GROUPS = 1 << 21
UNKNOWN_LANG = "und"

#: A-Z in lower case, a tab is a space, marks and line ends become full stops.
_TABLE = bytearray(range(256))
_TABLE[65:91] = bytes(range(97, 123))
_TABLE[9] = 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = ord(".")
_TABLE = bytes(_TABLE)

R0 = ("chunk long, codes binary, words array<struct<lang: string, range: long, words: binary, places: binary, n: binary>>, "
      "totals array<struct<lang: string, c: long>>")
_SENT = pa.struct([("lang", pa.string()), ("range", pa.int64()), ("words", pa.binary()), ("places", pa.binary()), ("n", pa.binary())])
WORDS = "lang string, range long, chunk long, n long, words binary, f binary, places binary, nth binary"
RK = "chunk long, ids binary, codes binary, starts binary, next long"
SENT = "range long, chunk long, hi binary, lo binary, n binary"
COUNTED = "range long, chunk long, often binary, hi binary, lo binary, f binary"


class _Words(dict):
    """Words of a language -> numbers of the chunk."""

    def __init__(self, chunk: "_Chunk", lang: str):
        super().__init__({b".": 0})
        self.chunk, self.lang = chunk, lang

    def __missing__(self, word):
        self.chunk.names.append((self.lang, word))
        self[word] = n = len(self.chunk.names)
        return n


class _Chunk:
    def __init__(self):
        self.names, self.by_lang, self.parts, self.size = [], {}, [], 0

    def add(self, lang: str, text: bytes) -> None:
        words = text.translate(_TABLE).replace(b".", b" . ").split()
        if not words:
            return
        if lang not in self.by_lang:
            self.by_lang[lang] = _Words(self, lang)
        self.parts.append(np.fromiter(map(self.by_lang[lang].__getitem__, words), np.uint32, len(words)))
        self.parts.append(np.zeros(1, np.uint32))
        self.size += len(words)

    def row(self, chunk: int, ranges: int) -> pa.RecordBatch:
        codes = np.concatenate(self.parts)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)  # one break is enough
        counts = np.bincount(codes, minlength=len(self.names) + 1)[1:]
        totals, sent = Counter(), {}
        for place, (lang, word) in enumerate(self.names, 1):
            totals[lang] += int(counts[place - 1])
            sent.setdefault((lang, zlib.crc32(word) % ranges), []).append((word, place))
        rows = []
        for (lang, where), found in sent.items():
            places = np.array([p for _, p in found], np.uint32)
            rows.append({"lang": lang, "range": where, "words": zstandard.compress(b"\n".join(w for w, _ in found), 1),
                         "places": pack(places), "n": pack(counts[places - 1].astype(np.uint32))})
        sums = [{"lang": lang, "c": c} for lang, c in totals.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), pa.array([pack(codes[keep])], pa.binary()), pa.array([rows], pa.list_(_SENT)),
             pa.array([sums], pa.list_(pa.struct([("lang", pa.string()), ("c", pa.int64())])))],
            names=["chunk", "codes", "words", "totals"])


def _chunks(size: int, ranges: int):
    def cut(batches: Iterator[pa.RecordBatch]):
        part, seq, chunk = TaskContext.get().partitionId() << 32, 0, _Chunk()
        for b in batches:
            off, data = T.text_buffer(b.column("t"))
            langs = b.column("lang").to_pylist()
            for i in range(b.num_rows):
                chunk.add(langs[i], data[off[i]:off[i + 1]].tobytes())
                if chunk.size >= size:
                    yield chunk.row(part + seq, ranges)
                    seq, chunk = seq + 1, _Chunk()
        if chunk.size:
            yield chunk.row(part + seq, ranges)
    return cut


def _group_keys(cols: list[np.ndarray]) -> np.ndarray:
    """One number per row of word numbers (each below 2^32); equal rows, equal numbers."""
    key = cols[0].astype(np.uint64)
    for j, c in enumerate(cols[1:]):
        if j:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        key = key << np.uint64(32) | c.astype(np.uint64)
    return key


def _overlaps(good: np.ndarray) -> np.ndarray:
    """Places where a phrase starts and another at the next place."""
    return np.flatnonzero(good[:-1] & good[1:])


def _halves(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of two to four words (each below 2^32) as two exact 64-bit numbers."""
    c = [x.astype(np.uint64) for x in cols] + [np.zeros(len(cols[0]), np.uint64)] * (4 - len(cols))
    return c[0] << np.uint64(32) | c[1], c[2] << np.uint64(32) | c[3]


class _Groups:
    """The distinct phrases of k words of a chunk, ordered by (range, words): ``hi``, ``lo``, counts, ranges and
    where their occurrences are. Ranges are cut by a hash of the words and hold about RANGE_GROUPS groups each."""

    def __init__(self, row: dict, k: int, ranges: int):
        self.codes = unpack(row["codes"])
        good = np.unpackbits(np.frombuffer(row["starts"], np.uint8), count=len(self.codes)).astype(bool)
        self.at = _overlaps(good)
        self.ids = unpack_sorted(row["ids"])
        cols = [self.codes[self.at + j] for j in range(k)]
        _, one, inv, n = np.unique(_group_keys(cols), return_index=True, return_inverse=True, return_counts=True)
        hi, lo = _halves([self.ids[c[one].astype(np.int64) - 1] for c in cols])
        where = T.mix64(hi ^ T.mix64(lo)) % np.uint64(ranges)
        order = np.lexsort((lo, hi, where))
        self.hi, self.lo, self.n, self.range = hi[order], lo[order], n[order], where[order].astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.group = rank[inv]
        self.edges = np.concatenate([[0], np.flatnonzero(np.diff(self.range)) + 1, [len(order)]]) if len(order) else [0]


def _send(k: int, ranges: int):
    """R_{k-1} -> the groups of every chunk, one row per range in which it has some."""
    def send(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for r in b.to_pylist():
                g = _Groups(r, k, ranges)
                rows = [(int(g.range[s]), r["chunk"], pack_sorted(g.hi[s:e]), pack(g.lo[s:e]) if k > 2 else b"",
                         pack(g.n[s:e].astype(np.uint32))) for s, e in zip(g.edges[:-1], g.edges[1:])]
                if rows:
                    kind = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind)],
                                                     names=["range", "chunk", "hi", "lo", "n"])
    return send


def _count(k: int, min_count: int):
    def count(sent: pa.Table) -> pa.Table:
        """Groups of a range from all chunks -> frequent ones (chunk -1), and per chunk one bit for each it sent."""
        hi = [unpack_sorted(x.as_py()) for x in sent["hi"]]
        lo = [unpack(x.as_py()) for x in sent["lo"]] if k > 2 else [np.zeros(len(x), np.uint64) for x in hi]
        n = np.concatenate([unpack(x.as_py()) for x in sent["n"]]).astype(np.int64)
        ends = np.cumsum([len(x) for x in hi])
        hi, lo = np.concatenate(hi), np.concatenate(lo)
        order = np.lexsort((lo, hi))
        new = np.concatenate([[True], (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])])
        total = np.add.reduceat(n[order], np.flatnonzero(new))
        often = np.empty(len(hi), bool)
        often[order] = (total >= min_count)[np.cumsum(new) - 1]
        first = order[np.flatnonzero(new)][total >= min_count]
        bits = [np.packbits(x).tobytes() for x in np.split(often, ends[:-1])]
        rows = [(int(sent["range"][0].as_py()), -1, b"", hi[first].tobytes(), lo[first].tobytes(),
                 total[total >= min_count].tobytes())]
        rows += [(rows[0][0], c, x, b"", b"", b"") for c, x in zip(sent["chunk"].to_pylist(), bits)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 2 + [pa.binary()] * 4)],
                                    names=["range", "chunk", "often", "hi", "lo", "f"])
    return count


def _listed(k: int):
    def listed(batches: Iterator[pa.RecordBatch]):
        """Packed frequent groups -> w1 .. wk, f."""
        for b in batches:
            for r in b.to_pylist():
                hi, lo = np.frombuffer(r["hi"], np.uint64), np.frombuffer(r["lo"], np.uint64)
                w = [hi >> np.uint64(32), hi & np.uint64(0xFFFFFFFF), lo >> np.uint64(32), lo & np.uint64(0xFFFFFFFF)]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64)) for x in w[:k]],
                                                  pa.array(np.frombuffer(r["f"], np.int64))],
                                                 names=[*[f"w{j + 1}" for j in range(k)], "f"])
    return listed, ", ".join(f"w{j + 1} long" for j in range(k)) + ", f long"


def _packed(chunk: int, ids: np.ndarray, c: np.ndarray, good: np.ndarray, k: int) -> pa.Table:
    """A row of R_k: only words of frequent phrases stay, with one break between stretches."""
    cover = np.zeros(len(c), bool)
    for j in range(k):
        cover[j:] |= good[:len(good) - j]
    keep = cover.copy()
    keep[1:] |= cover[:-1]
    used, inv = np.unique(np.where(cover, c, 0)[keep], return_inverse=True)
    if not len(used) or used[0] != 0:
        used, inv = np.concatenate([np.zeros(1, used.dtype), used]), inv + 1
    kind = [("chunk", pa.int64()), ("ids", pa.binary()), ("codes", pa.binary()), ("starts", pa.binary()), ("next", pa.int64())]
    if len(used) == 1:
        return pa.Table.from_pylist([], pa.schema(kind))
    row = (chunk, pack_sorted(ids[used[1:].astype(np.int64) - 1].astype(np.uint64)), pack(inv.astype(np.uint32)),
           np.packbits(good[keep]).tobytes(), len(_overlaps(good[keep])))
    return pa.Table.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, kind)], names=[n for n, _ in kind])


def _count_words(min_count: int):
    def count(sent: pa.Table) -> pa.Table:
        """Words of a language and range from all chunks -> the frequent ones (chunk -1), and per chunk the places of
        those it sent and their positions in the list."""
        split = [zstandard.decompress(x.as_py()).split(b"\n") for x in sent["words"]]
        total = Counter()
        for words, n in zip(split, sent["n"]):
            for w, c in zip(words, unpack(n.as_py()).tolist()):
                total[w] += c
        often = sorted(w for w, c in total.items() if c >= min_count)
        nth = {w: i for i, w in enumerate(often)}
        lang, where = sent["lang"][0].as_py(), sent["range"][0].as_py()
        rows = [(lang, where, -1, len(often), b"\n".join(often), np.array([total[w] for w in often], np.int64).tobytes(), b"", b"")]
        for chunk, words, places in zip(sent["chunk"].to_pylist(), split, sent["places"]):
            at = np.array([nth.get(w, -1) for w in words], np.int64)
            if (at >= 0).any():
                rows.append((lang, where, chunk, 0, b"", b"", pack(unpack(places.as_py())[at >= 0]), pack(at[at >= 0].astype(np.uint32))))
        kind = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind)],
                                    names=[x.split()[0] for x in WORDS.split(", ")])
    return count


def _listed_words(batches: Iterator[pa.RecordBatch]):
    """Packed frequent words -> lang, word, f, id."""
    for b in batches:
        for r in b.to_pylist():
            n = r["n"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["lang"]] * n, pa.string()), pa.array(r["words"].split(b"\n"), pa.binary()).cast(pa.string()),
                 pa.array(np.frombuffer(r["f"], np.int64)), pa.array(np.arange(r["base"], r["base"] + n, dtype=np.int64))],
                names=["lang", "word", "f", "id"])


def _first(chunks: pa.Table, answers: pa.Table) -> pa.Table:
    """Chunk and the answers to its words -> row of R_1."""
    if not chunks.num_rows or not answers.num_rows:
        return _packed(0, np.empty(0), np.zeros(0, np.uint32), np.zeros(0, bool), 1)
    c = unpack(chunks["codes"][0].as_py())
    place = np.concatenate([unpack(x.as_py()) for x in answers["places"]])
    ids = np.concatenate([b + unpack(x.as_py()).astype(np.int64) for x, b in zip(answers["nth"], answers["base"].to_pylist())])
    order = np.argsort(ids)
    new = np.zeros(int(max(c.max(), place.max())) + 1, np.uint32)
    new[place[order]] = np.arange(1, len(ids) + 1, dtype=np.uint32)
    c = new[c]
    return _packed(chunks["chunk"][0].as_py(), ids[order], c, c > 0, 1)


def _next(k: int, ranges: int):
    def semi(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        """Row of R_{k-1} and the answers to its groups of k words -> row of R_k."""
        if not chunks.num_rows or not answers.num_rows:
            return _packed(0, np.empty(0), np.zeros(0, np.uint32), np.zeros(0, bool), k)
        r = chunks.to_pylist()[0]
        g = _Groups(r, k, ranges)
        bits = dict(zip(answers["range"].to_pylist(), answers["often"].to_pylist()))
        often = [np.unpackbits(np.frombuffer(bits[int(g.range[s])], np.uint8), count=e - s)
                 for s, e in zip(g.edges[:-1], g.edges[1:])]
        good = np.zeros(len(g.codes), bool)
        good[g.at[np.concatenate(often).astype(bool)[g.group]]] = True
        return _packed(r["chunk"], g.ids, g.codes, good, k)
    return semi


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                     max_words: int = MAX_WORDS, chunk_words: int = CHUNK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases: k, w1 .. wmax, f; words: lang, word, id; totals: lang, n).

    ``w`` are the numbers of words (-1 beyond k); phrases of one word are those with k = 1; ``max_words`` is 2 to 4.
    """
    spark = docs.sparkSession
    tables = Scratch(spark)
    slim = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"),
                       F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    r0 = tables.keep(slim.mapInArrow(_chunks(chunk_words, partitions(spark)), R0), "r0")
    totals = tables.keep(r0.select(F.explode("totals").alias("x")).groupBy("x.lang").agg(F.sum("x.c").alias("n")), "totals")
    sent = r0.select("chunk", F.explode("words").alias("x")).select("chunk", "x.*")
    counted = tables.keep(sent.groupBy("lang", "range").applyInArrow(_count_words(min_count), WORDS), "g1")
    bases = _bases(counted.where("chunk = -1"))
    words = counted.where("chunk = -1 AND n > 0").join(bases, ["lang", "range"]).select("lang", "n", "words", "f", "base")
    words = tables.keep(words.mapInArrow(_listed_words, "lang string, word string, f long, id long"), "words")
    answers = counted.where("chunk >= 0").join(bases, ["lang", "range"]).select(F.col("chunk").alias("home"), "places", "nth", "base")
    rk = tables.keep(r0.select("chunk", "codes").groupBy("chunk").cogroup(answers.groupBy("home")).applyInArrow(_first, RK), "r1")
    tables.drop("r0")
    none = [F.lit(-1).cast("long").alias(f"w{j + 1}") for j in range(max_words)]
    out = [words.select(F.lit(1).alias("k"), F.col("id").alias("w1"), *none[1:], "f")]
    for k in range(2, max_words + 1):
        w = [f"w{j + 1}" for j in range(k)]
        ranges = 1 + (rk.agg(F.sum("next")).first()[0] or 0) // RANGE_GROUPS
        counted = rk.mapInArrow(_send(k, ranges), SENT).groupBy("range").applyInArrow(_count(k, min_count), COUNTED)
        counted = tables.keep(counted, f"g{k}")
        listed, schema = _listed(k)
        found = counted.where("chunk = -1").select("hi", "lo", "f").mapInArrow(listed, schema)
        out.append(found.select(F.lit(k).alias("k"), *w, *none[k:], "f"))
        if k < max_words:
            answers = counted.where("chunk >= 0").select(F.col("chunk").alias("home"), "range", "often")
            following = rk.groupBy("chunk").cogroup(answers.groupBy("home")).applyInArrow(_next(k, ranges), RK)
            following = tables.keep(following, f"r{k}")
            tables.drop(f"r{k - 1}")
            rk = following
    tables.drop(f"r{max_words - 1}")
    return tables.keep(reduce(DataFrame.unionByName, out), "phrases"), words, totals


def _bases(counted: DataFrame) -> DataFrame:
    """Word numbers from 0 without gaps: the number of the first frequent word of each language and range."""
    out, at = [], 0
    for r in sorted(counted.select("lang", "range", "n").collect()):  # one row per language and range
        out.append((r.lang, r.range, at))
        at += r.n
    if at >= 1 << 32:
        raise ValueError("more than 2^32 frequent words")
    return counted.sparkSession.createDataFrame(out, "lang string, range long, base long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, top: int = TOP, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    phrases, words, totals = frequent_phrases(docs, text, lang, min_count, max_words, chunk_words)
    w = [f"w{j + 1}" for j in range(max_words)]
    p = phrases.select("k", F.array(*w).alias("p"), "f")
    longer = p.where("k > 1")
    # the lowest score over all cuts
    cuts = longer.select("p", "k", F.col("f").alias("a"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("*", _part("1", "cut", max_words).alias("left"), _part("cut + 1", "k - cut", max_words).alias("right"))
    part = p.select(F.col("p").alias("q"), F.col("f").alias("g"))
    cuts = cuts.join(part.select(F.col("q").alias("left"), F.col("g").alias("l")), "left")
    cuts = cuts.join(part.select(F.col("q").alias("right"), F.col("g").alias("r")), "right")
    score = F.expr(f"cast({SCALE} as decimal(18,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r)")
    best = (cuts.withColumn("score", score.cast("long")).groupBy("p", "k", "a")
            .agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("p", "k", "a", "b.l", "b.r", "b.score"))
    # parts of longer candidates that are nearly as frequent
    inner = longer.where("k > 2").select("k", "p", "f", F.explode(F.expr("sequence(2, k - 1)")).alias("m"))
    inner = inner.select("k", "p", "f", "m", F.explode(F.expr("sequence(1, k - m + 1)")).alias("i"))
    inner = inner.select(_part("i", "m", max_words).alias("p"), "f").groupBy("p").agg(F.max("f").alias("over"))
    wide = "cast(100 as decimal(18,0)) * cast({} as decimal(20,0))"
    best = best.join(inner, "p", "left").where(
        f"over IS NULL OR {wide.format('over')} < cast({COVERED} as decimal(18,0)) * cast(a as decimal(20,0))")
    # names of the words, then ranks
    named = (best.select("p", F.posexplode(F.expr("slice(p, 1, k)")).alias("i", "id")).join(words.select("id", "lang", "word"), "id")
             .groupBy("p").agg(F.min("lang").alias("lang"), F.array_join(F.transform(
                 F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    ranked = best.join(named, "p").select("lang", "phrase", "a", "l", "r", "score").withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    ranked = ranked.where(F.col("rank") <= top)
    return (ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def _part(start: str, length: str, size: int):
    """Words start .. start + length - 1 of ``p``, filled up with -1."""
    return F.expr(f"concat(slice(p, {start}, {length}), array_repeat(cast(-1 as bigint), {size} - ({length})))")
