"""Token ids as flat binary files with 64-bit document offsets, read by memory map.

A corpus is a folder of file triples and a manifest table with one row per triple:

* ``*.ids``: token ids one after another, unsigned little-endian, two bytes wide where the vocabulary allows, else four;
* ``*.off``: per document and once at the end the number of ids before it in this file, unsigned 64 bit;
* ``*.key``: the documents' keys, signed 64 bit (0 for a null key; these come first).

Documents lie in ascending order of their keys over all files. Rows are dealt by range of (key, text
checksum, row number), so a key with a third of all rows is cut too; each task sorts its range, encodes it and writes
files of about ``FILE_TOKENS`` ids, one text more at most. A file's first document and first id in the corpus are the
prefix sums of the counts in the manifest. Files carry the name of their attempt and only what a finished task
returns gets into the manifest, so a task that runs again after the loss of an executor leaves an unreferenced file.

Tokenizers that drop white space (``by_words``) encode a text as the ids of its words, one word after another.
Each distinct word is then encoded once by the tokenizer and kept in a bounded cache of the worker (words of ASCII
letters, with a closing mark or without, many at once with spaces between where the ids tell the ends of pieces, others
with a special token between);
one text of each piece is encoded whole too, and another result is an error. Others encode texts whole.

Defined results
* null and empty texts: the end id alone; keys are whole numbers, null keys come first;
* rows with equal keys follow each other in the order of their texts' checksums; repeated rows are all written;
* empty table: no files, empty manifest, no documents; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .common import app_dir, materialize, partitions

FILE_TOKENS = 1 << 26
#: Distinct words that a worker keeps; passed, the cache starts anew after the piece.
CACHE_WORDS = 1 << 20
#: Distinct words encoded by one call.
CALL_WORDS = 1024
#: Marks that close words, which may be encoded together.
PUNCTUATION = ".,;:!?"
#: Ids that a reader hands on at once.
READ_TOKENS = 1 << 20

MANIFEST = ("part long, seq long, path string, width long, docs long, tokens long, nulls long, "
            "first_key long, last_key long")
_NAMES = [x.split()[0] for x in MANIFEST.split(", ")]


class _Codes(dict):
    """Words -> places in the cache; new words wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Texts -> ids, through a tokenizer given as its JSON."""

    def __init__(self, tokenizer: str, end_id: int, by_words: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(tokenizer)
        self.end_id, self.by_words = end_id, by_words
        added = [(x["content"], x["id"]) for x in json.loads(tokenizer).get("added_tokens", []) if x.get("special")]
        self.mark = added[0] if added else None
        self.specials = [c.encode() for c, _ in added]
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        self.fold = by_words and self.tok.normalizer is not None and self.tok.normalizer.normalize_str(upper) == upper.lower()
        # which ids end a piece of text, where the model says so
        model = json.loads(tokenizer)["model"]
        suffix, vocab = model.get("end_of_word_suffix"), model.get("vocab")
        self.last, self.marks = None, {}
        if by_words and suffix and isinstance(vocab, dict):
            self.last = np.zeros(self.tok.get_vocab_size(with_added_tokens=True) + max(vocab.values()) + 1, bool)
            self.last[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
            alone = {ord(c): e for c, e in zip(PUNCTUATION, self._whole([c.encode() for c in PUNCTUATION]))}
            self.marks = {c: e[0] for c, e in alone.items() if len(e) == 1}
        self._clear()

    def _clear(self):
        self.codes = _Codes()
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.start = np.empty(1 << 14, np.int64)
        self.size = np.empty(1 << 14, np.int64)
        self.known = 0

    def _keep(self, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keeps the ids of the words with the given places."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(at) and at.max() >= len(self.start):
            self.start = np.concatenate([self.start, np.empty_like(self.start)])
            self.size = np.concatenate([self.size, np.empty_like(self.size)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.size[at] = sizes
        self.used += len(ids)

    def _learn(self) -> None:
        """Encodes the words that wait."""
        new, self.codes.new = self.codes.new, []
        places = np.arange(self.known, self.known + len(new))
        self.known += len(new)
        kinds = np.array([self._kind(w) for w in new] if self.last is not None else [0] * len(new), np.int64)
        for kind in (1, 2, 0):
            at = np.flatnonzero(kinds == kind)
            for i in range(0, len(at), CALL_WORDS):
                part = at[i:i + CALL_WORDS]
                group = [new[j] for j in part]
                if not (kind and self._learn_spaced(places[part], group, kind)):
                    self._learn_marked(places[part], group)

    def _kind(self, word: bytes) -> int:
        """1: ASCII letters alone, 2: these and one mark of PUNCTUATION that is one id, 0: others."""
        return 1 if word.isalpha() else 2 if word[-1] in self.marks and word[:-1].isalpha() else 0

    def _learn_spaced(self, at: np.ndarray, group: list[bytes], kind: int) -> bool:
        """Words as one text with spaces; false if they do not come back as ``kind`` pieces each, the second the mark."""
        joined = b" ".join(group)
        if self.last is None or any(s in joined for s in self.specials):
            return False
        ids = np.array(self.tok.encode_batch_fast([joined.decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != kind * len(group) or ends[-1] != len(ids) - 1 or (
                kind == 2 and ids[ends[1::2]].tolist() != [self.marks[w[-1]] for w in group]):
            self.last = None  # another kind of tokenizer
            return False
        self._keep(at, ids, np.diff(ends[kind - 1::kind], prepend=-1))
        return True

    def _learn_marked(self, at: np.ndarray, group: list[bytes]) -> None:
        """Words with a special token between them."""
        joined = self.mark[0].encode().join(group) if self.mark else b""
        if self.mark and sum(joined.count(s) for s in self.specials) == len(group) - 1:
            ids = np.array(self.tok.encode_batch_fast([joined.decode()], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark[1])
            sizes = np.diff(cut, prepend=-1, append=len(ids)) - 1
            self._keep(at, ids[ids != self.mark[1]], sizes)
        else:  # a word that holds a special token, or a tokenizer without one
            each = self._whole(group)
            self._keep(at, np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each], np.int64))

    def _folded(self, part: bytes) -> bytes:
        """An ASCII text in lower case, for tokenizers that lower it themselves; special tokens stay as they are."""
        low = part.lower() if part.isascii() else part
        return part if any(s in low for s in self.specials) else low

    def _whole(self, parts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their end ids, ids per text)."""
        if not self.by_words:
            each = [e + [self.end_id] for e in self._whole(parts)]
            return np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each], np.int64)
        words = [(self._folded(p) if self.fold else p).split() for p in parts]
        n = np.array([len(w) for w in words], np.int64)
        code = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        if self.codes.new:
            self._learn()
        sizes = self.size[code]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        last = np.cumsum(n)
        count = ends[last] - ends[last - n]
        ids = self.flat[np.repeat(self.start[code] - ends[:-1], sizes) + np.arange(ends[-1])]
        probe = int(np.argmax((n > 0) & (n <= 4096))) if len(n) else 0
        if len(n) and 0 < n[probe] <= 4096:
            before = int(ends[last[probe] - n[probe]])
            if not np.array_equal(ids[before:before + count[probe]], self._whole([parts[probe]])[0]):
                raise ValueError("this tokenizer does not encode a text word by word: use by_words=False")
        out = np.full(len(ids) + len(n), self.end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), count)] = ids
        if len(self.codes) > CACHE_WORDS:
            self._clear()
        return out, count + 1


class _Triple:
    """The three files of one stretch of documents while they are written."""

    def __init__(self, folder: str, width: int):
        self.path = f"{folder}/{uuid.uuid4().hex}"
        fs, where = pafs.FileSystem.from_uri(self.path)
        if isinstance(fs, pafs.LocalFileSystem):
            fs.create_dir(where.rpartition("/")[0], recursive=True)
        self.out = {x: fs.open_output_stream(f"{where}.{x}", compression=None) for x in ("ids", "off", "key")}
        self.width, self.docs, self.tokens, self.nulls, self.first, self.last = width, 0, 0, 0, None, None

    def add(self, ids: np.ndarray, count: np.ndarray, keys: np.ndarray, nulls: int) -> None:
        self.out["ids"].write(ids.astype(f"<u{self.width}").tobytes())
        self.out["off"].write((self.tokens + np.cumsum(count) - count).astype("<u8").tobytes())
        self.out["key"].write(keys.astype("<i8").tobytes())
        if nulls < len(keys):
            self.first = int(keys[nulls]) if self.first is None else self.first
            self.last = int(keys[-1])
        self.docs, self.tokens, self.nulls = self.docs + len(count), self.tokens + len(ids), self.nulls + nulls

    def close(self, part: int, seq: int) -> tuple:
        self.out["off"].write(np.array([self.tokens], "<u8").tobytes())
        for f in self.out.values():
            f.close()
        return part, seq, self.path, self.width, self.docs, self.tokens, self.nulls, self.first, self.last


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(*args) -> Encoder:
    """The worker's encoder: tasks that follow each other share its cache."""
    if args not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[args] = Encoder(*args)
    return _ENCODERS[args]


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, key: str = "doc_id", text: str = "text",
                 end_id: int = 2, by_words: bool = True, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the ids of all documents under ``folder`` (a URI) and returns the manifest, with the bases of each file.

    ``tokenizer_path`` is read by the driver; its JSON (a few MB, whatever the input) goes to the tasks.
    """
    spark = docs.sparkSession
    source = Path(tokenizer_path).read_text()
    from tokenizers import Tokenizer
    width = 2 if max(Tokenizer.from_str(source).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
    shared = spark.sparkContext.broadcast(source)

    def write(batches: Iterator[pa.RecordBatch]):
        encoder, part, rows, files = _encoder(shared.value, end_id, by_words), TaskContext.get().partitionId(), [], None
        for b in batches:
            off, data = T.text_buffer(b.column("t"))
            keys = b.column("k")
            for a, z in T.row_pieces(off, min(T.PIECE, 2 * file_tokens)):
                ids, count = encoder.encode([data[off[i]:off[i + 1]].tobytes() for i in range(a, z)])
                files = files or _Triple(folder, width)
                own = keys.slice(a, z - a)
                files.add(ids, count, own.fill_null(0).to_numpy(zero_copy_only=False), own.null_count)
                if files.tokens >= file_tokens:
                    rows.append(files.close(part, len(rows)))
                    files = None
        if files is not None:
            rows.append(files.close(part, len(rows)))
        if rows:
            kinds = [pa.string() if n == "path" else pa.int64() for n in _NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_NAMES)
    dealt = (docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
             .withColumn("h", F.xxhash64("t")).withColumn("u", F.monotonically_increasing_id())
             .repartitionByRange(partitions(spark), "k", "h", "u").sortWithinPartitions("k", "h", "u").select("k", "t"))
    written = materialize(dealt.mapInArrow(write, MANIFEST), "token-files")
    shared.destroy()
    files = sorted(written.collect(), key=lambda r: (r.part, r.seq))  # one row per file
    out, doc, tok, before = [], 0, 0, None
    for r in files:
        if r.first_key is not None:
            if before is not None and r.first_key < before:
                raise ValueError("files are not in the order of their keys")
            before = r.last_key
        out.append((*r, doc, tok))
        doc, tok = doc + r.docs, tok + r.tokens
    schema = MANIFEST + ", doc_base long, token_base long"
    return materialize(spark.createDataFrame(out, schema), "token-manifest")


class _File:
    """One triple, open: a memory map where the file system is local, ranges of bytes elsewhere."""

    def __init__(self, path: str, width: int):
        self.fs, self.where = pafs.FileSystem.from_uri(path)
        self.width, self.open = width, {}

    def part(self, kind: str, dtype: str, lo: int, hi: int) -> np.ndarray:
        if hi <= lo:
            return np.empty(0, dtype)
        if kind not in self.open:
            name = f"{self.where}.{kind}"
            self.open[kind] = (np.memmap(name, dtype, "r") if isinstance(self.fs, pafs.LocalFileSystem)
                               else self.fs.open_input_file(name))
        f = self.open[kind]
        if isinstance(f, np.memmap):
            return f[lo:hi]
        width = np.dtype(dtype).itemsize
        return np.frombuffer(f.read_at((hi - lo) * width, lo * width), dtype)

    def offsets(self, lo: int, hi: int) -> np.ndarray:
        return self.part("off", "<u8", lo, hi).astype(np.int64)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        return self.part("ids", f"<u{self.width}", lo, hi)


def read_tokens(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: key, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32 bit)."""
    n = max(1, manifest.count())
    names = [key, "start", "n_tokens", "ids"]

    def read(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for r in b.to_pylist():
                f, at = _File(r["path"], r["width"]), 0
                off = f.offsets(0, r["docs"] + 1)
                if off[-1] != r["tokens"]:
                    raise ValueError("offsets and manifest disagree")
                while at < r["docs"]:
                    end = max(at + 1, int(np.searchsorted(off, off[at] + READ_TOKENS, side="right")) - 1)
                    ids = f.ids(off[at], off[end]).astype("<u4")
                    raw = pa.Array.from_buffers(pa.binary(), end - at, [None, pa.py_buffer(
                        ((off[at:end + 1] - off[at]) * 4).astype(np.int32)), pa.py_buffer(ids)])
                    keys = np.array(f.part("key", "<i8", at, end))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64(), mask=np.arange(at, end) < r["nulls"]),
                         pa.array(r["token_base"] + off[at:end]), pa.array(off[at + 1:end + 1] - off[at:end]), raw],
                        names=names)
                    at = end
    rows = manifest.select("path", "width", "docs", "tokens", "nulls", "token_base").repartition(n, "path")
    return rows.mapInArrow(read, f"`{key}` long, start long, n_tokens long, ids binary")


class TokenReader:
    """Random access on one machine: ``reader[i]`` has the ids of the i-th document of the corpus."""

    def __init__(self, manifest: DataFrame):
        self.rows = sorted(manifest.collect(), key=lambda r: r.doc_base)  # one row per file
        self.bases = [r.doc_base for r in self.rows]
        self.files: dict[int, _File] = {}

    def __len__(self) -> int:
        return self.rows[-1].doc_base + self.rows[-1].docs if self.rows else 0

    def __getitem__(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        at = bisect_right(self.bases, i) - 1
        r = self.rows[at]
        f = self.files.setdefault(at, _File(r.path, r.width))
        lo, hi = f.offsets(i - r.doc_base, i - r.doc_base + 2)
        return f.ids(int(lo), int(hi))


def token_folder(spark: SparkSession) -> str:
    """A fresh folder for token files under the shared checkpoint folder, as a URI."""
    d = f"{app_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return d if "://" in d or d.startswith("file:") else f"file://{d}"


def token_report(docs: DataFrame, tokenizer_path: str, folder: str | None = None, key: str = "doc_id",
                 text: str = "text", end_id: int = 2) -> DataFrame:
    """Writes all documents and reads them back: key, start, n_tokens, CRC-32 of the ids."""
    manifest = write_tokens(docs, tokenizer_path, folder or token_folder(docs.sparkSession), key, text, end_id)
    return read_tokens(manifest, key).select(key, "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))
