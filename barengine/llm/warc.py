"""WARC archives in seekable Zstandard bundles.

A bundle is a ``.warc.zst`` file: WARC/1.1 records are grouped into Zstandard
frames that can be decompressed alone, and a last, skippable frame holds the
seek table of the public seekable format (compressed and decompressed size of
each frame). The index maps a record identifier to bundle, frame, and place in
the decompressed frame; a reader needs the seek table and one frame for a record.

Bundles are written by the tasks through Arrow's file systems, each under a name
of its own attempt. Only what a finished task returns gets into the index, so a
task that is run again after the loss of an executor leaves an unreferenced
file, never a wrong record.

Defined results
* null payload: empty; null URL or identifier: left out of the headers, null when read;
* of records with equal payloads of at least ``min_revisit`` bytes, that with the smallest
  identifier is the response and others revisit it (a null identifier counts as the largest); rows that
  share the smallest identifier are all responses;
* empty table: no bundle, empty index; columns besides the three are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import app_dir, materialize, partitions

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 256 << 20
MIN_REVISIT = 100
LEVEL = 3

# Fixed values of the seekable Zstandard format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

INDEX = ("record_id string, bundle string, frame long, frame_offset long, offset_in_frame long, "
         "record_bytes long")
RECORD = ("record_id string, page_key string, url string, record_type string, refers_to string, "
          "payload_digest string, payload_bytes long, payload binary")


def deduplicated(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                 min_revisit: int = MIN_REVISIT) -> DataFrame:
    """key_, url_, payload (null for revisits), bytes_, digest, refers_ (key of the response of a revisit).

    The smallest key per digest is found on checksums alone; the join has one
    row per digest on one side, so a payload with a third of all rows can be split.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    p = pages.select(F.col(key).alias("key_"), F.col(url).cast("string").alias("url_"), body.alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes_", F.octet_length("payload").cast("long"))
    first = (p.where(F.col("bytes_") >= min_revisit).groupBy("digest")
             .agg(F.min("key_").alias("first_"), F.count(F.lit(1)).alias("n_")).where("n_ > 1"))
    out = p.join(first, "digest", "left")
    revisit = F.col("first_").isNotNull() & ~F.col("key_").eqNullSafe(F.col("first_"))
    return out.select("key_", "url_", F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"),
                      "bytes_", "digest", F.when(revisit, F.col("first_")).alias("refers_"))


def _record(key, url, payload, n_bytes, digest, refers, date: str) -> tuple[str, bytes]:
    rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}|{url}|{digest}|{refers}')}>"
    revisit = payload is None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_bytes}"]
    if key is not None:
        head.append(f"X-Page-Key: {key}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"X-Refers-To-Key: {refers}"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return rid, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class _Bundle:
    """A bundle being written: frames of about FRAME_BYTES, then the seek table."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        fs, where = pafs.FileSystem.from_uri(self.path)
        if isinstance(fs, pafs.LocalFileSystem):
            fs.create_dir(where.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(where, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.offset, self.table, self.held, self.held_bytes, self.index = 0, [], [], 0, []

    def add(self, rid: str, record: bytes) -> None:
        self.index.append((rid, self.path, len(self.table), self.offset, self.held_bytes, len(record)))
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            frame = self.zstd.compress(b"".join(self.held))
            self.out.write(frame)
            self.table.append((len(frame), self.held_bytes))
            self.offset += len(frame)
            self.held, self.held_bytes = [], 0

    def close(self) -> list[tuple]:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()
        return self.index


def write_bundles(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
                  min_revisit: int = MIN_REVISIT, date: str | None = None) -> DataFrame:
    """Writes one record per row into bundles under ``folder`` (a URI) and returns the index, written beside them.

    ``date`` is the WARC-Date of all records (``2024-01-31T12:00:00Z``), by default the time of this call; a task
    that runs again writes the same one.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = deduplicated(pages, key, url, html, min_revisit).withColumn("key_", F.col("key_").cast("string")) \
        .withColumn("refers_", F.col("refers_").cast("string"))

    def write(batches: Iterator[pa.RecordBatch]):
        bundle = None

        def rows_of(entries):
            cols = list(zip(*entries))
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              names=[x.split()[0] for x in INDEX.split(", ")])
        for b in batches:
            cols = [b.column(c) for c in ("key_", "url_", "payload", "bytes_", "digest", "refers_")]
            for i in range(b.num_rows):
                bundle = bundle or _Bundle(folder)
                bundle.add(*_record(*[c[i].as_py() for c in cols], date))
                if bundle.offset >= BUNDLE_BYTES:
                    yield rows_of(bundle.close())
                    bundle = None
        if bundle is not None:
            yield rows_of(bundle.close())
    return materialize(rows.mapInArrow(write, INDEX), "warc-index")


def seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame, from the footer of an open bundle."""
    size = f.size()
    n, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    raw = f.read_at(n * width, size - 9 - n * width)
    out, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", raw, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def _parse(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[:int(h["Content-Length"])]
    kind, digest, n = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
    if kind == "response":  # what was stored, not what was claimed
        digest, n = hashlib.sha256(body).hexdigest(), len(body)
    url = h.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return (h["WARC-Record-ID"], h.get("X-Page-Key"), url, kind, h.get("X-Refers-To-Key"), digest, n,
            body if kind == "response" else None)


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that ``index`` names, read from their bundles: a seek to the frame, one decompression per frame."""
    spark = index.sparkSession
    rows = (index.repartition(partitions(spark), "bundle", "frame")
            .sortWithinPartitions("bundle", "frame", "offset_in_frame"))
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]):
        path = f = frames = None
        number, plain = -1, b""
        zstd = zstandard.ZstdDecompressor()
        for b in batches:
            out, held = [], 0
            for r in b.to_pylist():
                if r["bundle"] != path:
                    if f is not None:
                        f.close()
                    path = r["bundle"]
                    fs, where = pafs.FileSystem.from_uri(path)
                    f = fs.open_input_file(where)
                    frames, number = seek_table(f), -1
                if r["frame"] != number:
                    number = r["frame"]
                    at, packed, size = frames[number]
                    if at != r["frame_offset"]:
                        raise ValueError("index and seek table disagree")
                    plain = zstd.decompress(f.read_at(packed, at), max_output_size=size)
                rec = _parse(plain[r["offset_in_frame"]:r["offset_in_frame"] + r["record_bytes"]])
                if rec[0] != r["record_id"]:
                    raise ValueError("index names another record")
                held += len(rec[-1] or b"") if payload else 0
                out.append(rec if payload else (*rec[:-1], None))
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        if f is not None:
            f.close()
    return rows.mapInArrow(read, RECORD)


def bundle_folder(spark) -> str:
    """A fresh folder for bundles under the shared checkpoint folder, as a URI."""
    d = f"{app_dir(spark)}/warc-{uuid.uuid4().hex}"
    return d if "://" in d or d.startswith("file:") else f"file://{d}"


def roundtrip(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url",
              html: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes the pages and reads every record back: key, payload_bytes, payload_digest, record_type, refers_to."""
    kind = dict(pages.dtypes)[key]
    index = write_bundles(pages, folder or bundle_folder(pages.sparkSession), key, url, html, min_revisit)
    back = read_records(index, payload=False)
    return back.select(F.col("page_key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast(kind).alias("refers_to"))
