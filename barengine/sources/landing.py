"""Landing of CSV bar files whose headers differ (S6), and the load step on top of it.

A folder may hold files of several layouts. The layout of a file is the position of every bar column in its first
line. ``file_layouts`` finds it for all files in one scan: a line that looks like a header is turned into one number
(nine bits per bar column) and a hash aggregation keeps that of the first line of each file. Files of one layout are
then read together by Spark's CSV reader with the fields in file order, so a column never takes the place of
another. Records that do not fit are kept beside the bars with a reason, none is dropped:

* ``header``: the whole file has no first line with a time column and open, high, low and close (one row per file);
* ``fields``: more or fewer fields than the header;
* ``time``: no readable time;
* ``number``: a price or volume that is neither empty nor a number.

An empty price is missing (NULL), and so is NaN. Blank lines before a header are skipped. Columns that are no bar columns are
dropped. Of a header's 511 first columns the first with a name counts; a header may be quoted.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bars import append_bars, compact_old, dedup_keep_last
from ..session import materialize, path_exists
from .files import INDEX_NAMES, read_bars, write_bars

# Fixed names of the bar columns in landed headers, lower case.
NAMES = {"ts": tuple(dict.fromkeys(n.lower() for n in INDEX_NAMES)), "open": ("open",), "high": ("high",), "low": ("low",),
         "close": ("close",), "volume": ("volume",), "adj_close": ("adj close", "adj_close")}
NEEDED = ("ts", "open", "high", "low", "close")
NUMBERS = ("open", "high", "low", "close", "volume", "adj_close")
BITS = 9
STEM = r"([^/]*?)(?:\.[^./]*)?$"
# The order of records within one load: later files win, then later lines.
LOAD_ORDER = ("file_time", "file", "file_start", "line")


def _layout(line: Column) -> Column:
    """The positions of the bar columns in a header line as one number; NULL where the line is no header."""
    fields = F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'),
                         lambda x: F.lower(F.trim(F.regexp_replace(x, r'["﻿]', ""))))

    def position(names):
        found = [F.nullif(F.array_position(fields, F.lit(n)), F.lit(0)) for n in names]
        p = F.coalesce(*found, F.lit(0)).cast("long")
        return F.when(p < F.lit(1 << BITS), p).otherwise(F.lit(0))

    code = F.lit(0).cast("long")
    for i, (name, names) in enumerate(NAMES.items()):
        # pandas writes an unnamed index as an empty first field
        p = position([*names, ""] if name == "ts" else names)
        code = code.bitwiseOR(F.shiftleft(p, BITS * i))
    return F.when(F.lower(line).contains("close"), F.struct(code.alias("code"), F.size(fields).cast("long").alias("fields")))


def positions(code: int) -> dict[str, int]:
    """Bar column → 0-based field of a layout number; columns that the layout lacks are left out."""
    at = {n: (code >> (BITS * i)) & ((1 << BITS) - 1) for i, n in enumerate(NAMES)}
    return {n: p - 1 for n, p in at.items() if p}


def file_layouts(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(file, code, fields) of every non-empty file below ``path``; code is NULL where the first line is no header."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    first = (lines.where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
             .select(F.col("_metadata.file_path").alias("file"), _layout(F.col("value")).alias("l"),
                     F.monotonically_increasing_id().alias("at")))
    # only numbers are aggregated, so the aggregation hashes and a task keeps one row per file
    one = first.groupBy("file").agg(F.min_by(F.coalesce("l.code", F.lit(-1)), "at").alias("code"),
                                    F.min_by(F.coalesce("l.fields", F.lit(0)), "at").alias("fields"))
    return one.select("file", F.when(F.col("code") >= 0, F.col("code")).alias("code"), "fields")


def _reader_path(uri: str) -> str:
    """A file of ``_metadata.file_path`` (an encoded URI) as a path for the reader: decoded, with glob signs escaped."""
    from urllib.parse import unquote
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def _symbol(uri: Column, pattern: str) -> Column:
    """The symbol in an encoded file URI."""
    return F.regexp_extract(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), pattern, 1)


def _read_layout(spark: SparkSession, files: list[str], code: int, fields: int, symbol: str) -> DataFrame:
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(fields)] + [T.StructField("_record", T.StringType())])
    raw = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_record").option("columnPruning", False)
           .csv([_reader_path(f) for f in files]))
    at = positions(code)
    text = {n: F.trim(F.col(f"c{p}")) for n, p in at.items()}

    def number(n):
        if n not in at:
            return F.lit(None).cast("double")
        x = text[n].try_cast("double")
        return F.when(~F.isnan(x), x)

    bad = [F.col(f"c{at[n]}").isNotNull() & (text[n] != "") & text[n].try_cast("double").isNull() for n in NUMBERS if n in at]
    ts = text["ts"].try_cast("timestamp")
    reason = (F.when(F.col("_record").isNotNull(), "fields").when(ts.isNull(), "time")
              .when(reduce(lambda a, b: a | b, bad), "number"))
    return raw.select(
        _symbol(F.col("_metadata.file_path"), symbol).alias("symbol"), ts.alias("ts"),
        *[number(n).alias(n) for n in NUMBERS], F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("file_start"),
        F.monotonically_increasing_id().alias("line"), reason.alias("reason"),
        F.when(reason.isNotNull(), F.coalesce("_record", F.concat_ws(",", *[F.coalesce(f"c{i}", F.lit("")) for i in range(fields)])))
        .alias("record"))


LANDED = ("symbol string, ts timestamp, open double, high double, low double, close double, volume double, adj_close double, "
          "file_time timestamp, file string, file_start long, line long, reason string, record string")


def land_records(spark: SparkSession, path: str, freq: str | None = None, symbol: str = STEM, glob: str = "*.csv") -> DataFrame:
    """Every record of the landed CSV files, good ones with a NULL ``reason``.

    ``symbol`` is a pattern on the file's path whose first group is the symbol (the file's stem by default). The driver
    holds one entry per file, as Spark's own file index does, and one plan branch per layout.
    """
    groups: dict[tuple, list[str]] = {}
    for r in file_layouts(spark, path, glob).collect():
        ok = r.code is not None and all(n in positions(r.code) for n in NEEDED)
        groups.setdefault((r.code, r.fields) if ok else None, []).append(r.file)
    parts = [_read_layout(spark, sorted(files), *layout, symbol) for layout, files in sorted(
        (g for g in groups.items() if g[0] is not None))]
    headless = spark.createDataFrame([(f,) for f in sorted(groups.get(None, []))], "file string")
    parts.append(headless.select(*[
        (F.col("file") if f.name == "file" else _symbol(F.col("file"), symbol) if f.name == "symbol"
         else F.lit("header") if f.name == "reason" else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in T._parse_datatype_string(LANDED).fields]))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("freq", F.lit(freq)) if freq else out


def land_market_files(spark: SparkSession, path: str, freq: str | None = None, symbol: str = STEM,
                      glob: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """(bars, quarantine) of the landed files. The files are parsed once, into a table of the checkpoint folder.

    Bars carry ``LOAD_ORDER`` for ``dedup_keep_last``; the quarantine has symbol, file, reason and record.
    """
    d = materialize(land_records(spark, path, freq, symbol, glob), "landed")
    return (d.where(F.col("reason").isNull()).drop("reason", "record"),
            d.where(F.col("reason").isNotNull()).select("symbol", "file", "reason", "record"))


def load_bars(spark: SparkSession, path: str, store: str, freq: str, now: str, symbol: str = STEM) -> DataFrame:
    """One load: land, keep the last record of each (symbol, ts), merge into the store (the load wins), compact minute
    bars older than the limit to 5 minutes (A3), write. Returns the quarantine.

    The store's partitions of the load's frequency and symbols are written anew from a table that is complete before.
    """
    bars, bad = land_market_files(spark, path, symbol=symbol)
    new = dedup_keep_last(bars, ("symbol", "ts"), LOAD_ORDER).select("symbol", "ts", "open", "high", "low", "close", "volume")
    if path_exists(spark, store):
        old = read_bars(spark, store, freq).drop("freq")
        old = old.join(new.select("symbol").distinct(), "symbol", "left_semi")
        new = dedup_keep_last(append_bars(old.withColumn("load_seq", F.lit(0)), new.withColumn("load_seq", F.lit(1)))).drop("load_seq")
    if freq == "1m":
        new = compact_old(new, now)
    write_bars(materialize(new.withColumn("freq", F.lit(freq)), "load"), store)
    return bad
