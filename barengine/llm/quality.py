"""Quality rules and cross-document line frequency (DataFrame operations only).

Lines are normalised (lower case, digits to 0, white space to one space), hashed,
and counted by host in distinct documents: a document is a key with its text, so rows
repeated whole count once and copies under other keys count each. Lines in more documents
than the limit are removed; a document that loses more than half of its words this way is
rejected as depleted.

Texts are read once: base rules and line hashes of every row are written to the shared
folder, and both the counts and the verdicts start from them.

Defined results
* null or empty text: no words, so the base rules fail and it is not kept;
* a null host is a host of its own;
* rows equal in key, text and host get equal results; other rows that share a key are judged apart;
* lines in as many copies of a text as the limit allows stay; beyond it all copies lose them, the first too;
* empty table: empty result; columns besides key, text and host are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACES, WORD, materialize, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate of its host in more than this many documents, whatever the size of the host.
LINE_DOCS = 20
#: A document is depleted when more than this share of its words goes with removed lines.
MAX_REMOVED = 0.5


def n_repeat_words(w: Column) -> Column:
    """Words in windows of three words that occur twice or more in the array.

    Windows are 64-bit hashes, with their places sorted within the row; only
    rows whose hashes are not all different are sorted.
    """
    n = F.size(w)

    def covered(places: Column) -> Column:
        # a window adds up to three words: as many as lie past the window before it
        return F.aggregate(places, F.struct(F.lit(-9).alias("p"), F.lit(0).cast("long").alias("n")),
                           lambda s, p: F.struct(p.alias("p"), (s["n"] + F.least(F.lit(3), p - s["p"])).alias("n")),
                           lambda s: s["n"])

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1

        def same(x, k):
            before = F.when(k > 0, F.get(s, k - 1)["h"] == x["h"]).otherwise(False)
            return before | F.when(k < last, F.get(s, k + 1)["h"] == x["h"]).otherwise(False)
        return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("i")))
        in_order = F.transform(F.array(F.sort_array(pairs)), repeated)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            F.transform(in_order, covered)[0])

    hashes = F.transform(F.sequence(F.lit(0), n - 3),
                         lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(F.transform(F.array(hashes), count)[0])


def _lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def base_rules(docs: DataFrame, text: str = "text", lines: str | None = None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed. No shuffle.

    ``lines`` names a further column: for each line with a word, its hash ``l`` and its words ``n``.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    hashed = [_each(_lines(F.col(text)), _hashed).alias("__ls")] if lines else [
        _each(_lines(F.col(text)), lambda x: F.struct(_repeated_lines(x).alias("dup"))).alias("__ls")]
    out = docs.withColumn("__w", words(F.col(text)))
    out = out.select(*docs.columns, F.size("__w").cast("long").alias("n_words"),
                     F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
                     (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                     n_repeat_words(F.col("__w")).alias("n_repeat_words"), *hashed)
    out = out.select(*docs.columns, "n_words", "word_chars", "n_symbols", F.col("__ls.dup").alias("n_dup_lines"),
                     "n_repeat_words", *([F.col("__ls.lines").alias(lines)] if lines else []))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))


def _each(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def _repeated_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _hashed(lines: Column) -> Column:
    each = F.transform(lines, lambda x: F.struct(
        F.xxhash64(normalised(x)).alias("l"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    return F.struct(_repeated_lines(lines).alias("dup"), each.alias("lines"))


def normalised(line: Column) -> Column:
    zeros = F.translate(F.lower(line), "123456789", "000000000")
    return F.trim(F.regexp_replace(zeros, SPACE, " "))


def _host(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(host).cast("string")), F.lit("n"))


def document_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: __k, __t (checksum of the text), __host, the base rules' columns, __lines, __m (equal rows).

    Equal rows are counted before the shuffle; no text leaves the scan.
    """
    slim = docs.select(F.col(key).alias("__k"), F.xxhash64(text).alias("__t"), _host(host).alias("__host"),
                       F.col(text).alias("__text"))
    rows = base_rules(slim, "__text", "__lines").drop("__text")
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__m"))


def frequent_lines(documents: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """Lines above the limit: __host, __l (line hash), __docs (documents of the host that hold it)."""
    lines = documents.select("__host", F.explode(F.array_distinct(F.transform("__lines", lambda x: x["l"]))).alias("__l"))
    return lines.groupBy("__host", "__l").agg(F.count(F.lit(1)).alias("__docs")).where(F.col("__docs") > line_docs)


def _hits(documents: DataFrame, line_docs: int) -> DataFrame:
    """One row per document and distinct line above the limit: __k, __t, __host, __l, __n (words of all its places)."""
    lines = (documents.select("__k", "__t", "__host", F.explode("__lines").alias("__x"))
             .select("__k", "__t", "__host", F.col("__x.l").alias("__l"), F.col("__x.n").alias("__n")))
    return lines.join(frequent_lines(documents, line_docs), ["__host", "__l"])


def line_frequency(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                   line_docs: int = LINE_DOCS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """Per row: key, the base rules' columns, removed_share, kept.

    Lines travel as hashes (no text is shuffled). A hot line is counted with
    partial sums; in the join it lies on the side that Spark can split.
    """
    documents = materialize(document_lines(docs, key, text, host), "quality-lines")
    lost = (_hits(documents, line_docs).groupBy("__k", "__t", "__host").agg(F.sum("__n").alias("__lost"))
            .select(F.col("__k").alias("__k2"), F.col("__t").alias("__t2"), F.col("__host").alias("__h2"), "__lost"))
    out = documents.drop("__lines").join(lost, F.col("__k").eqNullSafe(F.col("__k2")) & F.col("__t").eqNullSafe(F.col("__t2"))
                                         & (F.col("__host") == F.col("__h2")), "left")
    share = F.coalesce(F.col("__lost") / F.col("n_words"), F.lit(0.0))
    out = out.withColumn("__each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m"))))
    return out.select(F.col("__k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", share.alias("removed_share"),
                      (~F.col("base_failed") & (share <= max_removed)).alias("kept"))


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
            line_docs: int = LINE_DOCS) -> DataFrame:
    """Rows of ``docs`` with the lines above the limit taken out of the text (null texts stay null).

    The lines to remove are gathered per document, so a document's list is bounded by its own lines.
    """
    documents = materialize(document_lines(docs, key, text, host), "quality-lines")
    hit = _hits(documents, line_docs).groupBy("__k", "__t", "__host").agg(F.collect_set("__l").alias("__drop"))
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}  # no column can clash with the helpers
    d = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    body = names[text]
    out = d.join(hit, F.col(names[key]).eqNullSafe(F.col("__k")) & (F.xxhash64(body) == F.col("__t"))
                 & (_host(names[host]) == F.col("__host")), "left")
    kept = F.array_join(F.filter(F.split(body, "\n", -1), lambda x: ~F.coalesce(
        F.array_contains(F.col("__drop"), F.xxhash64(normalised(x))), F.lit(False))), "\n")
    text_ = F.when(F.col("__drop").isNull(), F.col(body)).otherwise(kept)
    return out.select(*[(text_ if c == text else F.col(n)).alias(c) for c, n in names.items()])
