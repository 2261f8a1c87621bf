"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontamination, extraction, language_model, licenses, mixing, ngram_join, periodicity, phrases, quality,
               quality_model, sharding, token_files, warc)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


W = r"[^\x20\x09-\x0D]+"


@query("op2_mix_sources")
def op2(spark, sf):
    return mixing.mix_report(table(spark, sf, "documents"))


@query("op4_shard")
def op4(spark, sf):
    return sharding.shard_table(table(spark, sf, "documents"), n_shards=40)


@query("op5_line_frequency")
def op5(spark, sf):
    return quality.line_frequency(table(spark, sf, "documents"))


@query("op9_ngram_join")
def op9(spark, sf):
    return ngram_join.near_duplicates(table(spark, sf, "documents"), k=3, percent=90)


@query("op7_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY d)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first IS NULL OR page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d""")
def op7(spark, sf):
    return warc.roundtrip(table(spark, sf, "pages"))


@query("op1_deleted_interpolation")
def op1(spark, sf):
    return language_model.score_corpus(table(spark, sf, "documents"))


@query("op10_kneser_ney")
def op10(spark, sf):
    return quality_model.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).drop("text_hash")


@query("op6_decontaminate")
def op6(spark, sf):
    return decontamination.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op8_extract_text")
def op8(spark, sf):
    return extraction.extract(table(spark, sf, "pages"))


@query("op11_periodic_runs")
def op11(spark, sf):
    return periodicity.run_report(periodicity.with_planted_runs(table(spark, sf, "documents")))


@query("op12_token_files")
def op12(spark, sf):
    import public_tokenizers
    return token_files.token_report(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op13_phrases", r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
p AS (SELECT d, lang, generate_subscripts(pieces, 1) AS p, unnest(pieces) AS piece FROM t),
u AS (SELECT d, lang, p, generate_subscripts(ws, 1) AS i, unnest(ws) AS w
  FROM (SELECT d, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
g AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
  FROM u WINDOW o AS (PARTITION BY d, p ORDER BY i)),
f AS MATERIALIZED (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS a FROM g GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL),
h AS MATERIALIZED (SELECT lang, k, phrase, a, lang || chr(9) || phrase AS key, string_split(phrase, ' ') AS ws
  FROM f WHERE a >= 30),
x AS MATERIALIZED (SELECT *, lang || chr(9) || array_to_string(ws[1:cut], ' ') AS lk,
    lang || chr(9) || array_to_string(ws[cut + 1:], ' ') AS rk
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM h WHERE k > 1)),
s AS (SELECT x.lang, x.phrase, x.key, x.a, x.cut, l.a AS l, r.a AS r, (2000000::HUGEINT * x.a) // (l.a + r.a) AS score
  FROM x JOIN h l ON l.key = lk JOIN h r ON r.key = rk),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, cut) = 1),
inside AS (SELECT lang || chr(9) || array_to_string(ws[i:i + m - 1], ' ') AS key, max(a) AS over
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM h WHERE k > 2)) GROUP BY 1),
kept AS (SELECT b.* FROM b LEFT JOIN inside USING (key) WHERE over IS NULL OR 100::HUGEINT * over < 80::HUGEINT * a),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
  CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""")
def op13(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


@query("op3_license_scan")
def op3(spark, sf):
    """Documents as files: source, language and hundred of the key are directories. Every tenth document
    plays a license file of its directory, every thousandth one of its language's directory."""
    docs = table(spark, sf, "documents")
    plays = F.when(F.col("doc_id") % 10 == 0, F.lit("LICENSE.")).otherwise(F.lit("text."))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")),
                       F.when(F.col("doc_id") % 1000 != 0, F.floor(F.col("doc_id") / 100).cast("string")),
                       F.concat(plays, F.col("doc_id").cast("string")))
    return licenses.scan_licenses(docs.select("doc_id", path.alias("path"), "text"), "doc_id", "path", "text")
