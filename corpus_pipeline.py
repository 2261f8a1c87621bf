"""A training corpus from ``documents``: five stages, each over all that the one before kept.

1. quality classifier: documents whose perplexity the Kneser-Ney model rejects go;
2. near duplicates: of each group (five-word shingles, Jaccard 0.8 or more) one row with the smallest key stays;
3. benchmark decontamination: documents that hold a benchmark passage go;
4. mixing: documents are taken by weighted fair queueing, some of them up to three times;
5. sharding: every row gets its shard and slot.

Every stage but the last returns the columns of ``documents``; ``run`` writes a stage's
result as Parquet to the shared folder and reads it again for the next one. The last returns keys, sizes,
checksums, shards and slots; the texts stay in the table of the stage before.

Defined results
* null, empty and blank texts: judged by the classifier like any text, never near duplicates of others, not contaminated, size 0 or 16;
* null and repeated keys: a row is judged by key and text together, other texts under the same key stay;
* repeated rows and copies: one of them stays after the near duplicates; ties take the smallest key, any of equal rows;
* very long texts: judged whole; empty tables: no rows; extra columns, whatever their names, are carried to the fourth stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barengine.llm import decontamination, mixing, ngram_join, quality_model, sharding
from barengine.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
N_SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects. Repeated rows fall or stay together."""
    verdict = quality_model.classify(docs, table(spark, sf_dir, "labels"))
    rejected = verdict.where("NOT kept").select(F.col("doc_id").alias("__key"), F.col("text_hash").alias("__rejected")).distinct()
    d = docs.withColumn("__h", F.xxhash64("text"))
    return (d.join(rejected, F.col("doc_id").cast("long").eqNullSafe(F.col("__key")) & (F.col("__h") == F.col("__rejected")),
                   "left_anti").select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates; other texts under the same or no key stay."""
    return ngram_join.one_per_component(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark passages; texts pass through the scan and are not shuffled."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}  # no column can clash with those of the verdict
    d = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    rest = tuple(n for c, n in names.items() if c != "doc_id")
    verdict = decontamination.contaminated(d, table(spark, sf_dir, "benchmark"), key=names["doc_id"], text=names["text"], carry=rest)
    return verdict.where("NOT contaminated").select(*[F.col(n).alias(c) for c, n in names.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents towards the sources' target weights; a document taken twice is two rows."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Key, source, language, size, checksum, shard and slot of every row of the corpus."""
    return sharding.shard_table(docs, n_shards=N_SHARDS, carry=("lang", "source"))


STAGES = [("quality_classifier", quality), ("near_duplicates", near_duplicates),
          ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]

#: Models, components and retrieval are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
