"""The stages of the corpus pipeline on documents with clashing column names, null and repeated keys, and copies."""
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from barengine.llm import decontamination
from barengine.llm.common import table
from tests.llm.corpus_rows import SF001, docs  # noqa: F401

CLASH = ("item", "cosine", "contaminated", "lcs_share", "k", "h", "kept", "text_hash", "__c0", "component_id", "shard", "slot", "size")


@pytest.fixture(scope="module")
def clashing(spark):
    d = table(spark, SF001, "documents").where("doc_id < 150")
    leak = table(spark, SF001, "benchmark").orderBy("item_id").first().text
    own = spark.createDataFrame([(None, f"before it {leak} after it", "en", "web", 1), (7, f"other text {leak}", "en", None, 1)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    d = d.unionByName(own, allowMissingColumns=True)
    return d.select("*", *[F.lit(0.5).alias(c) for c in CLASH])


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_extra_columns_of_any_name_are_carried(spark, clashing, stage):
    out = stage(spark, clashing, SF001)
    assert out.columns == clashing.columns
    got = out.agg(F.count(F.lit(1)), *[F.min(c) for c in CLASH], *[F.max(c) for c in CLASH]).first()
    assert got[0] > 0 and set(got[1:]) == {0.5}


def test_last_stage_beside_clashing_columns(spark, clashing):
    assert corpus_pipeline.STAGES[-1][1](spark, clashing.drop("shard", "slot", "size"), SF001).count() == clashing.count()


def test_decontamination_stage_drops_the_named_rows_alone(spark, clashing):
    """Rows of the stage are those that the operator leaves, one by one, null and repeated keys included."""
    left = corpus_pipeline.decontaminate(spark, clashing, SF001)
    named = decontamination.contaminated(clashing.select("doc_id", "text"), table(spark, SF001, "benchmark")).where("contaminated")
    assert left.count() == clashing.count() - named.count()
    gone = clashing.select("doc_id", "text").exceptAll(left.select("doc_id", "text")).collect()
    assert None in {r.doc_id for r in gone} and sum(r.doc_id == 7 for r in gone) >= 1
