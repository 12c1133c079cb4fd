"""The pipeline's stages, each against its own rule, and on rows that are hard to take."""

import corpus_pipeline
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_similar import groups

from correspond.llm.decontaminate import contamination
from correspond.llm.quality import quality


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        assert kept.columns == columns and kept.count() > 0
        if name == "quality_classifier":
            good = quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").select("doc_id")
            assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in good.collect())
        if name == "near_duplicates":
            assert kept.count() == len(set(groups([r.text for r in docs.collect()])))
        if name == "decontamination":
            assert contamination(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").isEmpty()
        if name == "mixing":
            assert kept.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 2").isEmpty()
            size = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), ""))
            total, taken = (x.agg(F.sum(size)).first()[0] for x in (docs, kept))
            assert 0.9 * 1.5 * total < taken <= 1.5 * total
        else:
            assert kept.count() <= before
        docs, before = kept, kept.count()
    out = corpus_pipeline.token_files(spark, docs, SF)
    assert out.count() == before and out.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == out.agg(F.sum("n_tokens")).first()[0]


CLASHES = {"score": "double", "Predicted": "string", "held_out": "int", "n_words": "string", "spans": "array<int>", "size": "string", "target": "int", "taken": "string", "_key": "string", "_class": "int", "_row": "string", "fp": "string"}


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, ties, repeated rows, empty texts, and columns that the operators use for their own results."""
    text = " ".join(f"word{k} is told again" for k in range(40))
    rows = [(1, text, "a", "s", 1), (1, text, "a", "s", 1), (1, text + " other end", "a", "s", 1), (None, "a lone text of no id " * 9, None, None, None), (None, None, None, None, None), (2, "", "a", "s", 0), (3, " \n\t", "b", None, 3), (4, text.upper(), None, "t", 4), (5, "x " * 20000, "c", "s", 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *(F.lit(None).cast(t).alias(c) if "<" in t else F.lit("7").cast(t).alias(c) for c, t in CLASHES.items()))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_hard_rows(spark, hard, name, stage):
    kept = stage(spark, hard, SF)
    assert kept.schema.simpleString() == hard.schema.simpleString()
    rows = {str(r) for r in hard.collect()}
    assert all(str(r) in rows for r in kept.collect())
    assert stage(spark, hard.limit(0), SF).count() == 0
    want = {"near_duplicates": 4, "decontamination": 9}.get(name)
    assert want is None or kept.count() == want


def test_tokens_of_hard_rows(spark, hard):
    out = corpus_pipeline.token_files(spark, hard, SF)
    assert out.count() == 9 and out.where("doc_id is null").count() == 2
    assert corpus_pipeline.token_files(spark, hard.limit(0), SF).count() == 0
