"""From raw documents to token files: five stages over whole tables, each written as Parquet and read again by the next.

Every stage takes nulls in any column, empty and very long texts, ties, repeated
rows, an empty table (and gives an empty one), and columns of any other name, which
it hands on as they are, those included that an operator uses for its own results.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from correspond.llm.common import sent_if_small, table
from correspond.llm.decontaminate import contamination
from correspond.llm.mixing import mix
from correspond.llm.quality import quality
from correspond.llm.simhash import similar_classes
from correspond.llm.tokens import token_output
from correspond.operators.tables import shared_dir, written


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """docs with columns of these names (and of ours, which begin with _) under others, and what brings them back."""
    moved = {c: f"own{k}_{c}" for k, c in enumerate(docs.columns) if c.lower() in names or c.startswith("_")}
    return docs.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier doesn't reject. Null texts are scored as empty ones; equal texts are judged alike, so repeated rows stay or go together; without labels nothing is rejected or all is judged alike."""
    rows, back = _aside(docs, "held_out", "score", "predicted")
    return quality(rows, table(spark, sf_dir, "labels"), keep=rows.columns).where("predicted = 1").select(back)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that share four fifths of their five-word shingles or more: the smallest by doc_id (nulls last), text and other columns.

    Rows of other groups stay, whether they repeat an id or have none; of rows that
    are equal in all columns one stays. Null and empty texts are one text.
    """
    rows, back = _aside(docs)
    keyed = similar_classes(rows).withColumn("_row", F.xxhash64(*rows.columns))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key", "_row")
    copies = keyed.groupBy("_class", "_key", "_row").agg(F.min(place).alias("place"), F.count("*").alias("_copies"))
    ranked = copies.groupBy("_class").agg(F.min(F.struct("place", "_copies")).alias("r"))
    chosen = written(ranked.select("r.place._key", "r.place._row", "r._copies"), "chosen")
    left = keyed.join(sent_if_small(chosen), ["_key", "_row"])
    once = left.where("_copies = 1").select(back)
    if chosen.where("_copies > 1").isEmpty():
        return once
    return once.unionByName(left.where("_copies > 1").dropDuplicates(["_key", "_row"]).select(back))


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage. Null and empty texts have none; repeated rows stay or go together; an empty benchmark removes nothing."""
    rows, back = _aside(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
    return contamination(rows, table(spark, sf_dir, "benchmark"), keep=rows.columns).where("not contaminated").select(back)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, each as often as it takes them, twice at most. Texts without a word are never taken; a null source is a source; of rows that tie, those with the smaller hash come first, and equal rows are alike."""
    rows, back = _aside(docs, "size", "source_size", "target", "taken")
    times = (F.col("taken") / F.col("size")).cast("int")
    return mix(rows, rows.columns).where("taken > 0").select("*", F.explode(F.sequence(F.lit(1), times)).alias("_copy")).select(back)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the shared folder; what they hold of each row, read back. A null text is the end id alone; rows of one id follow each other by their text's hash."""
    return token_output(docs)


STAGES = [("quality_classifier", good_documents), ("near_duplicates", one_of_each), ("decontamination", clean_of_benchmarks), ("mixing", mixed), ("token_output", token_files)]

#: Trained models, SimHash, hash shuffles and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of the mix, in the order of the token files."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
