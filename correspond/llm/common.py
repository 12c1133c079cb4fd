"""Helpers that several operators share."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from correspond.operators.tables import written

#: One word separator or more: the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage, and survives the loss of executors."""
    return written(df, name)


def small_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the rows that one Arrow batch brings to a Python worker: with whole texts, Spark's 10,000 take hundreds of MB on both sides. A setting of the caller's own stays."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(name) == "10000":
        conf.set(name, "1000")
    return df


#: Rows of two or three numbers that may be sent to every task: 32 MB or so.
MAX_SENT = 1_000_000


def sent_if_small(df: DataFrame, most: int = MAX_SENT) -> DataFrame:
    """df, marked to be sent to every task if it has no more than `most` rows; a larger one is shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents that no model may learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def words_of(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.coalesce(F.array_remove(F.split(text, SPACES, -1), ""), F.array().cast("array<string>"))


def unit(col: Column, seed: int) -> Column:
    """A fixed pseudo-random number in [0, 1) for a value."""
    return (F.xxhash64(F.lit(seed), col) % (1 << 52) + (1 << 52)) / F.lit(float(1 << 53))
