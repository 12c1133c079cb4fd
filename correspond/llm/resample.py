"""Importance resampling towards a target distribution by hashed n-gram features."""

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from correspond.llm.common import materialise, small_batches, table
from correspond.llm.words import JOINED, word_blocks
from correspond.operators.series import running_total

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024


class _Crc(dict):
    """crc32 of words, remembered; begun anew when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = code = zlib.crc32(word)
        return code


def features(texts: Iterable[bytes | None], longest: int, known: _Crc, most: int = JOINED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, rows, crc32) of all runs of n = 1 to `longest` consecutive words of each text, in blocks.

    Joined texts are searched for words once. A run is left out if its first and last
    word are of different texts, or if the piece of a long text before has it.
    """
    for words, piece, rows, again in word_blocks(texts, most, longest - 1):
        codes = list(map(known.__getitem__, words))
        place = np.arange(len(words)) - np.searchsorted(piece, piece)
        for n in range(1, longest + 1):
            if n > 1:
                codes = [zlib.crc32(b" " + w, c) for w, c in zip(words[n - 1 :], codes, strict=False)]
            last = slice(n - 1, None)
            whole = (piece[last] == piece[: len(codes)]) & (place[last] >= again[piece[last]])
            yield n, rows[piece[last][whole]], np.array(codes, np.uint32)[whole]


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket; a task sends one row a bucket at most."""

    def count(batches):
        known, total = _Crc(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, codes in features(batch.column(0).to_pylist(), longest, known):
                total += np.bincount(codes % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    for r in small_batches(docs.select(F.col("text").cast("binary"))).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r.bucket] = r.n
    return found


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the raw features."""
    size = len(raw)
    s, t = float(raw.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, n_features, weight): the sum of gains over a text's features."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]).add("n_words", "long").add("n_features", "long").add("weight", "long")

    def weigh(batches):
        known, gain = _Crc(), sent.value
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), np.int64)
            for n, rows, codes in features(batch.column(1).to_pylist(), longest, known):
                of_row = np.bincount(rows, minlength=batch.num_rows)
                sums[0] += of_row * (n == 1)
                sums[1] += of_row
                np.add.at(sums[2], rows, gain[codes % np.uint32(len(gain))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], kind.names)

    return small_batches(docs.select("doc_id", F.col("text").cast("binary"))).mapInArrow(weigh, kind)


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text), target(text) -> (doc_id, n_features, weight, score, rank), a row for each row of docs.

    Features are hashed runs of 1 to `longest` words. A document's score is its log
    importance weight and Gumbel noise drawn from doc_id, so that the highest scores are
    a draw without replacement in proportion to the weights. `percent` of the documents
    of `least_words` words or more are drawn and ranked, ties to the smaller doc_id (null
    ids last), then to fewer features; all others have a null rank.

    Null and empty texts have no feature and weight 0; texts of any length are read
    whole, in pieces; repeated rows are rows of their own, with equal scores; a null
    doc_id draws the noise of an empty one; an empty table gives none, an empty target
    has no feature; other columns are not read. Ranks come from ranges of the score with running
    totals: only numbers are shuffled.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialise(weights(docs, gain, longest).withColumn("score", F.col("weight") + noise), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    one = able.select("doc_id", "n_features", "weight", "score", F.lit(1).alias("_one"), F.lit(0).alias("_all"))
    ranked = running_total(one, ["_all"], "_one", "rank", F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc())
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("long")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = ("doc_id", "n_features", "weight", "score", "rank")
    return ranked.select(*out).unionByName(rest.select(*out))


def op12_resample(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
