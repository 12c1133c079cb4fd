"""Known keywords in texts."""

from collections import Counter
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from correspond.operators.snapshot import newest
from correspond.operators.tables import written

#: Keywords of this number at most are looked for one by one inside the JVM.
FEW = 64
#: Keywords that one automaton holds; for more, the texts are read again.
BLOCK = 200_000


def occurrences(texts: DataFrame, keywords: DataFrame, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """texts(text, ...), keywords(keyword) -> the other columns of texts, and keyword and n: literal, non-overlapping occurrences, 1 or more.

    Keywords that overlap each other are all found. A few keywords are counted by
    column functions; more go into an automaton, which reads a text once whatever
    their number. The driver holds one block of keywords at a time. Null texts, and
    null and empty keywords, find nothing.
    """
    terms = keywords.select("keyword").where("keyword <> ''").distinct()
    keys = [c for c in texts.columns if c != "text"]
    first = [r.keyword for r in terms.limit(few + 1).collect()]
    if len(first) <= few:
        counted = F.array(*(F.struct(F.lit(k).alias("keyword"), ((F.char_length("text") - F.char_length(F.replace("text", F.lit(k), F.lit("")))) / len(k)).cast("long").alias("n")) for k in first))
        none = F.array().cast("array<struct<keyword:string,n:bigint>>")
        return texts.select(*keys, F.explode(F.filter(counted if first else none, lambda x: x["n"] > 0)).alias("_k")).select(*keys, "_k.keyword", "_k.n")
    kind = T.StructType([*(texts.schema[c] for c in keys)]).add("keyword", "string").add("n", "long")

    def search(block: list[str]) -> DataFrame:
        sent = texts.sparkSession.sparkContext.broadcast(block)

        def found(batches):
            automaton = ahocorasick.Automaton()
            for k in sent.value:
                automaton.add_word(k, k)
            automaton.make_automaton()
            for batch in batches:
                rows, words, counts = [], [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    n, ends = Counter(), {}
                    for end, k in automaton.iter(text or ""):
                        if end - len(k) >= ends.get(k, -1):
                            n[k] += 1
                            ends[k] = end
                    rows += [row] * len(n)
                    words += n.keys()
                    counts += n.values()
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), pa.array(words, pa.string()), pa.array(counts, pa.int64())], kind.names)

        return texts.mapInArrow(found, kind)

    parts, held = None, []
    for row in written(terms, "keywords").toLocalIterator():
        held.append(row.keyword)
        if len(held) == block:
            part, held = written(search(held), "found"), []
            parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return search(held)
    return parts.unionByName(search(held)) if held else parts


def best_words(words: DataFrame, n: int, k: int) -> DataFrame:
    """words(doc_id, keyword), n documents -> (doc_id, keyword, score) of the k best of each by tf-idf, ties by name.

    Texts are cut into words once, for the counts are written; a word's number of
    documents is aggregated before it meets them.
    """
    tf = written(words.groupBy("doc_id", "keyword").agg(F.count("*").alias("tf")), "counts")
    df = tf.groupBy("keyword").agg(F.count("*").alias("df"))
    score = F.round(F.col("tf") * F.log(F.lit(float(1 + n)) / (1 + F.col("df"))), 6)
    scored = tf.join(df, "keyword").select("doc_id", "keyword", score.alias("score"))
    return newest(scored, ["doc_id"], k, F.desc("score"), "keyword")


def mentions(texts: DataFrame, words_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """texts(text, ...) -> the other columns and keyword, a row for each keyword of a text: words_of(text) gives an array of them, be it a model's (the hook) or, by default, its words of six letters or more, of any script."""
    words_of = words_of or (lambda text: F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{6,}"), F.lit(0)))
    return texts.select(*[c for c in texts.columns if c != "text"], F.explode(words_of(F.col("text"))).alias("keyword"))
