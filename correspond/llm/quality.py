"""Quality classifier: positive-unlabelled learning with the non-negative risk."""

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from correspond.llm.common import held_out, small_batches, table, unit

#: Classes of bytes whose shares, singly and in pairs, describe a text's make-up.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!?", b"|", b"#*$%&<>=~^@_+/\\", b"\"'`()[]{}-"]
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _k, _chars in enumerate(CLASSES):
    _CLASS[list(_chars)] = _k
_N = len(CLASSES) + 1
#: Bytes of a text that are looked at together.
STEP = 1 << 20


def features(text: bytes | None) -> np.ndarray:
    """A fixed number of figures for a whole text: shares of byte classes and pairs, repetition of words and lines, lengths."""
    text = text or b""
    pairs, words, lines, n_words, n_lines, again, at = np.zeros(_N * _N), Counter(), Counter(), 0, 0, 0, 0
    while at < len(text):
        end = at + STEP
        if end < len(text):  # cut at white space, if there is some
            end = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end)) + 1 or end
        part = text[at:end]
        c = _CLASS[np.frombuffer(part, np.uint8)]
        pairs += np.bincount(c[:-1] * np.uint8(_N) + c[1:], minlength=_N * _N)
        found = part.split()
        words.update(found)
        n_words += len(found)
        again += sum(map(eq, found, found[1:]))  # words right after themselves
        found = [x for x in part.split(b"\n") if x.strip()]
        lines.update(found)
        n_lines += len(found)
        at = end
    n = max(1, len(text))
    single = pairs.reshape(_N, _N).sum(axis=1)
    top = max(words.values(), default=0)
    more = [np.log1p(n_words), np.log1p(n_lines), len(words) / max(1, n_words), np.log1p(len(words)) / np.log(2 + n_words), top / max(1, n_words), len(lines) / max(1, n_lines), np.log1p(n / max(1, n_words)), np.log1p(n_words / max(1, n_lines)), np.sqrt(again / max(1, n_words)), *(float(n_words <= k) for k in (0, 8, 16, 32, 64))]
    return np.concatenate((np.sqrt(pairs / n), np.sqrt(single / n), more)).astype(np.float32)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 800, rate: float = 0.02, decay: float = 1e-4) -> dict:
    """Weights of a linear score by Adam on the non-negative risk, logistic loss.

    Risk: prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]). Where the
    second part turns negative, the step climbs out of it instead, as the unbiased
    risk would overfit there.
    """
    both = np.concatenate((positive, unlabelled))
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale = np.where(scale < 1e-6, 1.0, scale)
    p, u = (np.hstack((np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1)))).astype(np.float64) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_rest = u.T @ sigmoid(zu) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
        g = -prior * (p.T @ sigmoid(-zp)) / len(p) + of_rest if rest >= 0 else -of_rest
        g = g + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "scale": scale, "w": w}


def score(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"][:-1] + model["w"][-1]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def mixture_share(of_positive: np.ndarray, of_unlabelled: np.ndarray) -> float:
    """Class prior without negatives: the smallest ratio of unlabelled to positive scores above a threshold that a fifth of the positives pass."""
    least = np.quantile(of_positive, np.linspace(0.0, 0.8, 33))
    ratios = [(of_unlabelled >= t).mean() / max(1e-9, (of_positive >= t).mean()) for t in least]
    return float(np.clip(min(ratios), 0.05, 0.99))


def _sampled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Features of the documents whose id is among a bounded number of ids; of an id that repeats, the smallest."""

    def of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], ["doc_id", "part", "x"])

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("part", T.StringType()), T.StructField("x", T.BinaryType())])
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "part", F.col("text").cast("binary")).mapInArrow(of, kind).groupBy("doc_id", "part").agg(F.min("x").alias("x"))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 6000) -> dict:
    """Trains on documents that aren't held out: at most max_positive that `labels` trusts (quality 1) and max_unlabelled of all, by hash order.

    The class prior is the share of quality 1 among the labels that aren't held out;
    where these have no 0, it is estimated from the scores of a first model.
    """
    known = labels.select("doc_id", "quality").where(~held_out())
    counts = {r[0]: r[1] for r in known.where("quality is not null").groupBy("quality").count().collect()}
    shuffled = F.xxhash64(F.lit(11), F.col("doc_id"))
    positive = known.where("quality = 1").select("doc_id").distinct().orderBy(shuffled, "doc_id").limit(max_positive).withColumn("part", F.lit("p"))
    total = docs.count()
    drawn = docs.select("doc_id").where(~held_out() & (unit(F.col("doc_id"), 13) < min(1.0, 1.3 * max_unlabelled / max(1, total))))
    unlabelled = drawn.distinct().orderBy(shuffled, "doc_id").limit(max_unlabelled).withColumn("part", F.lit("u"))
    rows = _sampled(docs, positive.unionByName(unlabelled)).orderBy("part", "doc_id").collect()
    x = {k: np.array([np.frombuffer(r.x, np.float32) for r in rows if r.part == k]) for k in "pu"}
    if not len(x["p"]) or not len(x["u"]):
        return {"mean": np.float32(0), "scale": np.float32(1), "w": np.array([0.0] * len(features(b"")) + [0.0 if not counts else 2.0 * (counts.get(1, 0) > 0) - 1.0]), "prior": 0.5}
    if counts.get(0):
        prior = counts.get(1, 0) / (counts[0] + counts.get(1, 0))
    else:
        first = train(x["p"], x["u"], 0.5, steps=200)
        prior = mixture_share(score(x["p"], first), score(x["u"], first))
    return train(x["p"], x["u"], float(np.clip(prior, 0.05, 0.99))) | {"prior": prior}


def quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """docs(doc_id, text, ...) -> columns `keep` (doc_id) and held_out, score, predicted, a row for each row of docs.

    Every whole text is scored; null counts as empty, and empty texts are scored like
    others. With no label or no document to learn from, every score is the same.
    Repeated rows are scored alike; an empty table gives none; input columns of the
    result's names are replaced.
    """
    keep = [c for c in keep or ["doc_id"] if c not in ("held_out", "score", "predicted")]
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select(*dict.fromkeys([*keep, "text"]), held_out().alias("held_out"))
    names = [*keep, "held_out", "score"]
    kind = T.StructType([*(rows.schema[c] for c in names[:-1]), T.StructField("score", T.DoubleType())])

    def of(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            got = [score(np.array([features(t) for t in texts.slice(k, 512).to_pylist()]), model.value) for k in range(0, batch.num_rows, 512)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(np.concatenate(got) if got else np.zeros(0))], names)

    return small_batches(rows).mapInArrow(of, kind).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
