"""Language identification by error-correcting output codes over n-gram classifiers."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from correspond.llm.common import held_out, sent_if_small, small_batches, table, unit

#: Hashed n-grams of 1 to 3 bytes.
WIDTH = 2048
#: ASCII letters are lower-cased, all other ASCII is white space; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def features(text: bytes | None) -> np.ndarray:
    """Square roots of the shares of n-grams of a whole text, white space folded; of length 1 unless there are none."""
    folded, total = b" " + b" ".join((text or b"").translate(_FOLD).split()) + b" ", np.zeros(WIDTH)
    for k in range(0, len(folded) - 2, 1 << 20):
        c = np.frombuffer(folded[k : k + (1 << 20) + 2], np.uint8).astype(np.uint32)
        two = c[:-1] << np.uint32(8) | c[1:]
        three = two[:-1] << np.uint32(8) | c[2:]
        for grams, salt in ((c[:-2], 1 << 24), (two[:-1], 2 << 24), (three, 3 << 24)):
            total += np.bincount(((grams + np.uint32(salt)) * np.uint32(2654435761)) >> np.uint32(21), minlength=WIDTH)
    return np.sqrt(total / max(1.0, total.sum())).astype(np.float32)


def codewords(n: int, seed: int = 4) -> np.ndarray:
    """(n, bits) of -1 and 1: all different splits of up to 6 languages, else the best spread of 64 random codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        return np.array([[1 if k == 0 else 1 - 2 * (s >> (k - 1) & 1) for s in range(1, 1 << (n - 1))] for k in range(n)])
    r, bits = np.random.default_rng(seed), max(16, int(np.ceil(10 * np.log2(n))))
    codes = (2 * r.integers(0, 2, (n, bits)) - 1 for _ in range(64))
    return max(codes, key=lambda c: (((bits - c @ c.T) // 2) + np.eye(n, dtype=int) * bits).min())


def train(x: np.ndarray, y: np.ndarray, codes: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-5) -> dict:
    """A logistic classifier for each bit of the codewords, by Adam; languages count alike."""
    mean = x.mean(axis=0)
    x = np.hstack(((x - mean) * 30, np.ones((len(x), 1), np.float32))).astype(np.float32)
    goal = codes[y].astype(np.float32)
    weight = (1.0 / np.bincount(y, minlength=len(codes)).clip(1)[y])[:, None].astype(np.float32)
    weight /= weight.sum()
    w = np.zeros((x.shape[1], codes.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = -x.T @ (weight * goal / (1 + np.exp(np.clip(goal * (x @ w), -50, 50)))) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "w": w, "codes": codes}


def decode(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword by summed logistic loss; its share among all; its lead over the second, a bit."""
    z = ((x - model["mean"]) * 30) @ model["w"][:-1] + model["w"][-1]
    up = (model["codes"] > 0).astype(z.dtype)
    loss = (np.logaddexp(0, -z) @ up.T + np.logaddexp(0, z) @ (1 - up).T) / up.shape[1]  # of a bit of 1, of a bit of -1
    e = np.exp(np.clip((loss.min(axis=1, keepdims=True) - loss) * min(8, model["codes"].shape[1]), -50, 0))
    order = np.sort(loss, axis=1)
    lead = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(x), np.inf)
    return loss.argmin(axis=1), e.max(axis=1) / e.sum(axis=1), lead


def fit(docs: DataFrame, max_a_language: int = 1000, max_documents: int = 16_000) -> dict | None:
    """Trains on documents that aren't held out and have a language, by hash: about max_a_language of each, and about max_documents
    in all, shared evenly, but at least the one of the smallest hash of each language, however many there are. The driver holds 4 KB a document."""
    number = F.coalesce(unit(F.struct("doc_id", F.xxhash64("text")), 19), F.lit(0.0))
    known = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(number).alias("least")).collect()
    if not counts:
        return None
    of_each = min(max_a_language, max(1, max_documents // len(counts)))
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, of_each / r.n), r.least) for r in counts], "lang string, share double, least double")
    drawn = known.join(sent_if_small(share), "lang").where((number < F.col("share")) | (number <= F.col("least")))

    def of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["lang", "x"])

    seen = drawn.select("lang", F.col("text").cast("binary")).mapInArrow(of, "lang string, x binary").distinct().orderBy("lang", "x").collect()
    langs = sorted({r.lang for r in seen})
    x, number = np.array([np.frombuffer(r.x, np.float16) for r in seen], np.float32), {lang: k for k, lang in enumerate(langs)}
    return train(x, np.array([number[r.lang] for r in seen]), codewords(len(langs))) | {"langs": langs} if langs else None


def languages(docs: DataFrame, ambiguous_below: float = 0.05) -> DataFrame:
    """docs(doc_id, text, lang) -> (doc_id, held_out, lang_pred, score, ambiguous), a row for each row of docs.

    lang is read to learn from alone. Texts that are null or have no letter, and all
    texts where there is nothing to learn from, are `und` with score 0; whole texts
    are read at any length; equal texts are judged alike; an empty table gives none;
    other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]).add("held_out", "boolean").add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(2).to_pylist()
                langs, scores, near = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if rows := [k for k, t in enumerate(texts) if model.value and has_letter(t)]:
                    best, p, lead = decode(np.array([features(texts[k].encode()) for k in rows]), model.value)
                    scores[rows], near[rows] = p, lead < ambiguous_below
                    for k, b in zip(rows, best.tolist(), strict=True):
                        langs[k] = model.value["langs"][b]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores), pa.array(near)], kind.names)

    return small_batches(docs.select("doc_id", held_out().alias("held_out"), "text")).mapInArrow(of, kind)


def op10_language(spark, sf_dir):
    return languages(table(spark, sf_dir, "documents"))
