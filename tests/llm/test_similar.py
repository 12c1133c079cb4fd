"""Near-duplicate texts against a comparison of all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF

from correspond.llm import similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def groups(texts):
    """Numbers of the groups of texts, by all pairs."""
    sets, of = [shingles(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if of[i] != of[j] and 5 * len(x & y) >= 4 * len(x | y):
                old, new = of[i], of[j]
                of = [new if k == old else k for k in of]
    return of


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    out = [None, "", " \n", "one", "One", "two words", "a b c d e", "a b c d e f", "same " * 30, "same " * 40]
    for _ in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice((8, 30, 64, 200)))]
        out += [edited(r, base, k) for k in (0, 0, 1, 1, 2, 3, 5)]
    line = [f"l{k}" for k in range(25)]
    return out + [" ".join([*line, *(f"x{i}{k}" for k in range(i % 9))]) for i in range(60)]


def test_all_pairs(spark, texts):
    docs = spark.createDataFrame([(i, t, "a", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    of = groups(texts)
    want = {min(k for k in range(len(of)) if of[k] == g) for g in set(of)}
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()} == want


def test_edited_copies_of_the_table(spark):
    """Documents 2 and 56 are 0.967 alike, 5 bits apart in their 3-word fingerprints."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    of = groups([r.text for r in rows])
    first = {}
    for r, g in zip(rows, of, strict=True):
        first[g] = min(r.doc_id, first.get(g, r.doc_id))
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()} == set(first.values())


def test_order_decides_nothing(spark, texts, monkeypatch):
    docs = similar.with_keys(spark.createDataFrame([(i, t, "a", "s", 0) for i, t in enumerate(texts)], SCHEMA))
    want = {tuple(r) for r in similar.similar_texts(docs).collect()}
    for name, value in (("LEAST_ORDERED", 3), ("HELD", 2), ("ROUNDS", 1), ("PARTNERS", 2)):
        monkeypatch.setattr(similar, name, value)
    assert {tuple(r) for r in similar.similar_texts(docs).collect()} == want


def test_sketches_rule_out_no_similar_pair():
    """Bits in which sketches differ are no more than shingles in which the sets do."""
    r = random.Random(7)
    for n in (5, 40, 300, 3000):
        base = [f"w{r.randrange(9999)}" for _ in range(n)]
        for k in (0, 1, 3, n // 10, n // 2, n):
            x, y = (similar.hashes(t.encode()) for t in (" ".join(base), edited(r, base, k)))
            (_, a), (_, b) = similar.sketch(x), similar.sketch(y)
            assert sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(a, b, strict=True)) <= len(np.setxor1d(x, y))


def test_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    near = a + " more"
    rows = [(3, a), (5, a), (5, b), (7, b), (7, b), (5, c), (None, c), (None, d), (None, d), (9, near), (None, near), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "a", "s", 0) for i, t in rows], SCHEMA).repartition(4)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted([(3, a), (5, b), (5, c), (None, d), (8, "")], key=str)
