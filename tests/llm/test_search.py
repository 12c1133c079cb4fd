"""Search, resampling and I-Match fingerprints against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from correspond.llm import imatch, resample, search
from correspond.llm.words import word_blocks

R = random.Random(8)
VOCAB = [f"w{k}" for k in range(60)] + ["été", "Naïve", "10", "日本", "x"]
TEXTS = [None, "", " \n\t.,;", "one", "Été ÉTÉ été!", "x " * 3000 + "w1", "w1,w2;W3\x00w4\x1fw5", "-- w1 --"]
TEXTS += [" ".join(R.choices(VOCAB, k=R.randrange(1, 120), weights=[1 / (k + 1) for k in range(len(VOCAB))])) for _ in range(300)]
TEXTS += [TEXTS[20]] * 30 + [TEXTS[21] + " w59 w58"]
SCHEMA = "doc_id long, text string, score long, rank int, row long, n long, h string, _h string, _range int"
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, 2, 3, 4, "h", "x", 5) for i, t in enumerate(TEXTS)]
    rows += [rows[15], rows[15], (15, "w1 w2 another text of the same id", 1, 2, 3, 4, "h", "x", 5), (None, TEXTS[16], 1, 2, 3, 4, "h", "x", 5), (None, "no id", 1, 2, 3, 4, "h", "x", 5)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_blocks():
    texts = ["a bb ccc", None, "", "Dd " * 50 + "e" * 40 + " f g", "é1 ZZ"]
    for most in (7, 30, 1 << 20):
        for overlap in (0, 1, 3):
            got = [[] for _ in texts]
            for found, piece, row, again in word_blocks([None if t is None else t.encode() for t in texts], most, overlap):
                place = np.arange(len(found)) - np.searchsorted(piece, piece)
                for w, p, at in zip(found, piece.tolist(), place.tolist(), strict=True):
                    if at >= again[p]:
                        got[row[p]].append(w.decode())
            assert got == [words(t) for t in texts]


def ranked(rows, queries, k=10):
    """Each query's best documents, by scoring every document."""
    counts = [(i, Counter(words(t))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(w for _, c in counts for w in c)
    out = []
    for item, text in queries:
        found = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words(text) if w in c)
            if s > 0:
                found.append((-s, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("leaf, postings, terms", [(1, 200, 200_000), (4, 100_000, 12), (128, 3000, 200_000)])
def test_search(spark, docs, empty, monkeypatch, leaf, postings, terms):
    monkeypatch.setattr(search, "LEAF", leaf)
    queries = [(1, "w1 w1 w7 été"), (2, TEXTS[20]), (3, None), (4, ", ;"), (5, "unknown words"), (6, "w59 w58 x"), (6, "w40"), (None, "w2 w30"), (8, TEXTS[40]), (8, TEXTS[40])]
    asked = spark.createDataFrame(queries, "item_id long, text string")
    got = sorted(map(tuple, search.ranked_search(docs, asked, block_terms=terms, postings=postings).collect()), key=str)
    assert got == ranked([(r.doc_id, r.text) for r in docs.collect()], queries)
    assert search.ranked_search(empty, asked).count() == 0 and search.ranked_search(docs, asked.limit(0)).count() == 0


def test_search_leaves_intervals():
    """Of 20,000 documents most are in intervals that are never opened, and copies that tie cost no more."""
    r = np.random.default_rng(3)
    ids, sizes = list(range(20_000)), r.integers(20, 200, 20_000)
    posts = [np.sort(r.choice(20_000, n, replace=False)) for n in (9000, 4000, 300, 20)]
    counts = np.array([len(p) for p in posts])
    own = search.Shard(ids, sizes, np.arange(20_000), np.arange(4), counts, np.concatenate(posts).astype(np.uint16).tobytes(), np.ones(counts.sum(), np.uint32).tobytes(), 20_000, int(sizes.sum()))
    best, weight = [], np.array([10, 900, 3000, 9000])
    steps = own.search(np.arange(4), weight, best, 10)
    total = np.zeros(20_000, np.int64)
    for p, w, s, e in zip(posts, weight, own.starts, own.ends, strict=True):
        total[p] += w * own.impact[s:e]
    assert best == sorted((-int(total[d]), False, d) for d in range(20_000))[:10] and steps < 150
    same = search.Shard(ids, np.full(20_000, 50), np.arange(20_000), np.arange(1), np.array([20_000]), np.arange(20_000).astype(np.uint16).tobytes(), np.ones(20_000, np.uint32).tobytes(), 20_000, 1_000_000)
    best = []
    assert same.search(np.arange(1), np.array([5]), best, 10) <= 12 and [b[2] for b in best] == list(range(10))


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resample(spark, docs, empty, longest):
    goal = spark.createDataFrame([(1, "w1 w2 w3 w1 w2"), (2, None), (3, TEXTS[30])], "item_id long, text string")
    grams = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % 500
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    s, t = Counter(bucket(g) for _, x in rows for g in grams(x)), Counter(bucket(g) for r in goal.collect() for g in grams(r.text))
    all_s, all_t = sum(s.values()) + 500, sum(t.values()) + 500
    want = []
    for i, x in rows:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in map(bucket, grams(x)))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(grams(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)) >= 20])
    able = sorted((r for r in want if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: 30 * len(able) // 100]):
        r[4] = k + 1
    got = resample.resample(docs, goal, longest=longest, buckets=500, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[:5])) for r in want)
    assert resample.resample(empty, goal).count() == 0
    assert {r.weight for r in resample.resample(docs, goal.limit(0)).where("n_features = 0").collect()} == {0}


def test_features_of_long_texts():
    """Runs are the same if a text comes in pieces, and none crosses from one text to the next."""
    texts = [t and t.encode() for t in TEXTS[:40]]
    count = lambda most: Counter((n, int(r), int(c)) for n, rows, codes in resample.features(texts, 3, resample._Crc(), most) for r, c in zip(rows, codes, strict=True))
    assert count(1 << 22) == count(64) == Counter((n, k, zlib.crc32(" ".join(w[i : i + n]).encode())) for k, t in enumerate(TEXTS[:40]) for w in [words(t)] for n in (1, 2, 3) for i in range(len(w) - n + 1))


def test_imatch(spark, docs, empty):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    for range_bytes in (1 << 24, 500):
        found = imatch.fingerprint_edits(docs, rarest=50, commonest=3, range_bytes=range_bytes)
        got = found.collect()
        assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"] and len(got) == len(rows)
        # Rows of one id follow each other in an order of the operator's own.
        hashed = {t: h for t, h in docs.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
        order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashed[r[1]]))
        df, n = Counter(w for _, t in rows for w in set(words(t))), len(rows)
        lexicon = np.sort(np.array([imatch._Hashes()[w.encode()] for w, c in df.items() if c * 50 >= n and c * 3 <= n], np.uint64))
        plain = lambda t: imatch.fingerprints([t.encode()], lexicon, imatch._Hashes())[0]  # noqa: E731, B023
        want = []
        for k, (i, t) in enumerate(order):
            following = order[(k + 1) % n][1]
            e = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
            want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), plain(t), plain(e), imatch.likeness(plain(t), plain(e)), imatch.likeness(plain(t), plain(following))))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        assert len({r.fingerprint for r in got if r.doc_id is not None and TEXTS[r.doc_id] == TEXTS[20]}) == 1
    assert imatch.fingerprint_edits(empty).count() == 0
    alone = imatch.fingerprint_edits(docs.where("doc_id = 9")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0 and alone[0].edited_sha256 == hashlib.sha256((TEXTS[9][: len(TEXTS[9]) - len(TEXTS[9]) // 4] + TEXTS[9][: len(TEXTS[9]) // 4]).encode()).hexdigest()


def test_subsets_by_definition():
    """Each hash depends on the lexicon's terms of its subset alone, whatever their order and number in the text."""
    vocab = [f"t{k}" for k in range(400)]
    known = imatch._Hashes()
    lexicon = np.sort(np.array([known[w.encode()] for w in vocab[:300]], np.uint64))
    some = R.sample(vocab, 200)
    a, b, c = imatch.fingerprints([" ".join(some).encode(), " ".join(sorted(some) * 2).upper().encode(), " ".join(some[:199]).encode()], lexicon, known)
    assert a == b and a[0] == "b"
    x, y = (np.frombuffer(bytes.fromhex(f[3:]), ">u2") for f in (a, c))
    assert (x != y).sum() <= (2 if some[199] in vocab[:300] else 0) and imatch.likeness(a, c) >= 0.95
    few = [imatch.fingerprints([" ".join(vocab[:k]).encode()], lexicon, known)[0] for k in (30, 31)]  # on the first level all terms count
    assert sum(p != q for p, q in zip(*(np.frombuffer(bytes.fromhex(f[3 : 3 + 256]), ">u2") for f in few), strict=True)) == 1
    assert imatch.likeness(a, a) == 1 and imatch.likeness(*imatch.fingerprints([b"", b"t1"], lexicon, known)) == 0
    assert imatch.fingerprints([b"t1 t2"], lexicon[:0], known)[0][0] == "a" and imatch.fingerprints([b"?"], lexicon, known)[0][0] == "t"


def test_narrowed_lexicon(spark, docs):
    n = docs.count()
    df = Counter(w for r in docs.collect() for w in set(words(r.text)))
    whole = imatch.lexicon(docs, n, 1000, 1)
    assert whole.tolist() == sorted(imatch._Hashes()[w.encode()] for w in df)
    for most in (10, 30):
        least = min(x for x in df.values() if sum(c >= x for c in df.values()) <= most)
        assert imatch.lexicon(docs, n, 1000, 1, most).tolist() == sorted(imatch._Hashes()[w.encode()] for w, c in df.items() if c >= least)


def test_edits_are_told_from_other_texts(spark):
    from conftest import SF

    got = imatch.op13_imatch(spark, SF).collect()
    assert np.mean([r.near_edited for r in got]) > 0.45 and np.mean([r.near_next for r in got]) < 0.05
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.97
