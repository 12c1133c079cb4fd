"""Texts whose word shingles are similar: candidates confirmed by whole sets, and an exact set join for what candidates leave open."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from correspond.llm.common import sent_if_small, small_batches
from correspond.operators.graph import components
from correspond.operators.tables import Scratch

#: Similarity as a fraction, in whole numbers so that no rounding decides.
LEAST = (4, 5)
WIDTH = 5
#: Shingle counts of one text in ORDERED_BY (of LEAST_ORDERED texts at least), the HELD most frequent shingles, order the prefixes. The order decides what a run costs, never what it finds.
ORDERED_BY, LEAST_ORDERED, HELD = 16, 8_000, 2_000_000
#: Times that neighbours are compared and their links named before all other pairs are.
ROUNDS = 3
#: Partners that one task compares a text with in one go.
PARTNERS = 256
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def hashes(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of the word shingles of a UTF-8 text in order; a shorter text is one shingle, and so is an empty one."""
    words = (text or b"").lower().split()
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h = np.full(max(1, len(w) - width + 1), min(len(w), width), np.uint64)
    for i in range(min(width, len(w))):
        h += w[i : i + len(h)] * np.uint64(_ODD[i])
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(by)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The set of them, sorted."""
    return np.unique(hashes(text, width))


#: Bits of a sketch, as numbers of 64 bits.
_WORDS = 16


def sketch(h: np.ndarray) -> tuple[int, list[int]]:
    """SimHash of shingle hashes, repeats counted (a bit that over half of them have); and of their set, a bit for each of 1,024 buckets: whether it holds an odd number.
    Two sets differ in one shingle or more for each bit in which their sketches differ."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    odd = np.bincount((np.unique(h) >> np.uint64(54)).astype(np.int64), minlength=64 * _WORDS) & 1
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0]), np.packbits(odd.astype(bool), bitorder="little").view(np.int64).tolist()


SKETCH = [f"s{k}" for k in range(_WORDS)]


def sketches(keyed: DataFrame) -> DataFrame:
    """keyed(_key, text) -> (_key, fp, size, s0, ...), a row for each different text."""
    names = ["_key", "fp", "size", *SKETCH]

    def run(batches):
        seen = set()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    h = hashes(text)
                    fp, odd = sketch(h)
                    rows.append((key, fp, len(np.unique(h)), *odd))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return small_batches(keyed.select("_key", F.col("text").cast("binary"))).mapInArrow(run, ", ".join(f"{n} long" for n in names)).dropDuplicates(["_key"])


def _close(size_a: Column, size_b: Column, a: str, b: str) -> Column:
    """Sketches (structs) do not rule out that sets of these sizes are similar: similar ones differ in no more than their sizes' sum times (1 - s) / (1 + s)."""
    differ = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH), F.lit(0))
    return sum(LEAST) * differ <= (LEAST[1] - LEAST[0]) * (size_a + size_b)


def with_keys(docs: DataFrame) -> DataFrame:
    """docs with _key, one number for each different text (null counts as empty); a seed under which two texts clash is passed over."""
    text = F.coalesce(F.col("text"), F.lit(""))
    for seed in range(100):
        keyed = docs.withColumn("_key", F.xxhash64(F.lit(seed), text))
        other = F.xxhash64(F.lit(seed + 1000), text, F.char_length(text))
        if keyed.groupBy("_key").agg(F.min(other).alias("a"), F.max(other).alias("b")).where("a <> b").isEmpty():
            return keyed
    raise ValueError("more different texts than 64 bits tell apart")


def _by_text(keyed: DataFrame, of, kind: str) -> DataFrame:
    """Arrow batches that `of` makes of (_key, set of shingles), each text once a task, so that copies are no more than tasks."""

    def run(batches):
        seen = set()
        for batch in batches:
            found = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    found.append((key, shingles(text)))
            if found:
                yield of(found)

    return small_batches(keyed.select("_key", F.col("text").cast("binary"))).mapInArrow(run, kind)


def _signed(parts) -> pa.Array:
    return pa.array(np.concatenate(parts).view(np.int64))


def _frequent(keyed: DataFrame, t: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three or more of some texts hold, the most frequent HELD or so, and how many; so that shingles of no more than some ORDERED_BY * 3 texts count as rare, whatever the number of texts."""
    n = keyed.select("_key").count()
    some = max(LEAST_ORDERED, n // ORDERED_BY)
    drawn = keyed if n <= some else keyed.where(F.pmod(F.xxhash64(F.lit(7), "_key"), F.lit(1 << 30)) < int((1 << 30) * some / n))
    rows = _by_text(drawn, lambda found: pa.RecordBatch.from_arrays([_signed([s for _, s in found])], ["h"]), "h long")
    counts = t.written(rows.groupBy("h").agg(F.count("*").cast("int").alias("n")).where("n > 2"), "counts")
    upto = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over different counts, not shingles
    least = counts.groupBy("n").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(upto)).where(F.col("upto") <= HELD).agg(F.min("n")).first()[0]
    held = counts.where(F.col("n") >= (least or 1 << 30)).toArrow()
    h, n = held["h"].to_numpy().view(np.uint64), held["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _prefixes(keyed: DataFrame, t: Scratch) -> DataFrame:
    """(h, key, at): of each text so many of its shingles, the rarest first, that two similar texts have one of them in common."""
    num, den = LEAST
    held = keyed.sparkSession.sparkContext.broadcast(_frequent(keyed, t))

    def of(found):
        often, times = held.value
        hs, keys, ats = [], [], []
        for key, s in found:
            count = np.zeros(len(s), np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                count = np.where(often[at] == s, times[at], 0)
            p = len(s) - -(-num * len(s) // den) + 1
            hs.append(s[np.lexsort((s, count))[:p]])
            keys.append(np.full(p, key, np.int64))
            ats.append(np.arange(p, dtype=np.int64) | (len(s) << 32))
        return pa.RecordBatch.from_arrays([_signed(hs), _signed(keys), _signed(ats)], ["h", "key", "at"])

    return _by_text(keyed, of, "h long, key long, at long")


def _size(at: str) -> Column:
    return F.shiftright(at, 32)


def _can_be(a: str, b: str) -> Column:
    """Both sets have sizes of similar ones, and as many shingles from this one on as similar sets of these sizes share. True at the first shingle that a similar pair has in common."""
    place = lambda at: F.col(at).bitwiseAND(F.lit((1 << 32) - 1))
    rest = F.least(_size(a) - place(a), _size(b) - place(b))
    return (LEAST[1] * F.least(_size(a), _size(b)) >= LEAST[0] * F.greatest(_size(a), _size(b))) & (sum(LEAST) * rest >= LEAST[0] * (_size(a) + _size(b)))


def confirmed(keyed: DataFrame, pairs: DataFrame, width: int = WIDTH) -> DataFrame:
    """keyed(_key, text), any number of rows a text, and pairs(a, b) -> the pairs whose sets of shingles are similar, by whole sets.

    A text travels to the texts that it is compared with; one with many partners is
    sent to several tasks, PARTNERS or so to each, so no task holds more than one set and a batch of texts.
    """
    num, den = LEAST
    cuts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("cuts"))
    whole = cuts.select(F.col("a").alias("_key"), F.col("a").alias("to"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.lit(False).alias("second"))
    many = sent_if_small(cuts.where("cuts > 1").select("a", "cuts"))
    part = pairs.join(many, "a", "left").select(F.col("b").alias("_key"), F.col("a").alias("to"), F.pmod(F.xxhash64("b"), F.coalesce("cuts", F.lit(1))).cast("int").alias("cut"), F.lit(True).alias("second"))
    asked = whole.unionByName(part)
    keys = sent_if_small(pairs.select(F.explode(F.array("a", "b")).alias("_key")).distinct())
    texts = keyed.select("_key", F.col("text").cast("binary").alias("text")).join(keys, "_key", "left_semi").groupBy("_key").agg(F.first("text").alias("text"))
    rows = texts.join(asked, "_key").repartition("to", "cut").sortWithinPartitions("to", "cut", "second")

    def compare(batches):
        own, to = None, None
        for batch in batches:
            a, b = [], []
            for key, text, group, cut, second in zip(*(batch.column(c).to_pylist() for c in ("_key", "text", "to", "cut", "second")), strict=True):
                s = shingles(text, width)
                if not second:
                    own, to = s, (group, cut)
                elif to == (group, cut) and den * min(len(s), len(own)) >= num * max(len(s), len(own)):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if den * both >= num * (len(own) + len(s) - both):
                        a.append(group)
                        b.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return small_batches(rows).mapInArrow(compare, "a long, b long")


def similar_texts(keyed: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """keyed(_key, text) -> (node, component) of the keys of texts that a chain of texts links to another, each like the next by LEAST or more.

    Every pair is found: similar sets have a shingle in common among the rarest of
    each, one more than may be missing. `candidates`(a, b) and pairs of neighbours
    under a shingle are compared first, in ROUNDS orders; then all pairs of such
    texts that these links have not brought together, so that a large group of near
    copies gives no square of pairs. Pairs that sketches (`known`, or made here) do not rule out are
    confirmed by whole sets of 64-bit shingle hashes.
    """
    t = Scratch(keyed.sparkSession, "similar")
    known = t.written(sketches(keyed), "sketches") if known is None else known
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    under = Window.partitionBy("h").orderBy("key")
    rows = _prefixes(keyed, t).withColumn("prev", F.lag("key").over(under)).where("prev is null or prev <> key")
    rows = rows.withColumn("next", F.lead("key").over(under))
    shared = t.written(rows.where("prev is not null or next is not null").select("h", "key", "at"), "shared")
    t.drop("counts")
    t.free_shuffles()
    side = lambda k: known.select(F.col("_key").alias(k), F.col("size").alias(f"size_{k}"), F.struct(*SKETCH).alias(f"sketch_{k}"))
    met = links = None
    for turn in range(ROUNDS + 1):
        if turn == 0:
            first = F.first(F.struct("key", "at")).over(under.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            near = shared.select("key", "at", F.array(F.lag(F.struct("key", "at")).over(under), first).alias("before")).select("key", "at", F.explode("before").alias("o")).where(F.col("o.key") != F.col("key"))
        elif turn < ROUNDS:
            mixed = Window.partitionBy("h").orderBy(F.xxhash64(F.lit(turn), "key"))
            before = F.array(*[F.lag(F.struct("key", "at", "of"), k).over(mixed) for k in (1, 2, 3)])
            near = shared.select("key", "at", "of", before.alias("before")).select("key", "at", "of", F.explode("before").alias("o")).where("o.of <> of")
        else:
            whole = shared.join(known.select(F.col("_key").alias("key"), F.struct(*SKETCH).alias("sketch")), "key")
            other = whole.select("h", F.struct("key", "at", "of", "sketch").alias("o"))
            near = whole.join(other, (whole["h"] == other["h"]) & (F.col("o.of") < F.col("of")) & _can_be("at", "o.at") & _close(_size("at"), _size("o.at"), "sketch", "o.sketch"))
        near = (near.where(_can_be("at", "o.at")) if turn < ROUNDS else near).select(*ordered("o.key", "key"))
        if turn == 0 and candidates is not None:
            near = near.unionByName(candidates.select(*ordered("a", "b")))
        near = near.distinct() if turn == 0 else near.distinct().join(met, ["a", "b"], "left_anti")
        if turn < ROUNDS:
            near = near.join(side("a"), "a").join(side("b"), "b").where(_close(F.col("size_a"), F.col("size_b"), "sketch_a", "sketch_b")).select("a", "b")
        near = t.written(near, f"near{turn}")
        t.free_shuffles()
        found = t.written(confirmed(keyed, near), f"links{turn}")
        t.free_shuffles()
        links, met = (found, near) if turn == 0 else (links.unionByName(found), met.unionByName(near))
        if turn == ROUNDS and found.isEmpty():
            break
        linked = components(links.select(F.col("a").alias("source"), F.col("b").alias("target")))
        if turn == ROUNDS:
            break
        to = linked.select(F.col("node").alias("key"), "component")
        named = shared.select("h", "key", "at").join(sent_if_small(to), "key", "left").select("h", "key", "at", F.coalesce("component", "key").alias("of"))
        several = t.written(named.groupBy("h").agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x <> y").select("h"), "several")
        if several.isEmpty():
            break
        shared = t.written(named.join(sent_if_small(several), "h", "left_semi"), f"open{turn}")
        t.drop("shared" if turn == 0 else f"open{turn - 1}")
        t.free_shuffles()
    t.keep()
    return linked
