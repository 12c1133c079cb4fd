"""I-Match fingerprints: hashes of randomised subsets of a lexicon of terms with a middling document frequency."""

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from correspond.llm.common import small_batches, table
from correspond.llm.words import word_blocks

#: The band: terms of at least one document in RAREST, and at most one in COMMONEST.
RAREST, COMMONEST = 1000, 2
#: Terms that the lexicon may have, 8 bytes each in every worker; there are fewer than RAREST times a document's mean number of different terms.
MAX_LEXICON = 8_000_000
#: Random subsets of a level, and hexadecimal digits of each one's hash.
SUBSETS, DIGITS = 64, 4
#: Bytes of text that one range of documents has, and sampled rows from which a range's edge is chosen.
RANGE_BYTES, SAMPLED = 16 << 20, 32
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


class _Hashes(dict):
    """Hashes of terms, remembered; begun anew when there are too many."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[term] = h = xxhash.xxh64_intdigest(term)
        return h


def term_sets(texts: list[bytes | None], known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes): each text's different terms, by row and hash."""
    rows, hashes = [], []
    for words, piece, row, _ in word_blocks(texts):
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        r = row[piece]
        order = np.lexsort((h, r))
        r, h = r[order], h[order]
        first = np.ones(len(h), bool)
        first[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        rows.append(r[first])
        hashes.append(h[first])
    if len(rows) == 1:
        return rows[0], hashes[0]
    r, h = np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*hashes, np.zeros(0, np.uint64)])
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    first = np.ones(len(h), bool)  # pieces of a long text share terms
    first[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[first], h[first]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """docs(text) -> (h, n): each term's hash and number of documents; every row is a document. Tasks add up before the shuffle."""

    def count(batches):
        known, held, size = _Hashes(), [], 0

        def summed():
            h, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            order = np.argsort(h)
            h = h[order]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            return h[starts], np.add.reduceat(n[order], starts) if len(h) else n

        for batch in batches:
            h, n = np.unique(term_sets(batch.column(0).to_pylist(), known)[1], return_counts=True)
            held.append((h, n))
            size += len(h)
            if size > 4_000_000:
                held = [summed()]
                size = len(held[0][0])
                if size > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["h", "n"])
                    held, size = [], 0
        if held:
            h, n = summed()
            for k in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[k : k + 100_000].view(np.int64)), pa.array(n[k : k + 100_000])], ["h", "n"])

    return small_batches(docs.select(F.col("text").cast("binary"))).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, n_docs: int, rarest: int = RAREST, commonest: int = COMMONEST, most: int = MAX_LEXICON) -> np.ndarray:
    """Sorted hashes of the terms in the band. If there are more than `most`, the band begins at the next document frequency that leaves no more."""
    inside = document_frequencies(docs).where((F.col("n") * rarest >= n_docs) & (F.col("n") * commonest <= n_docs))
    found = inside.limit(most + 1).toArrow()
    if found.num_rows > most:
        left, least = 0, None
        for r in inside.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
            left += r["count"]
            if left > most:
                break
            least = r["n"]
        found = inside.where(F.col("n") >= F.lit(least)).toArrow()
    return np.sort(found.column("h").to_numpy().astype(np.int64).view(np.uint64))


def fingerprints(texts: list[bytes | None], words: np.ndarray, known: _Hashes) -> list[str]:
    """A text's terms in the lexicon are dealt to SUBSETS random subsets by their hash, and each subset's sorted terms are hashed.

    Level j keeps one term in 2^j. A fingerprint has the hashes of two levels, the first
    of which leaves SUBSETS terms or fewer, so that a subset has about one and an
    edit changes some subsets alone: `b` (band), level, the hashes (0000: no term). A text without a
    term of the lexicon has all its terms instead (`a`), one without terms a hash of the text (`t`).
    """
    n = len(texts)
    row, h = term_sets(texts, known)
    at = np.searchsorted(words, h)
    inside = (words[np.minimum(at, len(words) - 1)] == h) if len(words) else np.zeros(len(h), bool)
    with_band = np.bincount(row[inside], minlength=n) > 0
    kept = inside | ~with_band[row]
    row, h = row[kept], h[kept]
    size = np.bincount(row, minlength=n)
    level = np.maximum(0, np.frexp(np.maximum(size - 1, 0) / SUBSETS)[1])
    mixed = _mixed(h + _MIX[0])
    subset = (mixed % np.uint64(SUBSETS)).astype(np.int64)
    draw = mixed >> np.uint64(8)
    tables = []
    for more in (0, 1):
        step = (level + more)[row].astype(np.uint64)
        on = (draw & ((np.uint64(1) << step) - np.uint64(1))) == 0
        cell, terms = row[on] * SUBSETS + subset[on], h[on]
        order = np.argsort(cell, kind="stable")  # terms are in order in each row, so they stay so in each cell
        cell, terms = cell[order], terms[order]
        nth = (np.arange(len(cell)) - np.searchsorted(cell, cell)).astype(np.uint64)
        sums = np.zeros(n * SUBSETS, np.uint64)
        np.add.at(sums, cell, _mixed(terms * (np.uint64(2) * nth + np.uint64(1)) + _MIX[0]))
        code = np.zeros(n * SUBSETS, np.uint64)
        full = np.unique(cell)
        code[full] = sums[full] % np.uint64(16**DIGITS - 1) + np.uint64(1)
        tables.append(code.astype(">u2").reshape(n, SUBSETS))
    out = []
    for k, text in enumerate(texts):
        if size[k]:
            out.append(f"{'b' if with_band[k] else 'a'}{level[k]:02d}{tables[0][k].tobytes().hex()}{tables[1][k].tobytes().hex()}")
        else:
            out.append(f"t{xxhash.xxh64_hexdigest(text or b'')}")
    return out


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among the subsets that either has terms in, over the levels that both have; 0 if they have none in common."""
    if a == b:
        return 1.0
    if a[0] != b[0] or a[0] == "t":
        return 0.0
    size, same, held = SUBSETS * DIGITS, 0, 0
    first, second = int(a[1:3]), int(b[1:3])
    for level in {first, first + 1} & {second, second + 1}:
        x, y = (np.frombuffer(bytes.fromhex(f[3 + (level - own) * size : 3 + (level - own + 1) * size]), ">u2") for f, own in ((a, first), (b, second)))
        either = (x != 0) | (y != 0)
        held += int(either.sum())
        same += int((either & (x == y)).sum())
    return same / held if held else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many characters of the beginning of the following one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _edges(keys: DataFrame, n_docs: int, ranges: int, sampled: int) -> list[tuple]:
    """Places of sampled documents, each the first of a range of about n_docs / ranges documents; bounded by `sampled` rows a range."""
    share = min(1.0, sampled * ranges / max(1, n_docs))
    drawn = keys.where(F.pmod(F.xxhash64(F.lit(11), "_none", "doc_id", "_h"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    found = sorted({tuple(r) for r in drawn.select("_none", "doc_id", "_h").collect()})
    return found[:: max(1, -(-len(found) // ranges))][1:]


def fingerprint_edits(docs: DataFrame, rarest: int = RAREST, commonest: int = COMMONEST, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row of docs.

    The edited text is the text with its last quarter replaced by the beginning of the next
    document's, by ascending doc_id (null ids last; rows of one id by a hash of their text; after the last
    comes the first). Documents are dealt once to ranges of that order, whose edges are sampled
    documents; the document at an edge is sent to the range before as well, so no range waits for another.

    Null and empty texts are equal texts without terms; texts of any length are read whole; equal texts have
    equal fingerprints, in whatever row; a single document follows itself; an empty table gives
    none; other columns are not read. The lexicon is sent to every task: it has fewer terms than `rarest` times a document's mean
    number of terms, and MAX_LEXICON at most.
    """
    spark = docs.sparkSession
    id_field = docs.schema["doc_id"]
    keyed = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).select("doc_id", F.col("doc_id").isNull().alias("_none"), F.xxhash64("text").alias("_h"), "text")
    n_docs, size, first = keyed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.min(F.struct("_none", "doc_id", "_h"))).first()
    ranges = max(1, min(n_docs // SAMPLED, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // range_bytes)))
    edges = _edges(keyed, n_docs, ranges, SAMPLED) if ranges > 1 else []
    edges = [e for e in edges if first is not None and e > tuple(first)]
    # An edge's document also ends the range before; the first of all ends the last range.
    ends = {e: k for k, e in enumerate(edges)} | ({tuple(first): len(edges)} if first is not None else {})
    sent = spark.sparkContext.broadcast((edges, ends, lexicon(docs, n_docs, rarest, commonest)))
    dealt_kind = T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_end", T.BooleanType()), T.StructField("_none", T.BooleanType()), T.StructField("doc_id", id_field.dataType), T.StructField("_h", T.LongType()), T.StructField("text", T.BinaryType())])

    def deal(batches):
        edges, ends, _ = sent.value
        waiting = dict(ends)  # equal rows end a range once a task
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("_none", "doc_id", "_h")), strict=True))
            own = pa.array([bisect_right(edges, p) for p in places], pa.int32())
            columns = [batch.column(c) for c in ("_none", "doc_id", "_h", "text")]
            yield pa.RecordBatch.from_arrays([own, pa.array([False] * len(places)), *columns], dealt_kind.names)
            more = [(k, waiting.pop(p)) for k, p in enumerate(places) if p in waiting]
            if more:
                at = pa.array([k for k, _ in more])
                yield pa.RecordBatch.from_arrays([pa.array([r for _, r in more], pa.int32()), pa.array([True] * len(more)), *(c.take(at) for c in columns)], dealt_kind.names)

    kind = T.StructType([id_field]).add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")

    def compare(batches):
        words, known = sent.value[2], _Hashes()
        id_type = None

        def results(group):
            """group: documents that follow each other, the last one as a following one alone."""
            texts = [t for _, t in group]
            changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:], strict=False)]
            own, new = fingerprints([t.encode() for t in texts], words, known), fingerprints(changed, words, known)
            columns = [pa.array([i for i, _ in group[:-1]], id_type), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in changed]), pa.array(own[:-1]), pa.array(new)]
            columns += [pa.array([likeness(a, b) for a, b in zip(own, new, strict=False)]), pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)])]
            return pa.RecordBatch.from_arrays(columns, kind.names)

        group, held, now, ended = [], 0, None, False
        for batch in batches:
            id_type = batch.column("doc_id").type
            for r, end, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_range", "_end", "doc_id", "text")), strict=True):
                if r != now:
                    group, held, now, ended = [], 0, r, False
                if ended:
                    continue  # one more copy of the row that ends this range
                group.append((doc_id, text.decode()))
                held += len(text)
                ended = end
                if len(group) > 1 and (end or held > 4 << 20):
                    yield results(group)
                    group, held = group[-1:], len(text)

    ready = small_batches(keyed.withColumn("text", F.col("text").cast("binary"))).mapInArrow(deal, dealt_kind)
    return ready.repartitionById(len(edges) + 1, "_range").sortWithinPartitions("_range", "_end", "_none", "doc_id", "_h").mapInArrow(compare, kind)


def op13_imatch(spark, sf_dir):
    return fingerprint_edits(table(spark, sf_dir, "documents"))
