"""Benchmark decontamination with an Aho-Corasick automaton."""

import hashlib
from collections import defaultdict
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from correspond.llm.common import materialise, small_batches, table

#: Words of all windows that one automaton takes in, two or three nodes of some 50 bytes each; for more, texts are scanned again.
BLOCK_WORDS = 2_000_000
#: Characters that a place of a word's number takes. A node's children are searched one by one, so they had better be few.
_BASE = 128
#: ASCII letters are lower-cased, digits stay, all other ASCII separates words; bytes of other characters are parts of words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _automaton(block: list[tuple[str, list[bytes]]], window: int) -> dict:
    """Of windows as strings, each word by its number in `width` characters, which differ by place, so that matches begin and end with words; value: (words, indexes of pieces)."""
    number: dict[bytes, int] = {}
    for _, words in block:
        for w in words:
            number.setdefault(w, len(number))
    width = 1 if len(number) <= _BASE else 2 if len(number) <= _BASE**2 else 3 if len(number) <= _BASE**3 else 4
    code = {w: "".join(chr(1 + _BASE * i + n // _BASE**i % _BASE) for i in range(width)) for w, n in number.items()}
    windows = defaultdict(set)
    for k, (_, words) in enumerate(block):
        line = "".join(map(code.__getitem__, words))
        for i in range(max(1, len(words) - window + 1)):
            windows[line[i * width : (i + window) * width]].add(k)
    found = ahocorasick.Automaton()
    for part, owners in windows.items():
        found.add_word(part, (len(part) // width, tuple(sorted(owners))))
    found.make_automaton()
    return {"code": code, "find": found, "width": width}


def _built(held: dict, window: int) -> dict | None:
    """The automaton of a broadcast block, kept with it, so that a worker's later tasks find it built; None of an empty block."""
    if "built" not in held:
        held["built"] = _automaton(held["block"], window) if held["block"] else None
    return held["built"]


def scan(text: bytes | None, built: dict | None) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Words; merged runs of hit words (first, end); indexes of pieces."""
    words = (text or b"").translate(FOLD).split()
    if not words or not built:
        return len(words), [], set()
    hits, owners, width = [], set(), built["width"]
    for end, (n, own) in built["find"].iter("".join(map(built["code"].get, words, repeat("\0" * width)))):
        owners.update(own)
        high = (end + 1) // width
        low = high - n
        while hits and hits[-1][1] >= low:
            a, b = hits.pop()
            low, high = min(a, low), max(b, high)
        hits.append((low, high))
    return len(words), hits, owners


def original_spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code-point spans of the original text."""
    raw = text.encode()
    codes = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], codes, [False])).astype(np.int8)))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))  # characters before a byte
    return [(int(chars[edges[2 * a]]), int(chars[edges[2 * b - 1]])) for a, b in hits]


def _blocks(benchmark: DataFrame, limit: int, window: int):
    """Lists of (item_id as string, words) whose windows have no more than `limit` words together, or one window; the driver holds one list at a time. A long item is cut into pieces that overlap by all but one word of a window."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).where("item_id is not null").toLocalIterator()
    block, size, most = [], 0, max(1, limit // window)
    for item, text in rows:
        words = bytes(text or b"").translate(FOLD).split()
        for at in range(0, max(1, len(words) - window + 1) if words else 0, most):
            piece = words[at : at + most + window - 1]
            cost = window * max(1, len(piece) - window + 1)
            if block and size + cost > limit:
                yield block
                block, size = [], 0
            block.append((item, piece))
            size += cost
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text) -> columns `keep` (doc_id) and n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans lists the hit passages as `start:end` code points of the original text.
    The windows of a benchmark of block_words at most make one automaton, built once
    a worker; a larger benchmark is cut into blocks, one scan each, whose findings
    are put together. Null and empty texts have no words and no hit; texts of any
    length are scanned whole; items without words or id never match; equal items all
    count; repeated document rows stay rows of their own; an empty benchmark leaves
    every document clean; an empty table gives none; input columns of the result's names are replaced.
    """
    found_kind = T.StructType().add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean").add("spans", "string")
    keep = [c for c in keep or ["doc_id"] if c not in found_kind.names]
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    kind = T.StructType([*(rows.schema[c] for c in keep), *found_kind])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
    sc = docs.sparkSession.sparkContext
    blocks = _blocks(benchmark, block_words, window)
    first = next(blocks)
    second = next(blocks, None)

    def result(batch, found):
        """found: for each row (text bytes, words, runs, item ids)."""
        cols = [[], [], [], [], [], []]
        for text, n, hits, items in found:
            items = set(items)
            row = (n, sum(b - a for a, b in hits), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hits), ",".join(f"{a}:{b}" for a, b in original_spans(text.decode(), hits)) if hits else "")
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], kind.names)

    def texts(batch):
        return batch.column("text").cast(pa.binary()).to_pylist()

    if second is None:
        sent = sc.broadcast({"block": first})

        def once(batches):
            built, block = _built(sent.value, window), sent.value["block"]

            def found(batch):
                for text in texts(batch):
                    n, hits, owners = scan(text, built)
                    yield text, n, hits, [block[k][0] for k in owners]

            for batch in batches:
                for k in range(0, batch.num_rows, 1024):
                    part = batch.slice(k, 1024)
                    yield result(part, found(part))

        return small_batches(rows).mapInArrow(once, kind)

    # More than one block: (row, runs, items) of each scan, joined by row.
    keyed = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    queue, partial = [first, second], None
    while queue:
        sent = sc.broadcast({"block": queue.pop(0)})

        def one(batches, sent=sent):
            built, block = _built(sent.value, window), sent.value["block"]
            for batch in batches:
                found = [(row, *scan(text, built)[1:]) for row, text in zip(batch.column("_row").to_pylist(), texts(batch), strict=True)]
                found = [f for f in found if f[1]]
                lists = [[[a for a, _ in f[1]] for f in found], [[b for _, b in f[1]] for f in found], [[block[k][0] for k in sorted(f[2])] for f in found]]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), *(pa.array(x, pa.list_(t)) for x, t in zip(lists, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["_row", "lows", "highs", "items"])

        got = materialise(small_batches(keyed.select("_row", "text")).mapInArrow(one, "_row long, lows array<long>, highs array<long>, items array<string>"), "hits")
        partial = got if partial is None else partial.unionByName(got)
        if not queue and (more := next(blocks, None)) is not None:
            queue.append(more)
    merged = partial.groupBy("_row").agg(*(F.flatten(F.collect_list(c)).alias(f"_{c}") for c in ("lows", "highs", "items")))

    def join_up(batches):
        def found(batch):
            for text, lows, highs, items in zip(texts(batch), *(batch.column(f"_{c}").to_pylist() for c in ("lows", "highs", "items")), strict=True):
                hits = []
                for a, b in sorted(zip(lows or [], highs or [], strict=True)):
                    if hits and hits[-1][1] >= a:
                        hits[-1] = (hits[-1][0], max(hits[-1][1], b))
                    else:
                        hits.append((a, b))
                yield text, len((text or b"").translate(FOLD).split()), hits, items or []

        for batch in batches:
            yield result(batch, found(batch))

    return keyed.join(merged, "_row", "left").mapInArrow(join_up, kind)


def op9_decontaminate(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
