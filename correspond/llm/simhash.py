"""SimHash near-duplicates by tiled exact comparison."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from correspond.llm.common import small_batches, table
from correspond.llm.similar import similar_texts, sketches, with_keys
from correspond.operators.graph import components
from correspond.operators.tables import Scratch

#: Fingerprints in a tile: 2048 x 2048 words of 8 bytes are compared in strips of a few MB.
TILE = 2048


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, repeats counted; no word: zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed=42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    digest, first, last = xxhash.xxh64_intdigest, starts[:n].tolist(), ends[width - 1 :].tolist()
    for k in range(0, n, 1 << 16):  # strips, so that a very long text needs little memory
        h = np.fromiter((digest(joined[i:j], seed=42) for i, j in zip(first[k : k + (1 << 16)], last[k : k + (1 << 16)], strict=True)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp long): the fingerprint's 64 bits as a signed number. Null text counts as empty."""

    def of(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return small_batches(docs.select("doc_id", F.col("text").cast("binary"))).mapInArrow(of, kind)


def _forest(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """Spanning links of the graph of close pairs between two tiles: the same components as all pairs, in fewer rows than fingerprints."""
    n = len(left)
    parent = list(range(n + (0 if same else len(right))))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for k in range(0, n, 256):
        close = np.bitwise_count(left[k : k + 256, None] ^ right[None, :]) <= radius
        if same:
            close &= np.arange(len(right))[None, :] > np.arange(k, min(n, k + 256))[:, None]
        for i in np.flatnonzero(close.any(axis=1)):
            for j in np.flatnonzero(close[i]):
                p, q = root(int(i) + k), root(int(j) + (0 if same else n))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    links.append((int(left[i + k]), int(right[j])))
    return links


def close_links(distinct: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """distinct(fp) -> (a, b): links that connect exactly those fingerprints that are connected by pairs of `radius` differing bits or fewer.

    Cut into radius + 1 parts, two fingerprints so close have a part in common. Each
    goes once to each of its parts, and those that share one are a tile, compared by
    exclusive-or and bit counts. A part that more than `tile` fingerprints share is
    cut into tiles by population count (and by a hash, where one count has too many);
    tile pairs whose counts differ beyond the radius are skipped without loss, and
    the others spread over all tasks.
    """
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    part = lambda k: F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << edges[k + 1] - edges[k]) - 1 if radius else -1))
    rows = distinct.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(k), part(k)) for k in range(radius + 1)))).alias("g"))
    n = distinct.count() * (radius + 1)
    shared = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(shared, "g").select("g", "n", "fp")

    def small(batches):
        held = list(batches)
        if held:
            g, fp = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("g", "fp"))
            order = np.lexsort((fp, g))
            yield _linked(_run_links(fp[order].view(np.uint64), g[order], radius))

    # A tile is never cut by a partition's edge, and no partition holds much more than its share, as tiles are small.
    found = rows.where(F.col("n") <= tile).select("g", "fp").repartition(max(8, -(-n // 200_000)), "g").mapInArrow(small, "a long, b long")
    return found.unionByName(_tiled(rows.where(F.col("n") > tile), radius, tile))


def _linked(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    found = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def _run_links(fp: np.ndarray, group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Close pairs inside the runs of equal `group`: in short runs each fingerprint is compared with those a few places on, long ones are a tile each."""
    edges = np.flatnonzero(np.diff(group)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(group)]))
    many, links = ends - starts > 32, []
    for k in np.flatnonzero(many):
        links += _forest(fp[starts[k] : ends[k]], fp[starts[k] : ends[k]], True, radius)
    inside = np.repeat(~many, ends - starts)
    f, g = fp[inside], group[inside]
    for d in range(1, min(32, len(f))):
        same = g[d:] == g[:-d]
        if not same.any():
            break
        at = np.flatnonzero(same & (np.bitwise_count(f[d:] ^ f[:-d]) <= radius))
        links += zip(f[at].tolist(), f[at + d].tolist(), strict=True)
    return links


def _tiled(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """rows(g, fp) of parts that many share -> links within each g, by pairs of tiles of near population counts."""
    keyed = rows.select("g", "fp", F.bit_count("fp").cast("int").alias("ones"))
    tiles = keyed.groupBy("g", "ones").agg(F.ceil(F.count("*") / tile).cast("int").alias("cuts"))
    other = tiles.select("g", F.col("ones").alias("ones2"), F.col("cuts").alias("cuts2"))
    pairs = (
        tiles.select("g", "ones", "cuts", F.explode(F.sequence("ones", F.col("ones") + radius)).alias("ones2")).join(other, ["g", "ones2"])
        .select("g", "ones", "ones2", "cuts2", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
        .select("g", "ones", "ones2", "cut", F.explode(F.sequence(F.lit(0), F.col("cuts2") - 1)).alias("cut2"))
        .where("ones2 > ones or cut2 >= cut")
    )
    side = lambda ones, cut, k: F.struct(F.col(ones).alias("ones"), F.col(cut).alias("cut"), F.lit(k).alias("side"))
    same = (F.col("ones") == F.col("ones2")) & (F.col("cut") == F.col("cut2"))
    sides = pairs.select("g", F.explode(F.when(same, F.array(side("ones", "cut", 0))).otherwise(F.array(side("ones", "cut", 0), side("ones2", "cut2", 1)))).alias("s"), F.struct("g", "ones", "cut", "ones2", "cut2").alias("pair"), same.alias("same"))
    cut = keyed.join(tiles, ["g", "ones"]).select("g", "fp", "ones", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int").alias("cut"))

    def compare(pdf):
        import pandas as pd

        alone = bool(pdf["same"].iloc[0])
        fp, side = pdf["fp"].to_numpy().view(np.uint64), pdf["side"].to_numpy()
        left = fp if alone else fp[side == 0]
        found = np.array(_forest(left, left if alone else fp[side == 1], alone, radius), np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    met = cut.join(sides.select("g", "s.ones", "s.cut", "s.side", "pair", "same"), ["g", "ones", "cut"]).select("pair", "same", "side", "fp")
    return met.groupBy("pair").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fingerprint, component_id), a row for each row of docs.

    component_id is the smallest doc_id that links of `radius` differing bits or
    fewer reach, the document's own included. Copies share a fingerprint and are
    never paired. Null and empty texts, and texts of white space, have
    fingerprint zero and are linked like any other; texts of any length are read
    whole; an empty table gives no rows; repeated rows stay, each with the same class;
    a null doc_id is never a class id unless the class has no other; other columns are not read.
    """
    t = Scratch(docs.sparkSession, "simhash")
    fps = t.written(fingerprints(docs, width), "fingerprints")
    first = t.written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    links = close_links(first.select("fp"), radius)
    linked = components(links.select(F.col("a").alias("source"), F.col("b").alias("target")))
    named = first.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = named.join(smallest, "component").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_classes(docs: DataFrame, radius: int = 3) -> DataFrame:
    """docs(text, ...) -> all columns and _key, a number for each different text, and _class, the smallest key of its group, a row for each row of docs.

    Groups are chains of texts that share four fifths of their five-word shingles or
    more. Fingerprints of `radius` differing bits or fewer are the candidates that are
    compared first. No radius that tiles can carry finds all such pairs (they lie up to
    some 16 bits apart), so an exact set join completes them; see similar_texts. A null
    text counts as empty; equal texts share a key, whatever their rows' other columns.
    """
    t = Scratch(docs.sparkSession, "classes")
    keyed = with_keys(docs)
    known = t.written(sketches(keyed), "sketches")
    fps = known.select("_key", "fp")
    first = t.written(fps.groupBy("fp").agg(F.min("_key").alias("_key")), "distinct")
    to = lambda c, k: first.select(F.col("fp").alias(c), F.col("_key").alias(k))
    close = close_links(first.select("fp"), radius).withColumnsRenamed({"a": "x", "b": "y"}).join(to("x", "a"), "x").join(to("y", "b"), "y").select("a", "b")
    equal = fps.join(first.withColumnRenamed("_key", "a"), "fp").where("a <> _key").select("a", F.col("_key").alias("b"))
    candidates = t.written(close.unionByName(equal), "candidates")
    groups = similar_texts(keyed.select("_key", "text"), known, candidates)
    t.keep()
    return keyed.join(groups.select(F.col("node").alias("_key"), F.col("component").alias("_class")), "_key", "left").withColumn("_class", F.coalesce("_class", "_key"))


def op6_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
