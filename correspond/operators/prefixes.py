"""Strings matched by one being the beginning of the other: in sorted order, what a string begins is an interval."""

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sampled ids from which the edge of a range is chosen.
SAMPLED = 32


def _edges(ids: DataFrame, ranges: int) -> list[str]:
    """Ids that cut the sorted ids into `ranges` parts of about the same size, by the ids of the smallest hashes."""
    some = sorted(r.key for r in ids.where("key is not null").orderBy(F.xxhash64("key"), "key").limit(ranges * SAMPLED).select("key").collect())
    return sorted(set(some[SAMPLED::SAMPLED]))


def best_beginnings(asked: DataFrame, ids: DataFrame) -> DataFrame:
    """asked(key), ids(key, best) -> (key, best): of all ids that begin with an asked key, or that it begins with, the smallest best, a struct of (account_rank, seq, mail_id).

    Both sides are dealt to ranges of sorted ids and merged in order, with a stack of the strings that
    begin the current one, so neither lengths nor common beginnings cost anything. A string that begins the id at a range's
    edge is sent there as well; there are no more of these than ranges times an id's length.
    """
    spark = asked.sparkSession
    edges = _edges(ids, int(spark.conf.get("spark.sql.shuffle.partitions")))
    reach: dict[str, list[int]] = {}
    for k, e in enumerate(edges):
        for n in range(len(e)):
            reach.setdefault(e[:n], []).append(k + 1)
    sent = spark.sparkContext.broadcast((edges, reach))
    kinds = {f.name: f.dataType.simpleString() for f in ids.schema["best"].dataType}
    names = ["_range", "key", "asked", *kinds]

    def deal(batches):
        edges, reach = sent.value
        for batch in batches:
            keys = batch.column("key").to_pylist()
            own = [bisect_right(edges, k) for k in keys]
            again = [(n, r) for n, k in enumerate(keys) for r in reach.get(k, ()) if r > own[n]]
            at = pa.array([*range(len(keys)), *(n for n, _ in again)], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([*own, *(r for _, r in again)], pa.int32()), *(batch.column(c).take(at) for c in names[1:])], names)

    def merge(batches):
        stack: list[list] = []  # key, asked, best of its own, best of what it begins, best of what begins it
        found: list[tuple] = []
        now = None
        least = lambda *of: min((x for x in of if x is not None), default=None)

        def leave():
            key, is_asked, own, below, above = stack.pop()
            if is_asked and (best := least(own, below, above)) is not None:
                found.append((key, *best))
            if stack:
                stack[-1][3] = least(stack[-1][3], own, below)

        def out():
            rows = list(zip(*found, strict=True)) or [()] * (1 + len(kinds))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["key", *kinds])

        types = None
        for batch in batches:
            types = [batch.schema.field(c).type for c in ("key", *kinds)]
            for r, key, is_asked, *best in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                while stack and (r != now or not key.startswith(stack[-1][0])):
                    leave()
                now = r
                if not stack or stack[-1][0] != key:
                    stack.append([key, False, None, None, least(*stack[-1][2::2]) if stack else None])
                if is_asked:
                    stack[-1][1] = True
                else:
                    stack[-1][2] = least(stack[-1][2], tuple(best))
            yield out()
        while stack:
            leave()
        if found:
            yield out()

    sides = asked.select("key", F.lit(True).alias("asked"), *(F.lit(None).cast(t).alias(c) for c, t in kinds.items())).unionByName(ids.select("key", F.lit(False).alias("asked"), "best.*"))
    columns = ", ".join(f"{c} {t}" for c, t in kinds.items())
    dealt = sides.where("key is not null").mapInArrow(deal, f"_range int, key string, asked boolean, {columns}")
    met = dealt.repartitionById(len(edges) + 1, "_range").sortWithinPartitions("_range", "key").mapInArrow(merge, f"key string, {columns}")
    return met.groupBy("key").agg(F.min(F.struct(*kinds)).alias("best"))
