"""Ranked lexical search with range-maximum tables over posting lists."""

import heapq
import math
from bisect import insort
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from correspond.llm.common import materialise, small_batches, table
from correspond.llm.words import word_blocks

#: Different terms of the queries that one index takes in (a dictionary of some 25 MB in each worker); for more, texts are scanned again.
BLOCK_TERMS = 200_000
#: Postings and documents of a shard. A table of 500,000 postings takes some 30 MB while it is searched.
SHARD_POSTINGS, SHARD_DOCUMENTS = 500_000, 65_535
#: Documents of an interval that is scored whole instead of being split.
LEAF = 128


def terms_of(text: str | bytes | None) -> list[bytes]:
    text = text.encode() if isinstance(text, str) else text
    return [w for words, *_ in word_blocks([text]) for w in words]


def index_shards(docs: DataFrame, number: dict[bytes, int], postings: int = SHARD_POSTINGS) -> DataFrame:
    """docs(doc_id, text) -> shards of an index of the terms in `number`, rows of (n_docs, n_terms, ids, sizes, ranks, terms, counts, docs, tfs).

    n_docs and n_terms count the documents that have a term of any kind, and their terms.
    ids, sizes and ranks (order by id, null ids last) are of the documents with an indexed term;
    counts are the lengths of the posting lists of terms; docs (places in ids) and tfs follow each other list by list.
    """
    sent = docs.sparkSession.sparkContext.broadcast(number)
    kind = T.StructType().add("n_docs", "long").add("n_terms", "long").add("ids", T.ArrayType(docs.schema["doc_id"].dataType)).add("sizes", T.ArrayType(T.IntegerType())).add("ranks", T.ArrayType(T.IntegerType()))
    kind = kind.add("terms", T.ArrayType(T.IntegerType())).add("counts", T.ArrayType(T.IntegerType())).add("docs", "binary").add("tfs", "binary")

    def shard(n_docs, n_terms, ids, sizes, rows, nums, tfs, id_type):
        n, none = len(ids), np.zeros(0, np.int64)
        key, at = np.unique(np.concatenate([*nums, none]) * n + np.concatenate([*rows, none]), return_inverse=True)
        tf = np.bincount(at, weights=np.concatenate([*tfs, none]), minlength=len(key)).astype(np.int64)
        term, doc = np.divmod(key, max(1, n))
        # Documents of like vocabulary side by side make intervals with tight bounds: by their three most frequent terms, then by id.
        by_tf = np.lexsort((term, -tf, doc))
        nth = np.arange(len(key)) - np.searchsorted(doc[by_tf], doc[by_tf])
        lead = np.full((3, n), -1)
        lead[nth[nth < 3], doc[by_tf][nth < 3]] = term[by_tf][nth < 3]
        rank = np.empty(n, np.int64)
        rank[sorted(range(n), key=lambda k: (ids[k] is None, ids[k]))] = np.arange(n)
        order = np.lexsort((rank, *lead[::-1]))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        doc = place[doc]
        lists = np.lexsort((doc, term))
        terms, counts = np.unique(term, return_counts=True)
        columns = [pa.array([n_docs]), pa.array([n_terms]), pa.array([[ids[k] for k in order]], pa.list_(id_type)), pa.array([[sizes[k] for k in order]], pa.list_(pa.int32())), pa.array([rank[order].tolist()], pa.list_(pa.int32()))]
        columns += [pa.array([terms.tolist()], pa.list_(pa.int32())), pa.array([counts.tolist()], pa.list_(pa.int32())), pa.array([doc[lists].astype(np.uint16).tobytes()]), pa.array([tf[lists].astype(np.uint32).tobytes()])]
        return pa.RecordBatch.from_arrays(columns, kind.names)

    def build(batches):
        find = sent.value.get
        n_docs = n_terms = held = 0
        ids, sizes, rows, nums, tfs, id_type = [], [], [], [], [], pa.null()
        for batch in batches:
            id_type = batch.column(0).type
            size, found = np.zeros(batch.num_rows, np.int64), []
            for words, piece, row, _ in word_blocks(batch.column(1).to_pylist()):
                size += np.bincount(row[piece], minlength=batch.num_rows)
                num = np.fromiter(map(find, words, repeat(-1)), np.int64, len(words))
                known = num >= 0
                key, tf = np.unique(row[piece[known]] * (len(sent.value) + 1) + num[known], return_counts=True)
                found.append((key // (len(sent.value) + 1), key % (len(sent.value) + 1), tf))
            n_docs += int((size > 0).sum())
            n_terms += int(size.sum())
            with_any = np.unique(np.concatenate([f[0] for f in found])) if found else np.zeros(0, np.int64)
            own = batch.column(0).to_pylist()
            for k in range(0, len(with_any), SHARD_DOCUMENTS):  # a batch of any size keeps to a shard's documents
                part = with_any[k : k + SHARD_DOCUMENTS]
                if ids and (held >= postings or len(ids) + len(part) > SHARD_DOCUMENTS):
                    yield shard(n_docs, n_terms, ids, sizes, rows, nums, tfs, id_type)
                    n_docs = n_terms = held = 0
                    ids, sizes, rows, nums, tfs = [], [], [], [], []
                for r, num, tf in found:
                    inside = (r >= part[0]) & (r <= part[-1])
                    rows.append(np.searchsorted(part, r[inside]) + len(ids))
                    nums.append(num[inside])
                    tfs.append(tf[inside])
                    held += int(inside.sum())
                ids += [own[i] for i in part.tolist()]
                sizes += size[part].tolist()
        if n_docs or ids:
            yield shard(n_docs, n_terms, ids, sizes, rows, nums, tfs, id_type)

    return small_batches(docs.select("doc_id", F.col("text").cast("binary"))).mapInArrow(build, kind)


class Shard:
    """Posting lists of one shard with a sparse table that gives the place of the highest impact in any run of a list."""

    def __init__(self, ids: list, sizes: np.ndarray, ranks: np.ndarray, terms: np.ndarray, counts: np.ndarray, docs: bytes, tfs: bytes, n_docs: int, n_terms: int):
        self.ids, self.terms, self.ends = ids, terms, np.cumsum(counts)
        self.starts = self.ends - counts
        self.docs = np.frombuffer(docs, np.uint16).astype(np.int64)
        tf, m = np.frombuffer(tfs, np.uint32).astype(np.int64), 25 + 75 * sizes.astype(np.int64) * n_docs // max(1, n_terms)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs])
        self.width = len(ids) + 1
        self.key = np.repeat(np.arange(len(terms)), counts) * self.width + self.docs
        self.best = [np.arange(len(self.docs), dtype=np.int32)]
        for level in range(1, int(counts.max(initial=1)).bit_length()):
            left, right = self.best[-1][: -(1 << level - 1)], self.best[-1][1 << level - 1 :]
            self.best.append(np.where(self.impact[left] >= self.impact[right], left, right))
        self.by_rank = np.argsort(ranks)
        self.first = [ranks]
        for level in range(1, len(ids).bit_length()):
            self.first.append(np.minimum(self.first[-1][: -(1 << level - 1)], self.first[-1][1 << level - 1 :]))

    def smallest_id(self, lo: int, hi: int):
        """Of the documents lo to hi."""
        level = (hi - lo).bit_length() - 1
        return self.ids[self.by_rank[min(self.first[level][lo], self.first[level][hi - (1 << level)])]]

    def highest(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Place of the first highest impact of each run [i, j), not empty, inside a list."""
        level = np.frexp((j - i).astype(np.float64))[1] - 1
        out = i.copy()
        for n in np.unique(level[level > 0]).tolist():
            at = np.flatnonzero(level == n)
            left, right = self.best[n][i[at]], self.best[n][j[at] - (1 << n)]
            out[at] = np.where(self.impact[left] >= self.impact[right], left, right)
        return out

    def search(self, terms: np.ndarray, weight: np.ndarray, best: list[tuple], k: int) -> int:
        """Puts this shard's documents of positive score into `best`, the k highest (-score, null id, id) so far. terms (numbers in order, each once) with their weights. Returns the intervals looked at."""
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms) & (weight > 0) if len(self.terms) else np.zeros(len(terms), bool)
        at, weight = at[here], weight[here]
        if not len(at):
            return 0

        def offer(score: int, d: int) -> None:
            entry = (-score, self.ids[d] is None, self.ids[d])
            if score > 0 and (len(best) < k or entry < best[-1]):
                insort(best, entry)
                del best[k:]

        def hopeless(bound: int, lo: int, hi: int) -> bool:
            if bound <= 0 or len(best) < k or bound != -best[-1][0]:
                return bound <= 0 or len(best) == k and bound < -best[-1][0]
            first = self.smallest_id(lo, hi)
            return (first is None, first) > best[-1][1:]

        i, j = self.starts[at], self.ends[at]
        top = self.highest(i, j)
        queue = [(-int((weight * self.impact[top]).sum()), 0, len(self.ids), i, j, top, weight, at * self.width)]
        steps = 0
        while queue and not (len(best) == k and queue[0][0] > best[-1][0]):
            bound, lo, hi, i, j, top, weight, base = heapq.heappop(queue)
            if hopeless(-bound, lo, hi):
                continue
            steps += 1
            if hi - lo <= LEAF:
                n = j - i
                at = np.repeat(i - np.cumsum(n) + n, n) + np.arange(n.sum())
                sums = np.zeros(hi - lo, np.int64)
                np.add.at(sums, self.docs[at] - lo, np.repeat(weight, n) * self.impact[at])
                for d in np.flatnonzero(sums > (-best[-1][0] - 1 if len(best) == k else 0)).tolist():
                    offer(int(sums[d]), lo + d)
                continue
            d = int(self.docs[top[int((weight * self.impact[top]).argmax())]])
            p = np.searchsorted(self.key, base + d)
            at_d = np.minimum(p, len(self.docs) - 1)
            found = (p < j) & (self.docs[at_d] == d)
            offer(int((weight * self.impact[at_d])[found].sum()), d)
            # Runs of both halves at once, without terms that have none; postings of d are in neither.
            i, j, weight, base = np.concatenate((i, p + found)), np.concatenate((p, j)), np.concatenate((weight, weight)), np.concatenate((base, base))
            left, kept = len(p), i < j
            i, j, weight, base, left = i[kept], j[kept], weight[kept], base[kept], int(kept[:left].sum())
            top = self.highest(i, j)
            gain = weight * self.impact[top]
            for a, b, s in ((lo, d, slice(0, left)), (d + 1, hi, slice(left, None))):
                if a < b and not hopeless(most := int(gain[s].sum()), a, b):
                    heapq.heappush(queue, (-most, a, b, i[s], j[s], top[s], weight[s], base[s]))
        return steps


def _blocks(queries: DataFrame, most: int):
    """Lists of (row, item, terms) with `most` different terms together, or one item; the driver holds one list at a time."""
    block, seen = [], set()
    for row, (item, text) in enumerate(queries.select("item_id", "text").toLocalIterator()):
        terms = terms_of(text)
        if block and len(seen.union(terms)) > most:
            yield block
            block, seen = [], set()
        block.append((row, item, terms))
        seen.update(terms)
    yield block


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS, postings: int = SHARD_POSTINGS) -> DataFrame:
    """docs(doc_id, text), queries(item_id, text) -> (item_id, rank, doc_id, score): each query's k highest documents with a positive score.

    An index of the queries' terms is written in shards of documents, each with the
    statistics that all shards' sums complete. In a shard, a query begins with the interval of all
    documents. The interval of the highest bound (the sum over terms of the highest
    impact in it, by range-maximum tables) is split at the document of the highest single impact, which
    is scored; intervals whose bound can't reach the k-th score are left. A task
    carries the k best from one shard to the next; the best of all tasks are merged.

    Every row of docs is a document, repeated ids too, and every row of queries a query
    of its own, so repeated queries give their rows as often. Equal scores go by ascending doc_id, null ids
    last. Null and empty texts have no term and are never found, and find nothing; texts of any length are read whole; an empty table gives
    none; other columns are not read. Queries of more terms than block_terms are taken in blocks, a scan and an index each.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    kind = T.StructType().add("row", "long").add("item_id", queries.schema["item_id"].dataType).add("doc_id", docs.schema["doc_id"].dataType).add("score", "long")
    types = [to_arrow_type(f.dataType) for f in kind]
    found = None
    for block in _blocks(queries, block_terms):
        number = {t: n for n, t in enumerate(sorted({t for _, _, terms in block for t in terms}))}
        if not number:
            continue
        shards = materialise(index_shards(docs, number, postings), "shards")
        n_shards, n_docs, n_terms = shards.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        df = np.zeros(len(number), np.int64)
        for r in shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("n")).collect():
            df[r.terms] = r.n
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        asked = []
        for row, item, terms in block:
            nums, times = np.unique(np.array([number[t] for t in terms], np.int64), return_counts=True)
            asked.append((row, item, nums, times * weight[nums]))
        sent = sc.broadcast((asked, n_docs, n_terms))

        def search(batches, sent=sent):
            asked, n_docs, n_terms = sent.value
            best = [[] for _ in asked]
            for batch in batches:
                for r in range(batch.num_rows):
                    ids, sizes, ranks, terms, counts, own, tfs = (batch.column(c)[r] for c in ("ids", "sizes", "ranks", "terms", "counts", "docs", "tfs"))
                    if len(terms.values):
                        shard = Shard(ids.as_py(), sizes.values.to_numpy(), ranks.values.to_numpy(), terms.values.to_numpy(), counts.values.to_numpy().astype(np.int64), own.as_py(), tfs.as_py(), n_docs, n_terms)
                        for (_, _, nums, w), b in zip(asked, best, strict=True):
                            shard.search(nums, w, b, k)
            rows = [(row, item, doc, -score) for (row, item, _, _), b in zip(asked, best, strict=True) for score, _, doc in b]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], kind.names)

        tasks = max(1, min(n_shards, sc.defaultParallelism), n_shards // 4)
        got = shards.repartition(tasks).select("ids", "sizes", "ranks", "terms", "counts", "docs", "tfs").mapInArrow(search, kind)
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = spark.createDataFrame([], kind)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_search(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
