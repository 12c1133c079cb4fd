"""Exact nearest vectors by cosine: vectors lie in cells around centres, and cells that are too far away are left out."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from correspond.operators.tables import written

#: Cells, vectors that their centres are fitted on, and turns of fitting.
CELLS, SAMPLE, FITTING = 128, 8192, 6
#: Vectors of a block, of which one row has some, and queries that meet it at once.
BLOCK, QUERIES = 2048, 256
#: What rounding may take from or add to a distance.
_SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length, normalised; a zero vector stays one."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit_centres(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> np.ndarray:
    """Centres of `cells` cells at most, from `sample` vectors by hash: they decide what a search costs, never what it finds."""
    some = vectors.select("embedding").where("size(embedding) > 0").orderBy(F.xxhash64("embedding")).limit(sample).toArrow().column(0).combine_chunks()
    if not len(some):
        return np.zeros((1, 1))
    x = _matrix(some.chunk(0) if isinstance(some, pa.ChunkedArray) else some)
    x = x[np.abs(x).sum(axis=1) > 0]
    if not len(x):
        return np.zeros((1, 1))
    centres = x[:: max(1, len(x) // min(cells, max(1, int(len(x) ** 0.5))))][:cells]
    for _ in range(FITTING):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return np.unique(centres, axis=0)


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


def index(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors(id, embedding) -> blocks (cell, n, near, far, ids, x): vectors of one cell with their smallest and largest distance from its centre. Vectors of no length are in cell -1; null and empty ones in none."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)
    names = ["cell", "n", "near", "far", "ids", "x"]

    def blocks(held):
        ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        zero = np.abs(x).sum(axis=1) == 0
        cosine = np.zeros((len(x), 1)) if zero.all() else x @ sent.value.T
        cell, d = np.where(zero, -1, cosine.argmax(axis=1)), _distance(cosine.max(axis=1))
        order = np.lexsort((ids, cell))
        edges = np.flatnonzero(np.diff(cell[order])) + 1
        rows = []
        for a, b in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(order)])), strict=True):
            for k in range(a, b, BLOCK):
                at = order[k : min(b, k + BLOCK)]
                rows.append((int(cell[at[0]]), len(at), float(d[at].min()), float(d[at].max()), ids[at].tolist(), x[at].tobytes()))
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def of(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))))
                size += batch.num_rows
            if size >= 32 * BLOCK:
                yield blocks(held)
                held, size = [], 0
        if held:
            yield blocks(held)

    return vectors.select("id", "embedding").where("size(embedding) > 0").mapInArrow(of, "cell int, n long, near double, far double, ids array<long>, x binary")


def _asked(queries: DataFrame, centres: np.ndarray, cells: list[tuple], k: int) -> DataFrame:
    """queries(query_id, embedding) -> (cell, ids, q): up to QUERIES queries that must look into a cell.

    The k-th nearest vector is no farther than the largest distance in the cells that are nearest by their far sides and hold k vectors; a
    cell whose near side is farther holds none of the k. A query of no length is as near to all, and looks into all.
    """
    sent = queries.sparkSession.sparkContext.broadcast((centres, cells))

    def of(batches):
        centres, cells = sent.value
        number, n, near, far = (np.array(c) for c in zip(*cells, strict=True))
        real = number >= 0
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                ids, q = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1))
                d = np.full((len(q), len(number)), np.sqrt(2.0))  # a vector of no length has a cosine of 0
                if real.any():
                    d[:, real] = _distance(q @ centres[number[real]].T)
                upper, lower = d + np.where(real, far, 0.0), np.maximum(0.0, np.maximum(d - np.where(real, far, 0.0), np.where(real, near, 0.0) - d))
                order = upper.argsort(axis=1)
                enough = (n[order].cumsum(axis=1) >= k).argmax(axis=1)
                limit = np.where(n.sum() >= k, np.take_along_axis(upper, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0], np.inf)
                limit = np.where(np.abs(q).sum(axis=1) == 0, np.inf, limit)
                wanted = lower <= limit[:, None] + _SLACK
                rows = [(int(number[c]), ids[wanted[:, c]].tolist(), q[wanted[:, c]].tobytes()) for c in np.flatnonzero(wanted.any(axis=0))]
                kinds = [pa.int32(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["cell", "asked", "q"])

    return queries.select("query_id", "embedding").where("size(embedding) > 0").mapInArrow(of, "cell int, asked array<long>, q binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 30, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """vectors(id, embedding), queries(query_id, embedding) -> (query_id, id, similarity, rank) of each query's k nearest by cosine, ties by id; and (compared, pairs), the pairs that were compared of all.

    Exact: cells are left out by the triangle inequality alone. Queries and vectors stay distributed; the driver has the centres and one row a cell.
    """
    spark = vectors.sparkSession
    centres = fit_centres(vectors, cells)
    blocks = written(index(vectors, centres), "vectors")
    sums = [tuple(r) for r in blocks.groupBy("cell").agg(F.sum("n"), F.min("near"), F.max("far")).collect()]
    kind = "query_id long, id long, similarity double"
    if not sums:
        return spark.createDataFrame([], f"{kind}, rank int"), spark.createDataFrame([(0, 0)], "compared long, pairs long")
    met = written(_asked(queries, centres, sums, k), "asked").join(blocks, "cell")

    def compare(batches):
        for batch in batches:
            for asked, q, ids, x in zip(*(batch.column(c) for c in ("asked", "q", "ids", "x")), strict=True):
                names, own = asked.values.to_numpy(), ids.values.to_numpy()
                s = np.round(np.frombuffer(q.as_py()).reshape(len(names), -1) @ np.frombuffer(x.as_py()).reshape(len(own), -1).T, 12)
                order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, order.shape[1])), pa.array(own[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], ["query_id", "id", "similarity"])

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    found = met.select("asked", "q", "ids", "x").mapInArrow(compare, kind).withColumn("rank", place).where(F.col("rank") <= k)
    counts = queries.where("size(embedding) > 0").agg(F.lit(0).cast("long").alias("compared"), (F.count("*") * sum(r[1] for r in sums)).alias("pairs"))
    work = met.agg(F.sum(F.size("asked") * F.col("n")).alias("compared"), F.lit(0).cast("long").alias("pairs"))
    return found, counts.unionByName(work).agg(F.sum("compared").alias("compared"), F.sum("pairs").alias("pairs"))
