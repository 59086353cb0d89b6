"""Exact k nearest neighbours by Euclidean distance, in several ways that return the same rows.

All take ``queries`` (query_id, vector) and ``refs`` (ref_id, vector, is_fraud) and return ``query_id,
ref_id, d2, is_fraud, rank``: the ``k`` references of least (squared distance, ref_id) of each query.
Squared distances are added from the first dimension to the last in 64-bit floats, whatever the way.

More than ``BLOCK`` queries, other than in ``brute``, are first made one for each vector, and references (unless filed in an
index before) the ``k`` of least id for each: equal queries have the same neighbours, and a further copy of a reference is
never among them. Query ids are taken to be unique.

``scan``   up to ``BLOCK`` queries, which is counted, go to all tasks and references stay where they are. More of up to
           ``PRUNED`` dimensions are compared through boxes, as pairs of blocks and parts would grow with the square; of
           more dimensions, where boxes prune nothing, they are dealt into blocks and references into parts, and each task compares one block with one part. Either way
           only the best k of a query and task are shuffled on, and nothing grows in the driver.
``brute``  the same as a join in generated code, made twice: the k-th least of the least distances to groups of references
           bounds the k-th distance, and what lies within it reaches a ranking window, so no task sorts all its pairs.
``keyed``  scan, but only between vectors that agree on whether there is a last transaction and on
           three flags: others are at a squared distance of 1 or more. Queries whose k-th distance
           reaches 1 are scanned again in full. For the fourteen features. More than ``BLOCK`` queries take boxes, which
           are divided by the flags first, as these are spread widest.
``cells``  references filed in a bisecting tree of balls; a query meets its nearest leaves first, then only those
           that reach into its k-th distance. For stores that are searched again and again.
``boxes``  the same with boxes.
``auto``   the kind of the index, if there is one; else scan for up to ``BLOCK`` queries, boxes for more (they compare fewest pairs).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DIMENSIONS, NEIGHBOURS
from ..functions.kernels import squared_distance
from .selection import kept

#: Queries that may be sent to all tasks.
BLOCK = 4096
#: Groups of references for each neighbour, whose least distances bound the k-th one.
GROUPS = 8
#: Queries and references that one task compares, where there are more queries.
GRID_QUERIES, GRID_REFS = 16_384, 32_768
#: Dimensions up to which boxes prune.
PRUNED = 16
#: Partitions that pairs of blocks and parts are dealt to, at most; else two for each pair, so that few tasks have several.
MOST_PARTITIONS = 20_000
#: References compared with a block at a time.
BATCH = 1024
NEIGHBOUR_SCHEMA = "query_id {id}, ref_id long, d2 double, is_fraud boolean"
STRATEGIES = ("scan", "brute", "keyed", "cells", "boxes")


def best(pairs: DataFrame, k: int) -> DataFrame:
    """The k rows of least (d2, ref_id) of each query, ranked."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "ref_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "ref_id", "d2", "is_fraud", "rank")


def parts_of(n: int, size: int) -> int:
    return max(1, -(-n // size))


def dealt(rows: DataFrame, key: str, own: str, n: int, other: str, copies: int) -> DataFrame:
    """``rows`` dealt by their key into ``n`` numbers ``own``, each with every number of ``other``."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)).cast("array<bigint>"))
    return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(other, numbers)


def first_copies(refs: DataFrame, k: int) -> DataFrame:
    """Of the references of each vector the k of least id."""
    copy = F.row_number().over(Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("ref_id"))
    return refs.select("ref_id", "vector", "is_fraud", copy.alias("copy")).where(F.col("copy") <= k).drop("copy")


def once(queries: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``search`` finds for one query of each vector, for all queries of that vector."""
    one = kept(queries.select("vector").distinct().select(F.monotonically_increasing_id().alias("query_id"), "vector"))
    of = queries.join(one.withColumnRenamed("query_id", "of"), "vector").select("query_id", "of").distinct()
    found = search(one).withColumnRenamed("query_id", "of")
    return found.join(of, "of").select("query_id", "ref_id", "d2", "is_fraud", "rank")


def brute(queries: DataFrame, refs: DataFrame, k: int, dims: int) -> DataFrame:
    """Blocks of queries joined to parts of the references on both numbers."""
    n = parts_of(queries.count(), BLOCK)
    parts = 1 if n == 1 else queries.sparkSession.sparkContext.defaultParallelism
    q = dealt(queries.select("query_id", F.col("vector").alias("q")), "query_id", "block", n, "part", parts)
    if n == 1:
        q = F.broadcast(q)
    r = dealt(refs.select("ref_id", F.col("vector").alias("r"), "is_fraud"), "ref_id", "part", parts, "block", n)
    pairs = r.join(q, ["block", "part"]).select("query_id", "ref_id", squared_distance(F.col("q"), F.col("r"), dims).alias("d2"), "is_fraud")
    group = F.pmod(F.xxhash64("ref_id"), F.lit(GROUPS * k)).alias("group")
    least = pairs.groupBy("query_id", group).agg(F.min("d2").alias("d2")).groupBy("query_id").agg(F.array_sort(F.collect_list("d2")).alias("least"))  # GROUPS * k values at most
    most = kept(least.select("query_id", F.get("least", F.lit(k - 1)).alias("most")))
    if n == 1:
        most = F.broadcast(most)
    near = pairs.join(most, "query_id").where(F.col("most").isNull() | (F.col("d2") <= F.col("most")))
    return best(near.drop("most"), k)


def distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``q`` and ``r``, added dimension by dimension."""
    total = np.zeros((len(q), len(r)))
    for d in range(q.shape[1]):
        gap = q[:, d, None] - r[None, :, d]
        total += gap * gap
    return total


#: Relative error allowed for products in place of sums of squares; far above what 64-bit floats make.
SLACK = 1e-9


class Best:
    """The k nearest of all references added so far, for a matrix of queries.

    Distances are first estimated by a matrix product. Pairs that an estimate, less its error, puts
    within the k-th distance known are computed exactly, in the fixed order; ties go by id.
    """

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.norms = (queries * queries).sum(1)
        self.worst = np.full(len(queries), np.inf)
        self.query, self.d2, self.ref, self.fraud = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, vectors: np.ndarray, ids: np.ndarray, fraud: np.ndarray, only: np.ndarray | None = None) -> None:
        """References for all queries, or for those at the positions ``only``."""
        for start in range(0, len(vectors), BATCH):
            part = slice(start, start + BATCH)
            self._add(vectors[part], ids[part], fraud[part], np.arange(len(self.queries)) if only is None else only)

    def _add(self, r: np.ndarray, ids: np.ndarray, fraud: np.ndarray, only: np.ndarray) -> None:
        if not len(only) or not len(r):
            return
        size = self.norms[only][:, None] + (r * r).sum(1)
        guess = size - 2 * (self.queries[only] @ r.T)
        worst = self.worst[only]
        if len(r) > self.k and np.isinf(worst).any():
            worst = np.minimum(worst, np.partition(guess + SLACK * (1 + size), self.k - 1, axis=1)[:, self.k - 1])
        at, ref = np.nonzero(guess - SLACK * (1 + size) <= worst[:, None])
        self.settle(only[at], ref, r, ids, fraud)

    def settle(self, who: np.ndarray, ref: np.ndarray, r: np.ndarray, ids: np.ndarray, fraud: np.ndarray) -> None:
        """Exact distances of the pairs of queries ``who`` and rows ``ref``; the k best stay."""
        d2 = np.zeros(len(who))
        for d in range(r.shape[1]):
            gap = self.queries[who, d] - r[ref, d]
            d2 += gap * gap
        query, d2, ids, fraud = (np.concatenate(p) for p in ((self.query, who), (self.d2, d2), (self.ref, ids[ref]), (self.fraud, fraud[ref])))
        order = np.lexsort((ids, d2, query))
        first = np.searchsorted(query[order], query[order])
        kept = order[np.arange(len(order)) - first < self.k]
        self.query, self.d2, self.ref, self.fraud = query[kept], d2[kept], ids[kept], fraud[kept]
        n = np.bincount(self.query, minlength=len(self.queries))
        full = np.flatnonzero(n == self.k)
        self.worst[full] = self.d2[np.cumsum(n)[full] - 1]

    def batch(self, names: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([names.take(pa.array(self.query)), pa.array(self.ref), pa.array(self.d2), pa.array(self.fraud)], ["query_id", "ref_id", "d2", "is_fraud"])


def _keys(v: np.ndarray) -> np.ndarray:
    """Is there a last transaction, and the three flags, as one number."""
    return (v[:, 5] >= 0) * 8 + (v[:, 9] >= 0.5) * 4 + (v[:, 10] >= 0.5) * 2 + (v[:, 11] >= 0.5)


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def _compare(near: Best, r: np.ndarray, ids: np.ndarray, fraud: np.ndarray, keyed: bool) -> None:
    """References for all queries, or with ``keyed`` for those of the same key."""
    if not keyed:
        near.add(r, ids, fraud)
        return
    mine, theirs = _keys(near.queries), _keys(r)
    for key in np.intersect1d(mine, theirs):
        among = theirs == key
        near.add(r[among], ids[among], fraud[among], np.flatnonzero(mine == key))


def _flags(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.to_pylist(), bool)


def scan(queries: DataFrame, refs: DataFrame, k: int, dims: int, keyed: bool = False) -> DataFrame:
    """All queries against all references in numpy, the best k of each task first."""
    schema = NEIGHBOUR_SCHEMA.format(id=queries.schema["query_id"].dataType.simpleString())
    queries = queries.selectExpr("query_id", "cast(vector as array<double>) vector")
    refs = refs.selectExpr("cast(ref_id as bigint) ref_id", "cast(vector as array<double>) vector", "is_fraud")
    n = queries.count()
    if n <= BLOCK:
        return best(_sent(queries, refs, k, dims, keyed, schema), k)
    blocks, parts = parts_of(n, GRID_QUERIES), parts_of(refs.count(), GRID_REFS)
    q = dealt(queries, "query_id", "block", blocks, "part", parts)
    r = dealt(refs, "ref_id", "part", parts, "block", blocks)

    def compare(some: pa.Table, among: pa.Table) -> pa.Table:
        near = Best(_matrix(some.column("vector"), dims), k)
        _compare(near, _matrix(among.column("vector"), dims), among.column("ref_id").to_numpy(), _flags(among.column("is_fraud")), keyed)
        return pa.Table.from_batches([near.batch(some.column("query_id").combine_chunks())])

    each = lambda t: t.repartition(min(MOST_PARTITIONS, 2 * blocks * parts), "block", "part").groupBy("block", "part")
    return best(each(q).cogroup(each(r)).applyInArrow(compare, schema), k)


def _sent(queries: DataFrame, refs: DataFrame, k: int, dims: int, keyed: bool, schema: str) -> DataFrame:
    """Queries, at most ``BLOCK``, as part of the task; references in batches as they are read."""
    sent = queries.toArrow()
    ids, matrix = sent.column("query_id").combine_chunks(), _matrix(sent.column("vector"), dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Best(matrix, k)
        for b in batches:
            _compare(near, _matrix(b.column("vector"), dims), b.column("ref_id").to_numpy(zero_copy_only=False), _flags(b.column("is_fraud")), keyed)
        yield near.batch(ids)

    return refs.mapInArrow(run, schema)


def keyed(queries: DataFrame, refs: DataFrame, k: int, dims: int) -> DataFrame:
    """Scan between vectors of one key; queries that this does not settle are scanned in full."""
    if dims != DIMENSIONS:
        raise ValueError("keyed search is for the fourteen features")
    near = kept(scan(queries, refs, k, dims, keyed=True))  # k rows a query
    settled = near.where((F.col("rank") == k) & (F.col("d2") < 1)).select("query_id")
    rest = queries.join(settled, "query_id", "left_anti")
    return near.join(settled, "query_id", "left_semi").unionAll(scan(rest, refs, k, dims))


def chosen(queries: DataFrame, strategy: str, index=None) -> str:
    """The strategy of a name: the index's kind, or by the number of queries, for ``auto`` and names that are not known."""
    strategy = strategy.lower()
    if strategy in STRATEGIES:
        return strategy
    if index is not None:
        return index.kind
    return "scan" if queries.limit(BLOCK + 1).count() <= BLOCK else "boxes"


def knn(queries: DataFrame, refs: DataFrame, k: int = NEIGHBOURS, strategy: str = "auto", dims: int = DIMENSIONS, index=None) -> DataFrame:
    """The k nearest references of each query. ``index``: for cells and boxes, else built on the fly."""
    if k <= 0:
        raise ValueError("k must be positive")
    strategy = chosen(queries, strategy, index)
    if strategy == "brute" or queries.limit(BLOCK + 1).count() <= BLOCK:
        return _found(queries, refs, k, strategy, dims, index)
    if index is not None and strategy in ("cells", "boxes"):
        return once(queries, lambda q: _found(q, refs, k, strategy, dims, index))
    refs = kept(first_copies(refs, k))

    def search(q: DataFrame) -> DataFrame:
        pruned = strategy in ("scan", "keyed") and dims <= PRUNED and q.count() > BLOCK
        return _found(q, refs, k, "boxes" if pruned else strategy, dims)

    return once(queries, search)


def _found(queries: DataFrame, refs: DataFrame, k: int, strategy: str, dims: int, index=None) -> DataFrame:
    if strategy in ("cells", "boxes"):
        from . import cells

        return cells.search(queries, index or cells.build(refs, strategy, dims), k, dims)
    return {"scan": scan, "brute": brute, "keyed": keyed}[strategy](queries, refs, k, dims)
