"""Exact neighbours under any metric: a vantage-point tree, pruned by the triangle inequality alone.

Metrics are ``euclid``, ``manhattan`` and ``angular`` (the angle in radians; a zero vector is at a right angle to all but
zero vectors, which keeps the inequality). Nothing but distances is used, no planes, means or coordinates.

Building. Every node of more than ``TASK`` rows is split at once, by aggregations over all rows: its vantage point is the member
farthest from its parent's, and quartiles of the distances from it cut the node into ``FAN`` shells, of which the least and
largest distance are kept. A node that cannot be cut has all its rows in one place; such a node, of any size, is dealt out in parts. Nodes of at most
``TASK`` rows are branches, which one task each splits by the same rule into leaves of ``leaf_rows``.

Searching. A query descends the tree by joins, a level at a time: first into the nearest shell of each node to one branch, whose k-th
distance is real; then into all shells that reach into this distance. In a branch it meets its nearest leaf first. A row of a leaf is
compared only if its distance from the leaf's first row and the query's differ by no more than the k-th distance.
The nodes of a level go to all tasks if a count shows that they are few, else they are joined by a shuffle.

References and queries whose vector is null, of another length or not finite (nor below 1e150) are left out, so such queries have no
neighbours. Ties go by ``ref_id``; repeated references are each a neighbour. No references give no neighbours. Columns other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from .cells import _matrix
from .knn import GRID_QUERIES, NEIGHBOUR_SCHEMA, best
from .selection import kept, sent

#: Rows of a branch, which one task compares; shells of a node, a power of two; levels, after which a larger node is dealt out in parts.
TASK, FAN, LEVELS = 32_768, 4, 28
#: Queries compared with a leaf at a time.
SOME = 256
#: Components from here on count as infinite; squares of smaller ones are not.
LARGE = 1e150
METRICS = ("euclid", "manhattan", "angular")


@dataclass
class Tree:
    """``rows`` (ref_id, vector, is_fraud, node, leaf), ``sizes`` (node, n) of branches, and for each level its inner nodes: node, vantage, shells (lo, hi, child)."""

    rows: DataFrame
    sizes: DataFrame
    levels: list[DataFrame]
    metric: str


def between(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances along the last axis, added from its first dimension to its last; other axes are broadcast."""
    total, left, right = 0.0, 0.0, 0.0
    for d in range(a.shape[-1]):
        x, y = a[..., d], b[..., d]
        if metric == "angular":
            total, left, right = total + x * y, left + x * x, right + y * y
        else:
            total = total + (np.abs(x - y) if metric == "manhattan" else (x - y) * (x - y))
    if metric != "angular":
        return total if metric == "manhattan" else np.sqrt(total)
    size = np.sqrt(left) * np.sqrt(right)
    angle = np.arccos(np.clip(total / np.where(size > 0, size, 1.0), -1.0, 1.0))
    return np.where(size > 0, angle, np.where(left == right, 0.0, np.pi / 2))


def distance(a: Column, b: Column, dims: int, metric: str) -> Column:
    """The same as a column."""
    if metric != "angular":
        return kernels.manhattan(a, b, dims) if metric == "manhattan" else kernels.distance(a, b, dims)
    left, right = kernels.squared_norm(a, dims), kernels.squared_norm(b, dims)
    size = F.sqrt(left) * F.sqrt(right)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), kernels.dot(a, b, dims) / size)))
    return F.when(size > 0, angle).when(left == right, 0.0).otherwise(np.pi / 2)


def _reach(d, metric: str):
    """A distance with what rounding may add; angles near 0 and 180 degrees have half the digits."""
    return d * (1 + 1e-9) + (1e-6 if metric == "angular" else 1e-9)


def _whole(rows: DataFrame, dims: int) -> DataFrame:
    """Rows whose vector is complete."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGE))
    return rows.withColumn("vector", F.col("vector").cast("array<double>")).where((F.size("vector") == dims) & sound)


def _split(points: np.ndarray, metric: str, leaf_rows: int) -> np.ndarray:
    """The leaf of each row of a branch, by medians of distances from vantage points."""
    leaf = np.zeros(len(points), np.int32)
    todo, leaves = [(np.arange(len(points)), np.zeros(len(points)))], 0
    while todo:
        at, far = todo.pop()
        if len(at) > leaf_rows:
            d = between(points[at], points[at[far.argmax()]], metric)
            middle = np.partition(d, len(d) // 2)[len(d) // 2]
            inner = d <= middle if middle < d.max() else d < middle
            if inner.any():
                todo += [(at[inner], d[inner]), (at[~inner], d[~inner])]
                continue
        leaf[at] = leaves
        leaves += 1
    return leaf


def build(refs: DataFrame, metric: str = "euclid", dims: int = 14, leaf_rows: int = 256) -> Tree:
    """A tree over all references (``ref_id``, ``vector``, ``is_fraud``)."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    whole = _whole(refs.selectExpr("cast(ref_id as bigint) ref_id", "vector", "cast(is_fraud as boolean) is_fraud"), dims)
    rows = whole.withColumns({"node": F.lit(1).cast("long"), "far": F.lit(0.0), "done": F.lit(False), "up": F.lit(None).cast("long")})
    shares, levels = [i / FAN for i in range(1, FAN)], []
    for level in range(LEVELS + 1):
        # the vantage point of a node comes with its size: the member farthest from the parent's
        sizes = kept(rows.groupBy("node").agg(F.count("*").alias("n"), F.first("done").alias("done"), F.max_by("vector", F.struct("far", -F.col("ref_id"))).alias("vantage")))
        big = sizes.where((F.col("n") > TASK) & ~F.col("done")).select("node", "vantage")
        if level == LEVELS or not big.limit(1).count():
            break
        d = F.when(F.col("vantage").isNotNull(), distance(F.col("vector"), F.col("vantage"), dims, metric))
        seen = rows.join(sent(big), "node", "left").withColumn("d", d)
        cuts = seen.where("d is not null").groupBy("node").agg(F.percentile_approx("d", shares, 10_000).alias("cuts"), F.min("d").alias("least"), F.max("d").alias("most"))
        # a cut that is the largest distance belongs to the shell beyond it, so that rows are parted if any two distances differ
        beyond = lambda c: F.when(c == F.col("most"), F.col("d") >= c).otherwise(F.col("d") > c).cast("long")
        shell = sum((beyond(F.col("cuts")[i]) for i in range(FAN - 1)), F.lit(0).cast("long"))
        parted = F.coalesce(F.col("least") < F.col("most"), F.lit(False))
        moved = seen.drop("vantage", "up").join(sent(kept(cuts)), "node", "left").select(
            "ref_id", "vector", "is_fraud",
            F.when(parted, FAN * F.col("node") + shell).otherwise(F.col("node")).alias("node"),
            F.coalesce("d", "far").alias("far"),
            (F.col("done") | F.coalesce(F.col("least") == F.col("most"), F.lit(False))).alias("done"),
            F.when(parted, F.col("node")).alias("up"),
        )
        rows = kept(moved)
        ends = rows.where("up is not null").groupBy("up", "node").agg(F.min("far").alias("lo"), F.max("far").alias("hi"))
        shells = ends.groupBy(F.col("up").alias("node")).agg(F.collect_list(F.struct("lo", "hi", F.col("node").alias("child"))).alias("shells"))  # FAN at most
        levels.append(kept(big.join(shells, "node")))
    placed = rows.join(sent(sizes.select("node", (F.col("n") > TASK).alias("large"))), "node").select("ref_id", "vector", "is_fraud", "node", "large")

    def split(t: pa.Table) -> pa.Table:
        return t.append_column("leaf", pa.array(_split(_matrix(t.column("vector"), dims), metric, leaf_rows)))

    schema = "ref_id long, vector array<double>, is_fraud boolean, node long, leaf int"
    small = placed.where("not large").drop("large").groupBy("node").applyInArrow(split, schema)
    return Tree(kept(small.unionByName(placed.where("large").drop("large").withColumn("leaf", F.lit(0)))), kept(sizes.select("node", "n")), levels, metric)


def _descended(asked: DataFrame, tree: Tree, dims: int, first: bool) -> DataFrame:
    """``query_id``, ``q``, ``most``, ``node``: the branch that nearest shells lead to; or all branches that may hold rows within ``most``."""
    at, d, none = asked.withColumn("node", F.lit(1).cast("long")), F.col("d"), F.col("vantage").isNull()
    for level in tree.levels:
        far = F.when(~none, distance(F.col("q"), F.col("vantage"), dims, tree.metric))
        met = at.join(sent(level), "node", "left").withColumn("d", far)
        gap = lambda s: F.greatest(s["lo"] - d, d - s["hi"], F.lit(0.0))
        if first:
            nearest = F.array_min(F.transform("shells", lambda s: F.struct(gap(s).alias("gap"), s["child"].alias("child"))))
            nodes = F.coalesce(nearest["child"], F.col("node"))
        else:
            within = F.filter("shells", lambda s: gap(s) <= _reach(F.col("most"), tree.metric))
            nodes = F.explode(F.when(none, F.array("node")).otherwise(F.transform(within, lambda s: s["child"])))
        at = met.select("query_id", "q", "most", nodes.alias("node"))
    return at


class _Nearest:
    """The k nearest so far of every query, under a metric; free places are at an infinite distance."""

    def __init__(self, queries: np.ndarray, most: np.ndarray, k: int, metric: str) -> None:
        self.queries, self.worst, self.metric, self.pairs = queries, most.copy(), metric, 0
        self.d, self.ref, self.fraud = np.full((len(queries), k), np.inf), np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k), bool)

    def add(self, rows: np.ndarray, ids: np.ndarray, fraud: np.ndarray, from_first: np.ndarray, only: np.ndarray, q_first: np.ndarray) -> None:
        """Rows of a leaf for the queries ``only``; distances of both from the leaf's first row are known."""
        for start in range(0, len(only), SOME):
            who, gap = only[start : start + SOME], np.abs(q_first[start : start + SOME, None] - from_first[None, :])
            wanted = gap <= _reach(self.worst[who], self.metric)[:, None]
            at, ref = np.nonzero(wanted)
            self.pairs += len(at)
            if 8 * len(at) > wanted.size:  # most pairs: without copies of vectors
                d = between(self.queries[who][:, None, :], rows[None, :, :], self.metric)[wanted]
            else:
                d = between(self.queries[who[at]], rows[ref], self.metric)
            near = np.flatnonzero(d <= self.worst[who[at]])
            self._keep(who[at[near]], d[near], ids[ref[near]], fraud[ref[near]])

    def _keep(self, query: np.ndarray, d: np.ndarray, ids: np.ndarray, fraud: np.ndarray) -> None:
        """Candidates among what their queries have."""
        of, k = np.unique(query), self.d.shape[1]
        query, d, ids, fraud = (np.concatenate(p) for p in ((np.repeat(of, k), query), (self.d[of].ravel(), d), (self.ref[of].ravel(), ids), (self.fraud[of].ravel(), fraud)))
        order = np.lexsort((ids, d, query))
        first = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]  # k of each query, as it has k places
        self.d[of], self.ref[of], self.fraud[of] = (v[first].reshape(-1, k) for v in (d, ids, fraud))
        self.worst[of] = np.minimum(self.worst[of], self.d[of, -1])

    def table(self, names: pa.ChunkedArray) -> pa.Table:
        at, place = np.nonzero(np.isfinite(self.d))
        found = [names.combine_chunks().take(pa.array(at)), *(pa.array(v[at, place]) for v in (self.ref, self.d, self.fraud))]
        return pa.table(found, names=["query_id", "ref_id", "d2", "is_fraud"])


def _meet(some: pa.Table, among: pa.Table, metric: str, k: int, dims: int) -> _Nearest:
    """The best of a branch's rows for some queries, each query's nearest leaf first."""
    near = _Nearest(_matrix(some.column("q"), dims), some.column("most").to_numpy(), k, metric)
    if not len(some) or not len(among):
        return near
    among = among.sort_by([("leaf", "ascending"), ("ref_id", "ascending")])
    leaf, rows = among.column("leaf").to_numpy(), _matrix(among.column("vector"), dims)
    ids, fraud = among.column("ref_id").to_numpy(), np.asarray(among.column("is_fraud").to_pylist(), bool)
    ends = np.append(np.unique(leaf, return_index=True)[1], len(leaf))
    starts, sizes = ends[:-1], np.diff(ends)
    own = between(rows, np.repeat(rows[starts], sizes, 0), metric)
    lo, hi = np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)
    far = np.stack([between(near.queries, rows[s], metric) for s in starts], 1)
    low = np.maximum(np.maximum(lo - far, far - hi), 0)
    nearest = np.lexsort((far, low))[:, 0]
    for turn in range(2):
        for c, s in enumerate(starts):
            only = np.flatnonzero((low[:, c] <= _reach(near.worst, metric)) & ((nearest == c) == (turn == 0)))
            if len(only):
                part = slice(s, ends[c + 1])
                near.add(rows[part], ids[part], fraud[part], own[part], only, far[only, c])
    return near


def _compared(met: DataFrame, tree: Tree, k: int, dims: int, count: bool = False) -> DataFrame:
    """The k best of each query and task; or with ``count``, ``pairs`` of each task. A branch wanted by very many queries is compared by blocks of them."""
    blocks = met.groupBy("node").agg(F.ceil(F.count("*") / GRID_QUERIES).alias("blocks"))
    shape = kept(tree.sizes.select(F.col("node").alias("node"), F.ceil(F.col("n") / TASK).alias("parts")).join(blocks, "node"))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    asked = met.join(sent(shape), "node").withColumns({"part": to("parts"), "block": deal("query_id", "blocks")})
    rows = tree.rows.join(sent(shape), "node").withColumns({"block": to("blocks"), "part": deal("ref_id", "parts")})
    of, metric = ("node", "part", "block"), tree.metric

    def compare(some: pa.Table, among: pa.Table) -> pa.Table:
        near = _meet(some, among, metric, k, dims)
        return pa.table({"pairs": [near.pairs]}) if count else near.table(some.column("query_id"))

    schema = "pairs long" if count else NEIGHBOUR_SCHEMA.format(id=met.schema["query_id"].dataType.simpleString())
    grouped = asked.select("query_id", "q", "most", *of).groupBy(*of).cogroup(rows.select("ref_id", "vector", "is_fraud", "leaf", *of).groupBy(*of))
    return grouped.applyInArrow(compare, schema)


def _phases(queries: DataFrame, tree: Tree, k: int, dims: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is met in the first phase, what it finds, and what is met in the second."""
    asked = _whole(queries.select("query_id", "vector"), dims).select("query_id", F.col("vector").alias("q"), F.lit(float("inf")).alias("most"))
    first = kept(_descended(asked, tree, dims, True))
    near = kept(best(_compared(first, tree, k, dims), k))
    real = near.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("d2")).alias("real"))
    again = first.join(real, "query_id", "left").select("query_id", "q", F.coalesce("real", "most").alias("most"))
    met = first.select("query_id", F.col("node").alias("node"))
    return first, near, kept(_descended(again, tree, dims, False).join(met, ["query_id", "node"], "left_anti"))


def search(queries: DataFrame, tree: Tree, k: int, dims: int) -> DataFrame:
    """``query_id, ref_id, distance, is_fraud, rank`` of the k references of least (distance, ref_id) of each query."""
    if k <= 0:
        raise ValueError("k must be positive")
    _, near, second = _phases(queries, tree, k, dims)
    found = best(near.drop("rank").unionByName(_compared(second, tree, k, dims)), k)
    return found.withColumnRenamed("d2", "distance")


def pairs_compared(queries: DataFrame, tree: Tree, k: int, dims: int) -> int:
    """How many pairs a search compares beside those with the first rows of leaves."""
    first, _, second = _phases(queries, tree, k, dims)
    return sum(_compared(met, tree, k, dims, count=True).agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0] for met in (first, second))
