"""Reference vectors filed in a bisecting tree of balls or boxes, and a search in two phases that prunes by real distances.

Building. The upper part of the tree is first fitted to about ``SAMPLE`` rows, drawn by a hash of their ids, and all rows go down its
planes in one pass; the sample decides only where planes lie. Nodes that have more than ``GATHER`` rows after that are split level by level, by aggregations over all their rows. A ball's pivots are the member farthest from the centre and the member farthest from
that one, and the plane midway between them divides it; a box is divided at the exact median of its widest dimension
(``selection.nth``). What is left, at most ``GATHER`` rows each, is split further by the same rules, each in one task, into branches of
at most ``TASK`` rows and these into leaves of ``leaf_rows``. So a task's rows are bounded whatever the size of the store, and there is no bound on the number
of leaves. Rows that are all equal cannot be split; such a branch, of any size, is dealt out in parts of ``TASK`` rows.

Searching. A query goes to its nearest branch and there to its nearest leaf, then to the other leaves that can
still hold a neighbour. The k-th distance found is real, and bounds the second phase: only branches that reach
into it are met, and in these only leaves that do. Where a branch is wanted by very many queries they are dealt out in blocks.
Bounds of at most ``SENT`` branches go to the tasks that route queries; of more, those of their common ancestors, and
branches are found below these by a join.

Splits decide only what is compared; the answers are exact, and equal to those of a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import squared_distance
from .aggregates import side
from .knn import GRID_QUERIES, NEIGHBOUR_SCHEMA, Best, best, distances
from .selection import FEW_GROUPS, kept, nth, sent

#: Rows of a branch, which one task compares, and rows that one task splits.
TASK, GATHER = 32_768, 262_144
#: Branches whose bounds are sent to all tasks, at most.
SENT = 16_384
#: Rows that planes of the upper part are fitted to at first, and the share of ``GATHER`` that a node should have by these.
SAMPLE, SHARE = 65_536, 0.75
#: Levels of the upper part. A node that is larger still is a branch dealt out in parts.
LEVELS = 40
WITHIN = 20
SLACK = 1e-9
KEPT = "ref_id long, vector array<double>, is_fraud boolean, branch long, leaf int"


@dataclass
class Index:
    """``rows`` (ref_id, vector, is_fraud, branch, leaf) and ``branches`` (branch, n, then centre and radius, or lo and hi).

    Nodes of the upper part are numbered as in a heap: the halves of node n are 2 n and 2 n + 1, the root is 1. A branch has
    the number of its node and then ``WITHIN`` bits of its own.
    """

    rows: DataFrame
    branches: DataFrame
    kind: str


def _ball_sides(rows: DataFrame, big: DataFrame, dims: int) -> tuple[DataFrame, Column]:
    """Pivots of every big node, and the condition of its first half."""
    v = F.col("vector")
    inside = rows.join(sent(big.select("node")), "node")
    centre = inside.groupBy("node").agg(F.array(*(F.avg(v[i]) for i in range(dims))).alias("at"))
    far = lambda points: inside.join(sent(points), "node").groupBy("node").agg(F.max(F.struct(squared_distance(v, F.col("at"), dims), -F.col("ref_id"), "vector")).alias("m")).select("node", F.col("m.vector").alias("at"))
    first = kept(far(kept(centre)))
    second = kept(far(first))
    return first.withColumnRenamed("at", "a").join(second.withColumnRenamed("at", "b"), "node"), side(v, F.col("a"), F.col("b"), dims)


def _box_sides(rows: DataFrame, big: DataFrame) -> tuple[DataFrame, Column]:
    """Widest dimension and median of every big node, and the condition of its first half."""
    wide = kept(big.select("node", (F.array_position("spread", F.array_max("spread")) - 1).cast("int").alias("dim"), "hi"))
    value = F.get("vector", "dim")
    middle = nth(rows.join(sent(wide), "node"), "node", value, F.ceil(F.col("n") / 2))
    cut = wide.join(middle.select("node", "value"), "node").select("node", "dim", "value", (F.col("value") == F.get("hi", "dim")).alias("top"))
    return kept(cut), (value < F.col("value")) | (~F.col("top") & (value == F.col("value")))  # a median that is the largest value goes to the second half


def _cut(p: np.ndarray, kind: str) -> tuple:
    """How rows are divided: by the plane between two pivots, or at the median of the widest dimension."""
    if kind == "cells":
        a = p[((p - p.mean(0)) ** 2).sum(1).argmax()]
        return a, p[((p - a) ** 2).sum(1).argmax()]
    dim = int(np.ptp(p, axis=0).argmax())
    x = p[:, dim]
    middle = np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2]
    return dim, middle, middle == x.max()


def _first(p: np.ndarray, kind: str, cut: tuple) -> np.ndarray:
    """Which rows go to the first half."""
    if kind == "cells":
        a, b = cut
        return 2 * (p @ (b - a)) <= b @ b - a @ a
    dim, middle, top = cut
    return p[:, dim] < middle if top else p[:, dim] <= middle  # a median that is the largest value goes to the second half


def _fitted(points: np.ndarray, kind: str, n: int) -> tuple[dict[int, tuple], int]:
    """Cuts by the number of their node, over a sample of ``n`` rows, down to nodes of about ``SHARE`` of ``GATHER`` rows; and the number of levels."""
    cuts, levels = {}, 0
    todo = [(1, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        level = node.bit_length()
        if len(at) * n <= SHARE * GATHER * len(points) or level > LEVELS // 2 or not np.ptp(points[at], axis=0).max(initial=0) > 0:
            continue
        cut = _cut(points[at], kind)
        first = _first(points[at], kind, cut)
        if 0 < first.sum() < len(at):
            cuts[node], levels = cut, max(levels, level)
            todo += [(2 * node, at[first]), (2 * node + 1, at[~first])]
    return cuts, levels


def _down(points: np.ndarray, kind: str, cuts: dict[int, tuple]) -> np.ndarray:
    """The node that each row comes to."""
    out = np.ones(len(points), np.int64)
    todo = [(1, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if node in cuts and len(at):
            first = _first(points[at], kind, cuts[node])
            todo += [(2 * node, at[first]), (2 * node + 1, at[~first])]
        else:
            out[at] = node
    return out


def _presplit(rows: DataFrame, kind: str, dims: int) -> tuple[DataFrame, int]:
    """Rows at the nodes of a tree that is fitted to a sample, and its number of levels."""
    n = rows.count()
    if n <= GATHER:
        return rows, 0
    draw = F.pmod(F.xxhash64("ref_id"), F.lit(1 << 30)) / float(1 << 30)
    cuts, levels = _fitted(_matrix(rows.where(draw < SAMPLE / n).select("vector").toArrow().column("vector"), dims), kind, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = _down(_matrix(b.column("vector"), dims), kind, cuts)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("ref_id", "vector", "is_fraud")), pa.array(node)], ["ref_id", "vector", "is_fraud", "node"])

    return kept(rows.mapInArrow(run, "ref_id long, vector array<double>, is_fraud boolean, node long")), levels


def _upper(refs: DataFrame, kind: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``node``, by a sample and then level by level; and the last sizes, with ``whole`` where a node is to be split no further."""
    v = F.col("vector")
    rows, levels = _presplit(refs.select("ref_id", "vector", "is_fraud", F.lit(1).cast("long").alias("node")), kind, dims)
    for level in range(levels, LEVELS + 1):
        lo, hi = (F.array(*(f(v[i]) for i in range(dims))) for f in (F.min, F.max))
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), lo.alias("lo"), hi.alias("hi"))
        sizes = kept(sizes.withColumn("spread", F.zip_with("hi", "lo", lambda a, b: a - b)))
        big = sizes.where((F.col("n") > GATHER) & (F.array_max("spread") > 0))
        if level == LEVELS or not big.limit(1).count():
            break
        cuts, first = _ball_sides(rows, big, dims) if kind == "cells" else _box_sides(rows, big)
        joined = rows.join(sent(cuts.withColumn("cut", F.lit(True))), "node", "left")
        rows = kept(joined.select("ref_id", "vector", "is_fraud", F.when(F.col("cut"), 2 * F.col("node") + F.when(first, 0).otherwise(1)).otherwise(F.col("node")).alias("node")))
    return rows, sizes.select("node", (F.col("n") > GATHER).alias("whole"))


def _leaves(points: np.ndarray, kind: str, leaf_rows: int, task: int) -> tuple[np.ndarray, np.ndarray]:
    """The branch and the leaf of each row of what one task splits."""
    branch, leaf = np.zeros(len(points), np.int64), np.zeros(len(points), np.int32)
    branches = leaves = 0
    todo = [(np.arange(len(points)), False)]
    while todo:
        at, inside = todo.pop()
        p = points[at]
        spread = np.ptp(p, axis=0)
        halves = None
        if len(at) > leaf_rows and spread.max() > 0:
            first = _first(p, kind, _cut(p, kind))
            halves = (at[first], at[~first]) if 0 < first.sum() < len(at) else None
        if not inside and (len(at) <= task or halves is None):  # a branch begins; what is under it is visited next
            branch[at], inside = branches, True
            branches += 1
        if halves is None:
            leaf[at] = leaves
            leaves += 1
        else:
            todo += [(h, inside) for h in halves]
    return branch, leaf


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def build(refs: DataFrame, kind: str = "cells", dims: int = 14, leaf_rows: int = 512) -> Index:
    """An index whose leaves have at most ``leaf_rows`` rows, unless these are equal."""
    rows, nodes = _upper(refs.selectExpr("cast(ref_id as bigint) ref_id", "cast(vector as array<double>) vector", "is_fraud"), kind, dims)
    placed = rows.join(sent(nodes), "node")
    task = TASK

    def split(t: pa.Table) -> pa.Table:
        branch, leaf = _leaves(_matrix(t.column("vector"), dims), kind, leaf_rows, task)
        branch |= np.asarray(t.column("node"), np.int64) << WITHIN
        return pa.table([*(t.column(c) for c in ("ref_id", "vector", "is_fraud")), pa.array(branch), pa.array(leaf)], names=["ref_id", "vector", "is_fraud", "branch", "leaf"])

    split_rows = placed.where("not whole").drop("whole").groupBy("node").applyInArrow(split, KEPT)
    whole_rows = placed.where("whole").selectExpr("ref_id", "vector", "is_fraud", f"shiftleft(node, {WITHIN}) as branch", "0 as leaf")
    rows = kept(split_rows.unionByName(whole_rows))
    return Index(rows, kept(bounds(rows, kind, dims)), kind)


def bounds(rows: DataFrame, kind: str, dims: int) -> DataFrame:
    """Exact bounds of the branches of ``rows``, by aggregation."""
    v = F.col("vector")
    by = rows.groupBy("branch")
    if kind == "boxes":
        return by.agg(F.count("*").alias("n"), F.array(*(F.min(v[i]) for i in range(dims))).alias("lo"), F.array(*(F.max(v[i]) for i in range(dims))).alias("hi"))
    centres = kept(by.agg(F.count("*").alias("n"), F.array(*(F.avg(v[i]) for i in range(dims))).alias("centre")))  # as many as branches
    reach = F.max(F.sqrt(squared_distance(v, F.col("centre"), dims))).alias("radius")
    return rows.join(sent(centres), "branch").groupBy("branch", "n", "centre").agg(reach)


def _above(branches: DataFrame, kind: str, dims: int, depth: int) -> DataFrame:
    """Bounds of the ancestors of branches at ``depth``; branches above it stand for themselves."""
    by = branches.withColumn("branch", _ancestor(F.col("branch"), depth)).groupBy("branch")
    if kind == "boxes":
        return by.agg(F.sum("n").alias("n"), *(F.array(*(f(F.col(c)[i]) for i in range(dims))).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"))))
    c = F.col("centre")
    centre = by.agg(F.sum("n").alias("n"), F.array(*(F.avg(c[i]) for i in range(dims))).alias("middle"))
    inside = branches.withColumn("branch", _ancestor(F.col("branch"), depth)).select("branch", "centre", "radius").join(sent(kept(centre)), "branch")
    return inside.groupBy("branch", "n", "middle").agg(F.max(F.sqrt(squared_distance(c, F.col("middle"), dims)) + F.col("radius")).alias("radius")).withColumnRenamed("middle", "centre")


def _ancestor(node: Column, depth: int) -> Column:
    level = F.length(F.bin(node)) - 1
    return F.call_function("shiftright", node, F.greatest(F.lit(0), level - depth))


@dataclass
class Routes:
    """Bounds of few enough nodes; the depth these are ancestors at, if they are no branches; are the branches few enough to be sent?"""

    table: pa.Table
    depth: int | None
    few: bool

    def sent(self, of_branches: DataFrame) -> DataFrame:
        return F.broadcast(of_branches) if self.few else of_branches


def _routes(index: Index, dims: int) -> Routes:
    n = index.branches.count()
    depth = None if n <= SENT else int(np.log2(SENT))
    nodes = index.branches if depth is None else _above(index.branches, index.kind, dims, depth)
    return Routes(nodes.toArrow(), depth, n <= FEW_GROUPS)  # at most SENT rows, or twice as many


def _reach(q: np.ndarray, table: pa.Table, kind: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance from each query to what each node may hold."""
    matrix = lambda c: _matrix(table.column(c), dims)
    if kind == "boxes":
        lo, hi = matrix("lo"), matrix("hi")
        low, high = np.zeros((len(q), len(lo))), np.zeros((len(q), len(lo)))
        for d in range(dims):
            below, above = lo[None, :, d] - q[:, d, None], q[:, d, None] - hi[None, :, d]
            low += np.maximum(np.maximum(below, above), 0) ** 2
            high += np.maximum(np.abs(below), np.abs(above)) ** 2
        return np.sqrt(low), np.sqrt(high)
    gap, radius = np.sqrt(distances(q, matrix("centre"))), np.asarray(table.column("radius"), np.float64)
    return np.maximum(gap - radius, 0), gap + radius


def _low(kind: str, dims: int) -> Column:
    """Least distance from ``q`` to a joined node, as a column."""
    q = F.col("q")
    if kind == "boxes":
        gap = [F.greatest(F.col("lo")[i] - q[i], q[i] - F.col("hi")[i], F.lit(0.0)) for i in range(dims)]
        return F.sqrt(sum((g * g for g in gap), F.lit(0.0)))
    return F.sqrt(squared_distance(q, F.col("centre"), dims)) - F.col("radius")


def _routed(queries: DataFrame, nodes: pa.Table, kind: str, dims: int, k: int, first: bool) -> DataFrame:
    """``query_id``, ``q``, ``most``, ``branch``: the nearest node of k rows of each query; or all within ``most`` of it.

    At ``first``, ``most`` is how far away k rows are at most, by the bounds of the nodes.
    """
    sizes, ids = np.asarray(nodes.column("n"), np.int64), np.asarray(nodes.column("branch"), np.int64)
    id_kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                q = _matrix(b.column("q"), dims)
                low, high = _reach(q, nodes, kind, dims)
                if first:
                    order = high.argsort(1)
                    enough = np.minimum((sizes[order].cumsum(1) < k).sum(1), len(sizes) - 1)
                    most = np.take_along_axis(high, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0] if sizes.sum() >= k else np.full(len(q), np.inf)
                    near = np.where(sizes[None, :] >= min(k, sizes.max()), low, np.inf)
                    at = np.lexsort((high, near))[:, 0] if len(q) else np.zeros(0, np.int64)
                    who, node = np.arange(len(q)), at
                else:
                    most = b.column("most").to_numpy(zero_copy_only=False)
                    who, node = np.nonzero(low <= most[:, None] * (1 + SLACK) + SLACK)
                taken = pa.array(who)
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(taken), b.column("q").take(taken), pa.array(most[who]), pa.array(ids[node])], ["query_id", "q", "most", "branch"])

    return queries.mapInArrow(run, f"query_id {id_kind}, q array<double>, most double, branch long")


def _meet(some: pa.Table, among: pa.Table, kind: str, k: int, dims: int) -> tuple[Best, int]:
    """The best of a branch's rows for some queries, within their ``most``; and how many pairs were compared.

    Each query meets its nearest leaf first, then those that reach into the k-th distance it has by then.
    """
    near = Best(_matrix(some.column("q"), dims), k)
    near.worst = np.square(some.column("most").to_numpy() * (1 + SLACK) + SLACK)
    if not len(some) or not len(among):
        return near, 0
    leaf = among.column("leaf").to_numpy()
    order = np.argsort(leaf, kind="stable")
    leaf, rows = leaf[order], _matrix(among.column("vector"), dims)[order]
    ids, fraud = among.column("ref_id").to_numpy()[order], np.asarray(among.column("is_fraud").to_pylist(), bool)[order]
    ends = np.append(np.unique(leaf, return_index=True)[1], len(leaf))
    if kind == "boxes":
        table = {"lo": np.minimum.reduceat(rows, ends[:-1]), "hi": np.maximum.reduceat(rows, ends[:-1])}
    else:
        sizes = np.diff(ends)
        centre = np.add.reduceat(rows, ends[:-1]) / sizes[:, None]
        table = {"centre": centre, "radius": np.sqrt(np.maximum.reduceat(((rows - np.repeat(centre, sizes, 0)) ** 2).sum(1), ends[:-1]))}
    as_list = lambda v: pa.array(v) if v.ndim == 1 else pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), dims)
    low = _reach(near.queries, pa.table({c: as_list(v) for c, v in table.items()}), kind, dims)[0]
    nearest, pairs = low.argmin(1), 0
    for turn in range(2):
        for c in range(len(ends) - 1):
            reach = low[:, c] <= np.sqrt(near.worst) * (1 + SLACK) + SLACK
            only = np.flatnonzero(reach & ((nearest == c) == (turn == 0)))
            if len(only):
                part = slice(ends[c], ends[c + 1])
                pairs += len(only) * (ends[c + 1] - ends[c])
                near.add(rows[part], ids[part], fraud[part], only)
    return near, int(pairs)


def _compared(met: DataFrame, index: Index, routes: Routes, k: int, dims: int, count: bool = False) -> DataFrame:
    """The k best of each query and task; or with ``count``, ``pairs`` of each task.

    A task has at most ``TASK`` rows of a branch and about ``GRID_QUERIES`` of the queries that want it.
    """
    blocks = met.groupBy("branch").agg(F.ceil(F.count("*") / GRID_QUERIES).alias("blocks"))
    shape = kept(index.branches.select("branch", F.ceil(F.col("n") / TASK).alias("parts")).join(routes.sent(blocks), "branch"))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    asked = met.join(routes.sent(shape), "branch").withColumns({"part": to("parts"), "block": deal("query_id", "blocks")})
    rows = index.rows.join(routes.sent(shape), "branch").withColumns({"block": to("blocks"), "part": deal("ref_id", "parts")})
    kind, of = index.kind, ("branch", "part", "block")

    def compare(some: pa.Table, among: pa.Table) -> pa.Table:
        near, pairs = _meet(some, among, kind, k, dims)
        return pa.table({"pairs": [pairs]}) if count else pa.Table.from_batches([near.batch(some.column("query_id").combine_chunks())])

    schema = "pairs long" if count else NEIGHBOUR_SCHEMA.format(id=met.schema["query_id"].dataType.simpleString())
    grouped = asked.select("query_id", "q", "most", *of).groupBy(*of).cogroup(rows.select("ref_id", "vector", "is_fraud", "leaf", *of).groupBy(*of))
    return grouped.applyInArrow(compare, schema)


def _phases(queries: DataFrame, index: Index, routes: Routes, k: int, dims: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is met in the first phase, what it finds, and what is met in the second."""
    asked = queries.selectExpr("query_id", "cast(vector as array<double>) q")
    first = _routed(asked, routes.table, index.kind, dims, k, True)
    own = [F.col(c).alias(c) for c in index.branches.columns]  # columns of their own: branches and rows stem from one table, and meet in a cogroup
    below = index.branches.select(*own, _ancestor(F.col("branch"), routes.depth).alias("above")) if routes.depth is not None else None
    if below is not None:
        inside = first.withColumnRenamed("branch", "above").join(routes.sent(below), "above")
        # of an ancestor's branches the nearest with k rows, else the nearest of most rows
        pick = F.min(F.struct(-F.least(F.col("n"), F.lit(k)), _low(index.kind, dims).alias("low"), "branch"))
        first = inside.groupBy("query_id", "q", "most").agg(pick.alias("at")).select("query_id", "q", "most", "at.branch")
    first = kept(first)
    near = kept(best(_compared(first, index, routes, k, dims), k))
    real = near.groupBy("query_id").agg(F.when(F.count("*") == k, F.sqrt(F.max("d2"))).alias("real"))
    again = first.join(real, "query_id", "left").select("query_id", "q", F.least("most", "real").alias("most"))
    reached = _routed(again, routes.table, index.kind, dims, k, False)
    if below is not None:
        inside = reached.withColumnRenamed("branch", "above").join(routes.sent(below), "above")
        reached = inside.where(_low(index.kind, dims) <= F.col("most") * (1 + SLACK) + SLACK).select("query_id", "q", "most", "branch")
    second = reached.join(first.select("query_id", "branch"), ["query_id", "branch"], "left_anti").select("query_id", "q", "most", "branch")
    return first, near, kept(second)


def pairs_compared(queries: DataFrame, index: Index, k: int, dims: int) -> int:
    """How many pairs a search compares, of all that a scan does."""
    routes = _routes(index, dims)
    if not len(routes.table):
        return 0
    first, _, second = _phases(queries, index, routes, k, dims)
    return sum(_compared(met, index, routes, k, dims, count=True).agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0] for met in (first, second))


def search(queries: DataFrame, index: Index, k: int, dims: int) -> DataFrame:
    """Exact neighbours."""
    routes = _routes(index, dims)
    if not len(routes.table):
        return best(queries.select("query_id", F.lit(0).cast("long").alias("ref_id"), F.lit(0.0).alias("d2"), F.lit(False).alias("is_fraud")).where("false"), k)
    _, near, second = _phases(queries, index, routes, k, dims)
    return best(near.drop("rank").unionByName(_compared(second, index, routes, k, dims)), k)
