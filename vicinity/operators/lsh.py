"""Approximate neighbours by hashing: p-stable projections, buckets probed in the order of their distance from the query, and exact distances.

A hash table has ``projections`` random directions (normal, so that a projection of a difference is spread as its length).
A direction cuts space into cells of one width and a row's bucket is its cells along all of them, so near rows often share
one. The width is ``width`` times the mean distance of a fifth neighbour, measured for about ``DRAWN`` vectors, drawn by a hash, among all different ones. Directions and offsets come from a
seed and projections are added dimension by dimension, so equal vectors always share buckets.

A query looks into its own bucket of every table and then into the ``probes - 1`` others that are nearest by the
sum of squared distances from its projections to the walls between, among those one cell off in any directions. What it meets
is compared exactly; of a row met in several tables one is kept.

Every row is indexed, equal vectors as one: it keeps the ids of the ``copies`` least of its rows, as others are never among that many neighbours (a
search for more reads the rows again). Queries of one vector are one, too. A task compares a bin of buckets: those that agree on their first cells
go together, on as few cells as leave a bin bounded, so a query meets the buckets of its probes in few bins and travels once to each. How
many cells is told by counts over about ``SAMPLED`` vectors, on which no result depends. Buckets have
no cap: one of many vectors is dealt out in parts, the queries of a bin in blocks. The number of probes is the method's own parameter.

Neighbours come with exact distances, but some may be missing, and a query that meets fewer than ``k`` rows has fewer;
``ivf.recall`` measures how many against an exact search. Rows whose vector is null, of another length or not
finite are left out, in references and queries. Ties go by ``ref_id``; repeated references are each a neighbour, unless
they share an id, of which one is. No references give no neighbours. Columns other than those named are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import _matrix
from .knn import MOST_PARTITIONS, best, knn
from .selection import kept

SEED = 20
#: The width of cells follows the distance of this neighbour, in the mean over about so many rows.
NEAR, DRAWN = 5, 256
#: Vectors of buckets that go together, and queries that one task compares with a bin.
PART, BLOCK = 65_536, 8192
#: Vectors whose buckets tell which go together.
SAMPLED = 1 << 20
#: Rows and queries that are dealt to bins at a time.
STEP = 1024
#: Pairs compared at once.
PAIRS = 1 << 20
#: Projections of a table at most: 3 ** 7 neighbouring cells are ordered for each query.
MOST = 7


@dataclass
class Lsh:
    """``rows`` (of, vector, first, copies: one for each vector), all ``refs`` (ref_id, vector, is_fraud), directions (dims x tables x projections), offsets and the cells' width."""

    rows: DataFrame
    refs: DataFrame
    copies: int
    directions: np.ndarray
    offsets: np.ndarray
    width: float

    def places(self, x: np.ndarray) -> np.ndarray:
        """Projections in cells: (rows, tables, projections); the whole part is the cell."""
        total = np.zeros((len(x), *self.offsets.shape))
        for d in range(x.shape[1]):
            total += x[:, d, None, None] * self.directions[d]
        return total / self.width + self.offsets

    @property
    def plain(self) -> Lsh:
        """What tasks need of it."""
        return Lsh(None, None, 0, self.directions, self.offsets, self.width)

    @property
    def sizes(self) -> DataFrame:
        """``bucket`` and its number ``n`` of rows, each copy of a vector counted."""
        of, dims = self.plain, len(self.directions)

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_buckets(np.floor(of.places(_matrix(b.column("vector"), dims)))).ravel())], ["bucket"])

        return self.refs.select("vector").mapInArrow(file, "bucket long").groupBy("bucket").agg(F.count("*").alias("n"))


def _keys(cells: np.ndarray) -> np.ndarray:
    """Numbers for the table and the first cell of (rows, tables, projections), the first two and so on: (projections, rows, tables). What gives the same last one only shares a bucket."""
    key = np.broadcast_to(np.arange(1, cells.shape[1] + 1, dtype=np.uint64), cells.shape[:2]).copy()
    out = np.zeros((cells.shape[2], *key.shape), np.int64)
    for p in range(cells.shape[2]):
        key = (key ^ np.clip(cells[..., p], -(2.0**62), 2.0**62).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        out[p] = key.view(np.int64)
    return out


def _buckets(cells: np.ndarray) -> np.ndarray:
    """One number for the table and all cells."""
    return _keys(cells)[-1]


def probed(places: np.ndarray, probes: int) -> np.ndarray:
    """Buckets that each row looks into, nearest first: (rows, probes, tables) for ``places`` of (rows, tables, projections)."""
    return np.stack([_buckets(c) for c in _probed(places, probes)], 1).reshape(len(places), -1, places.shape[1])


def _probed(places: np.ndarray, probes: int) -> list[np.ndarray]:
    """Cells of the first, second and further buckets that each row looks into."""
    projections = places.shape[2]
    steps = np.array(list(itertools.product((0, 1, -1), repeat=projections)))
    cells = np.floor(places)
    down = places - cells
    walls = np.stack([np.zeros_like(down), 1 - down, down]) ** 2  # of a step by 0, 1, -1
    far = sum(walls[steps[:, p], :, :, p] for p in range(projections))
    order = np.argsort(far, axis=0, kind="stable")[:probes].transpose(1, 0, 2)
    return [cells + steps[order[:, n]] for n in range(order.shape[1])]


def _usable(rows: DataFrame, key: str, dims: int, *more: str) -> DataFrame:
    vectors = rows.select(key, F.col("vector").cast("array<double>").alias("vector"), *more)
    return vectors.where((F.size("vector") == dims) & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < 1e150)))


def _by_vector(refs: DataFrame, copies: int) -> DataFrame:
    """One row for each vector: a number ``of`` its own, its least id ``first`` (one that is null before all) and the ``copies`` of least id (ref_id, is_fraud), of rows that share an id one."""
    place = F.dense_rank().over(Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("ref_id"))
    least = refs.withColumn("place", place).where(F.col("place") <= copies).groupBy("vector").agg(F.sort_array(F.collect_set(F.struct("ref_id", "is_fraud"))).alias("all"))
    new = lambda x, i: (i == 0) | ~x["ref_id"].eqNullSafe(F.get("all", i - 1)["ref_id"])
    rows = least.select(F.monotonically_increasing_id().alias("of"), "vector", F.filter("all", new).alias("copies"))
    return kept(rows.select("of", "vector", F.coalesce(F.col("copies")[0]["ref_id"], F.lit(-(1 << 63))).alias("first"), "copies"))


def _drawn(rows: DataFrame, n: int, about: int) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("vector"), F.lit(max(1, n // about))) == 0)


def _reach(rows: DataFrame, dims: int) -> float:
    """Mean distance of the ``NEAR``-th neighbour, other than itself, of about ``DRAWN`` vectors among all different ones; 1 where there is none."""
    rows = rows.select(F.col("of").alias("ref_id"), "vector", F.lit(False).alias("is_fraud"))
    drawn = _drawn(rows, rows.count(), DRAWN).select(F.col("ref_id").alias("query_id"), "vector")
    ranked = knn(drawn, rows, NEAR + 1, "scan", dims)
    reach = ranked.where(F.col("rank") == NEAR + 1).agg(F.avg(F.sqrt("d2"))).first()[0]  # one row
    return reach or 1.0


def build(refs: DataFrame, dims: int, tables: int = 6, projections: int = 5, width: float = 2.0, copies: int = 8) -> Lsh:
    """Directions, offsets and width for ``tables`` tables, and the different vectors. Smaller ``width`` or more ``projections`` (7 at most) make smaller buckets."""
    if not 1 <= projections <= MOST:
        raise ValueError(f"projections must be 1 to {MOST}")
    refs = _usable(refs.withColumn("ref_id", F.col("ref_id").cast("long")), "ref_id", dims, "is_fraud")
    rows = _by_vector(refs, copies)
    rng = np.random.default_rng(SEED)
    return Lsh(rows, refs, copies, rng.normal(size=(dims, tables, projections)), rng.uniform(size=(tables, projections)), width * _reach(rows, dims))


def _asked(queries: DataFrame, index: Lsh, dims: int, probes: int) -> DataFrame:
    """``query_id``, ``q`` and the ``buckets`` of all probes."""
    kind = queries.schema["query_id"].dataType.simpleString()
    of = index.plain

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                bucket = probed(of.places(_matrix(b.column("vector"), dims)), probes).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(bucket), pa.list_(pa.int64()))], ["query_id", "q", "buckets"])

    return _usable(queries, "query_id", dims).mapInArrow(probe, f"query_id {kind}, q array<double>, buckets array<long>")


def _counted(asked: DataFrame) -> DataFrame:
    """``bucket`` and how many queries look into it."""
    return asked.select(F.explode(F.array_distinct("buckets")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("asked"))


def compared(queries: DataFrame, index: Lsh, dims: int, probes: int = 24) -> int:
    """Pairs of a query and a row that meet in a search; a pair that meets in several tables counts each time, and so do equal vectors, though they are compared once."""
    return _counted(_asked(queries, index, dims, probes)).join(index.sizes, "bucket").agg(F.sum(F.col("asked") * F.col("n"))).first()[0] or 0


def nearest(q: np.ndarray, asked: np.ndarray, vectors: np.ndarray, cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries and rows, and squared distances: the k nearest of each query row among those of its cell. ``cells`` ascend, equal distances go by position."""
    low, high = np.searchsorted(cells, asked), np.searchsorted(cells, asked, "right")
    total = np.cumsum(high - low)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    start = 0
    while start < len(q):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS, "right")))
        n = (high - low)[start:end]
        who = np.repeat(np.arange(start, end), n)
        row = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + low[who]
        d2 = np.zeros(len(who))
        for d in range(q.shape[1]):
            gap = q[who, d] - vectors[row, d]
            d2 += gap * gap
        order = np.lexsort((row, d2, who))
        order = order[np.arange(len(order)) - np.searchsorted(who, who[order]) < k]
        out.append((who[order], row[order], d2[order]))
        start = end
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 31 bits that are spread evenly."""
    return ((x.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64)


@dataclass
class Layout:
    """Which buckets go together: first cells that are ``split`` further, as they have more than ``PART`` vectors, in how many ``parts`` if they are a whole bucket, and the number of ``bins``."""

    split: np.ndarray
    parts: np.ndarray
    bins: int

    def _at(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.split, key), len(self.split) - 1)
        return at, self.split[at] == key

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shortest run of first cells that is not split, or the bucket, and its parts; for ``_keys`` of cells."""
        if not len(self.split):
            return keys[0], np.ones(keys[0].shape, np.int64)
        group, is_open = keys[-1].copy(), np.ones(keys[0].shape, bool)
        for key in keys[:-1]:
            is_split = self._at(key)[1]
            group[is_open & ~is_split] = key[is_open & ~is_split]
            is_open &= is_split
        at, is_split = self._at(keys[-1])
        return group, np.where(is_open & is_split, self.parts[at], 1)

    def bin(self, group: np.ndarray, part: np.ndarray) -> np.ndarray:
        return _mixed(group + (_mixed(part) << 20)) % self.bins


def _layout(index: Lsh, rows: DataFrame, dims: int) -> Layout:
    of, n = index.plain, rows.count()
    drawn = _drawn(rows, n, SAMPLED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _keys(np.floor(of.places(_matrix(b.column("vector"), dims))))
            for depth, level in enumerate(keys):
                key, some = np.unique(level, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), depth + 1 == len(keys))), pa.array(key), pa.array(some)], ["whole", "key", "some"])

    each = n / max(1, drawn.count())
    sums = drawn.select("vector").mapInArrow(count, "whole boolean, key long, some long").groupBy("whole", "key").agg((F.sum("some") * each).alias("n")).where(F.col("n") > PART)
    large = sorted((r["key"], -(-int(r["n"]) // PART) if r["whole"] else 1) for r in sums.collect())  # at most as many as cells x tables x vectors / PART
    split, parts = np.array(large, np.int64).reshape(-1, 2).T
    tables = index.offsets.shape[0]
    return Layout(np.ascontiguousarray(split), np.ascontiguousarray(parts), int(max(rows.sparkSession.sparkContext.defaultParallelism, -(-2 * n * tables // PART))))


def _routes(layout: Layout, of: Lsh, q: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q``, the bins that they go to and the buckets that they look into there, in order."""
    who, to, cell = [], [], []
    for cells in _probed(of.places(q), probes):
        keys = _keys(cells)
        group, parts = (x.ravel() for x in layout.place(keys))
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)  # all parts of a bucket
        who.append(np.repeat(np.repeat(np.arange(len(q)), keys.shape[2]), parts))
        to.append(layout.bin(np.repeat(group, parts), part))
        cell.append(np.repeat(keys[-1].ravel(), parts))
    who, to, cell = (np.concatenate(c) for c in (who, to, cell))
    order = np.lexsort((cell, to, who))
    who, to, cell = who[order], to[order], cell[order]
    new = np.diff(who, prepend=-1).astype(bool) | np.diff(to, prepend=-1).astype(bool) | (cell != np.roll(cell, 1))
    return who[new], to[new], cell[new]


def _starts(who: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Where another row or bin begins."""
    return np.flatnonzero(np.diff(who, prepend=-1).astype(bool) | np.diff(to, prepend=-1).astype(bool))


def search(queries: DataFrame, index: Lsh, k: int, dims: int, probes: int = 24) -> DataFrame:
    """``query_id, ref_id, d2, is_fraud, rank`` of the k nearest that the probed buckets give."""
    rows = index.rows if k <= index.copies else _by_vector(index.refs, k)
    asking = _usable(queries, "query_id", dims)
    one = kept(asking.select("vector").distinct().select(F.monotonically_increasing_id().alias("query"), "vector"))
    near = _near(one, index, rows, k, dims, probes)
    found = near.join(rows.select("of", "copies"), "of").select("query", "d2", F.explode("copies").alias("copy")).select(F.col("query").alias("query_id"), "copy.*", "d2")
    found = best(_least(found), k).withColumnRenamed("query_id", "query")
    return best(_least(found.join(asking.join(one, "vector").select("query_id", "query"), "query")), k)


def _least(found: DataFrame) -> DataFrame:
    """Of pairs of the same ids the nearest."""
    return found.groupBy("query_id", "ref_id").agg(F.min("d2").alias("d2"), F.min_by("is_fraud", "d2").alias("is_fraud"))


def _near(one: DataFrame, index: Lsh, rows: DataFrame, k: int, dims: int, probes: int) -> DataFrame:
    """``query``, ``of``, ``d2`` of the k nearest vectors of each query, of equally near ones those of least id."""
    layout, of = _layout(index, rows, dims), index.plain

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                who, to, _ = _routes(layout, of, _matrix(whole.slice(start, STEP).column("vector"), dims), probes)
                key, some = np.unique(to[_starts(who, to)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some)], ["bin", "some"])

    blocks = np.zeros(layout.bins, np.int64)
    for r in one.select("vector").mapInArrow(count, "bin long, some long").groupBy("bin").agg(F.sum("some").alias("n")).collect():  # a row for each bin, at most
        blocks[r["bin"]] = -(-r["n"] // BLOCK)
    first = np.cumsum(blocks) - blocks  # bins that no query looks into have no block, and their rows stay where they are

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                b = whole.slice(start, STEP)
                who, to, cell = _routes(layout, of, _matrix(b.column("vector"), dims), probes)
                new = _starts(who, to)
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(cell)).astype(np.int32)), pa.array(cell))
                one, to = pa.array(who[new]), to[new]
                ids = b.column("query").take(one)
                task = first[to] + _mixed(ids.to_numpy()) % blocks[to]
                yield pa.RecordBatch.from_arrays([ids, b.column("vector").take(one), lists, pa.array(task)], ["query", "q", "cells", "task"])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                b = whole.slice(start, STEP)
                keys = _keys(np.floor(of.places(_matrix(b.column("vector"), dims))))
                group, parts = layout.place(keys)
                to = layout.bin(group, _mixed(b.column("of").to_numpy())[:, None] % parts).ravel()
                n = blocks[to]
                task = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[to], n)  # all blocks of a bin
                one = pa.array(np.repeat(np.repeat(np.arange(len(keys[0])), keys.shape[2]), n))
                columns = [b.column(c).take(one) for c in ("of", "first", "vector")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(keys[-1].ravel(), n)), pa.array(task)], ["of", "first", "vector", "cell", "task"])

    def compare(some: pa.Table, among: pa.Table) -> pa.Table:
        among = among.sort_by([("cell", "ascending"), ("first", "ascending"), ("of", "ascending")])
        lists = some.column("cells").combine_chunks()
        who = np.repeat(np.arange(len(some)), lists.value_lengths().to_numpy(zero_copy_only=False))
        q, least, ids = _matrix(some.column("q"), dims), among.column("first").to_numpy(), among.column("of").to_numpy()
        pair, row, d2 = nearest(q[who], lists.flatten().to_numpy(), _matrix(among.column("vector"), dims), among.column("cell").to_numpy(), k)
        who = who[pair]
        order = np.lexsort((ids[row], least[row], d2, who))
        who, row, d2 = who[order], row[order], d2[order]
        new = np.diff(who, prepend=-1).astype(bool) | (ids[row] != np.roll(ids[row], 1))  # a vector may meet a query in several tables
        who, row, d2 = who[new], row[new], d2[new]
        top = np.arange(len(who)) - np.searchsorted(who, who) < k
        who, row, d2 = who[top], row[top], d2[top]
        return pa.table([some.column("query").take(pa.array(who)), pa.array(ids[row]), pa.array(least[row]), pa.array(d2)], names=["query", "of", "first", "d2"])

    asked = one.mapInArrow(ask, "query long, q array<double>, cells array<long>, task long")
    filed = rows.select("of", "first", "vector").mapInArrow(file, "of long, first long, vector array<double>, cell long, task long")
    tasks = int(min(MOST_PARTITIONS, max(1, blocks.sum())))
    each = lambda t: t.repartition(tasks, "task").groupBy("task")
    found = each(asked).cogroup(each(filed)).applyInArrow(compare, "query long, of long, first long, d2 double")
    place = F.dense_rank().over(Window.partitionBy("query").orderBy("d2", "first", "of"))
    return found.withColumn("place", place).where(F.col("place") <= k).dropDuplicates(["query", "of"]).select("query", "of", "d2")
