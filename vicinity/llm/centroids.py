"""Clustering of integer vectors around centroids: float32 screening, exact decisions.

A kept vector has exactly ``DIMS`` components, none null or not finite; component x becomes floor(64 x). The
distance to a centroid is, apart from the vector's own square, the centroid's square less twice a dot product.
All dot products of a batch come from one float32 matrix product. In any order of summation, fused or not, such
a product of n terms errs by at most g * sum |x_i c_i| with g = n u / (1 - n u), u = 2^-24; two more roundings
stand for the conversion of the integers, and sum |x_i c_i| is at most the product of the norms. That gives every
distance an interval. A centroid whose interval begins above the least upper end is not nearest; where one is left it
is taken, and where intervals overlap the distances are computed again with integers, the lower number winning ties.

Centroids are sums of integers, added exactly in tasks and then by Spark as decimals, so they do not depend on the
order of rows. The driver sees the sums of ``k`` centroids in each round and never a vector.

Components beyond ``NARROW`` (vectors of ordinary embeddings are far below) take Python integers in all steps, so
results stay exact; a distance or an inertia that no long can hold is null. Fewer than ``k`` kept vectors give as many
centroids; none give an empty result. Vectors that are not kept give no row. Repeated rows count as often as they
occur; of equal hashes (repeated ids) the vector that is less in order of components starts first. A null id is hashed
as an empty one and comes back null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces

DIMS, SCALE = 64, 64
#: Integers up to this size have squared distances that an int64 holds: 64 * (2^27)^2 = 2^60.
NARROW = 1 << 26
#: Relative error of a float32 dot product of DIMS rounded terms, with room to spare: 66 u / (1 - 66 u) < 70 u.
ERROR = 70 * 2.0**-24
#: Wide integers are summed in signed digits of so many bits.
LIMB = 30


def kept(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``x``, the doubles of each vector that is clustered."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == DIMS) & whole)


def integers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(64 x) as int64, and which rows are too wide for that (their int64 values mean nothing)."""
    wide = (np.abs(x) >= NARROW / SCALE).any(1)
    return np.floor(np.where(wide[:, None], 0.0, x) * SCALE).astype(np.int64), wide


def wide_integers(row: np.ndarray) -> list[int]:
    """floor(64 x) as Python integers; a double of 2^53 or more is a whole number."""
    return [int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE) for v in row.tolist()]


def shortlist(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each int64 row, which centroids may be nearest, by float32 intervals."""
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    norm = lambda v: np.sqrt((v.astype(np.float64) ** 2).sum(1)) * (1 + 2.0**-40)
    square = (centroids**2).sum(1).astype(np.float64)
    both = norm(x)[:, None] * norm(centroids)[None, :]
    middle = square[None, :] - 2 * product
    radius = 2 * ERROR * both + 2.0**-49 * (square[None, :] + both)
    return middle - radius <= (middle + radius).min(1)[:, None]


class Nearest:
    """The nearest of a few centroids (lists of Python integers) and the exact squared distance to it."""

    def __init__(self, centroids: list[list[int]]) -> None:
        self.centroids = centroids
        narrow = [max(map(abs, c)) <= NARROW for c in centroids]
        self.narrow = np.array([i for i, ok in enumerate(narrow) if ok], np.int64)
        self.wide = [i for i, ok in enumerate(narrow) if not ok]
        self.values = np.array([centroids[i] for i in self.narrow], np.int64).reshape(-1, DIMS)

    def slow(self, row: list[int], among: list[int]) -> tuple[int, int]:
        d, i = min((sum((a - b) ** 2 for a, b in zip(row, self.centroids[i], strict=True)), i) for i in among)
        return i, d

    def exact(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        return ((x - self.values[which]) ** 2).sum(1)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """Number of the nearest centroid and squared distance of int64 rows."""
        if not len(self.narrow):
            found = [self.slow(row, self.wide) for row in x.tolist()]
            return np.array([i for i, _ in found], np.int64), [d for _, d in found]
        able = shortlist(x, self.values)
        best = able.argmax(1)
        distance = self.exact(x, best)
        open_rows = np.flatnonzero(able.sum(1) > 1)
        if len(open_rows):
            rows, which = np.nonzero(able[open_rows])
            again = self.exact(x[open_rows[rows]], which)
            order = np.lexsort((which, again, rows))
            first = order[np.unique(rows[order], return_index=True)[1]]
            best[open_rows], distance[open_rows] = which[first], again[first]
        number = self.narrow[best]
        if self.wide:
            rivals = [min((d, i), self.slow(row, self.wide)[::-1]) for row, d, i in zip(x.tolist(), distance.tolist(), number.tolist(), strict=True)]
            return np.array([i for _, i in rivals], np.int64), [d for d, _ in rivals]
        return number, distance


def _doubles(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)


def _assign(batches: Iterator[pa.RecordBatch], nearest: Nearest) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, dict[int, list[int]], list]]:
    """Batches with their integers, centroid numbers, wide rows and distances."""
    for b in pieces(batches, 4096):
        doubles = _doubles(b)
        x, wide = integers(doubles)
        number, distance = nearest.of(x)
        rows = {int(i): wide_integers(doubles[i]) for i in np.flatnonzero(wide)}
        if rows:
            distance = list(distance)
            for i, row in rows.items():
                number[i], distance[i] = nearest.slow(row, list(range(len(nearest.centroids))))
        yield b, x, number, rows, distance


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """Signed digits of a Python integer, least first."""
    sign, value, at = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield at, sign * (value & (1 << LIMB) - 1)
        value, at = value >> LIMB, at + 1


def sums(vectors: DataFrame, centroids: list[list[int]]) -> tuple[dict[int, list[int]], dict[int, int]]:
    """Exact componentwise sums and counts of the vectors nearest to each centroid that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        total, count, digits = np.zeros((k, DIMS), np.int64), np.zeros(k, np.int64), {}
        for _, x, number, rows, _ in _assign(batches, Nearest(centroids)):
            count += np.bincount(number, minlength=k)
            for i, row in rows.items():
                x[i] = 0
                for at, value in enumerate(row):
                    for limb, digit in _limbs(value):
                        key = (int(number[i]), at, limb)
                        digits[key] = digits.get(key, 0) + digit
            for c in np.unique(number):
                total[c] += x[number == c].sum(0)
        found = [(c, at, 0, int(total[c, at])) for c in np.flatnonzero(count).tolist() for at in range(DIMS)]
        found += [(c, -1, 0, int(count[c])) for c in np.flatnonzero(count).tolist()] + [(*key, digit) for key, digit in digits.items()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], ["c", "at", "limb", "total"])

    parts = vectors.mapInArrow(run, "c long, at long, limb long, total long")
    added = parts.groupBy("c", "at", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # k * (DIMS + 1) rows and a few for wide ones
    total: dict[int, list[int]] = {}
    count: dict[int, int] = {}
    for r in added:
        if r["at"] < 0:
            count[r["c"]] = int(r["total"])
        else:
            total.setdefault(r["c"], [0] * DIMS)[r["at"]] += int(r["total"]) << LIMB * r["limb"]
    return total, count


def first_centroids(vectors: DataFrame, k: int) -> list[list[int]]:
    """The ``k`` vectors whose ids have the least hashes, in that order."""
    at = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [wide_integers(np.array(r["x"])) for r in vectors.orderBy(at, "x").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every kept vector.

    ``k`` bounds what the driver and each task hold; ``embedding`` is an array of numbers.
    """
    rows = kept(vectors)
    centroids = first_centroids(rows, k)
    for _ in range(rounds if centroids else 0):
        total, count = sums(rows, centroids)
        centroids = [[s // count[c] for s in total[c]] if c in count else old for c, old in enumerate(centroids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, number, _, distance in _assign(batches, Nearest(centroids)):
            fit = distance if isinstance(distance, np.ndarray) else [int(d) if d < 1 << 63 else None for d in distance]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(fit, pa.int64())], ["vec_id", "cluster", "distance"])

    placed = cut(rows.mapInArrow(run, "vec_id long, cluster int, distance long"))
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    of_cluster = {r["cluster"]: r["total"] for r in placed.groupBy("cluster").agg(whole.alias("total")).collect()}  # at most k rows
    inertia = None if None in of_cluster.values() else sum(map(int, of_cluster.values()))
    digest = {c: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for c, v in enumerate(centroids)}

    def by_cluster(values: dict, kind: str) -> Column:
        pairs = [F.lit(v).cast(t) for c, value in sorted(values.items()) for v, t in ((c, "int"), (value, kind))]
        return F.element_at(F.create_map(*pairs), F.col("cluster")) if pairs else F.lit(None).cast(kind)

    long = lambda v: None if v is None or v >= 1 << 63 else int(v)
    return placed.select(
        "vec_id", "cluster", "distance", by_cluster({c: long(v) for c, v in of_cluster.items()}, "long").alias("cluster_inertia"),
        F.lit(long(inertia)).cast("long").alias("inertia"), by_cluster(digest, "string").alias("centroid_sha256"),
    )
