"""Aggregates over groups of vectors, as indexes need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import dot, squared_distance
from .selection import nth, sent


def centroids(rows: DataFrame, group: str, dims: int, vector: str = "vector") -> DataFrame:
    """``group``, ``n`` and the mean vector."""
    v = F.col(vector)
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.array(*(F.avg(v[i].cast("double")) for i in range(dims))).alias("centre"))


#: Groups that are few enough to be sent to all tasks.
FEW = 10_000


def _with_centroids(rows: DataFrame, group: str, dims: int, vector: str) -> DataFrame:
    """``rows`` with their group's centroid; a few groups go to the rows, which then need no shuffle."""
    found = centroids(rows, group, dims, vector)
    few = rows.agg(F.approx_count_distinct(group)).first()[0] <= FEW // 2  # the sketch errs by a few percent
    return rows.join(F.broadcast(found) if few else found, group)


def radii(rows: DataFrame, group: str, dims: int, vector: str = "vector") -> DataFrame:
    """Centroids with the largest distance of a member."""
    joined = _with_centroids(rows, group, dims, vector)
    return joined.groupBy(group, "n").agg(F.first("centre").alias("centre"), F.max(F.sqrt(squared_distance(F.col(vector), F.col("centre"), dims))).alias("radius"))


def farthest(rows: DataFrame, group: str, dims: int, vector: str = "vector", key: str = "ref_id") -> DataFrame:
    """The member of each group farthest from its centroid, of equals the one with the least key."""
    joined = _with_centroids(rows, group, dims, vector)
    at = F.struct(squared_distance(F.col(vector), F.col("centre"), dims).alias("d2"), (-F.col(key)).alias("k"))
    return joined.groupBy(group).agg(F.max(at).alias("m")).select(group, (-F.col("m.k")).alias(key), F.col("m.d2").alias("d2"))


def spreads(rows: DataFrame, group: str, dims: int, vector: str = "vector") -> DataFrame:
    """Each group's widest dimension (the first of equals) and its spread."""
    v = F.col(vector)
    wide = rows.groupBy(group).agg(F.array(*((F.max(v[i]) - F.min(v[i])).cast("double") for i in range(dims))).alias("spread"))
    most = F.array_max("spread")
    return wide.select(group, (F.array_position("spread", most) - 1).alias("dim"), most.alias("spread"))


def side(vector: Column, a: Column, b: Column, dims: int) -> Column:
    """True on ``a``'s side of the plane midway between pivots ``a`` and ``b``: one dot product against a constant."""
    return 2 * (dot(vector, b, dims) - dot(vector, a, dims)) <= dot(b, b, dims) - dot(a, a, dims)


def median_halves(rows: DataFrame, group: str, value: Column, key: str = "ref_id") -> DataFrame:
    """``half`` 1 or 2 of each row by the order of (value, key) within its group; the first half has the odd row.

    The row in the middle is found by counts (``selection.nth``), so no group is sorted in one task. Rows without a value are in the first half and do not count.
    """
    valued = rows.withColumn("__value", value)
    middle = nth(valued, group, F.col("__value"), F.ceil(F.col("n") / 2), key)
    edge = middle.select(F.col(group).alias("__g"), F.col("value").alias("__x"), F.col(key).alias("__k"))
    first = (F.col("__value") < F.col("__x")) | ((F.col("__value") == F.col("__x")) & (F.col(key) <= F.col("__k")))
    joined = valued.join(sent(edge), F.col(group) == F.col("__g"), "left")
    return joined.select(*rows.columns, F.when(first | F.col("__value").isNull(), 1).otherwise(2).alias("half"))
