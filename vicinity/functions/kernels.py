"""Distances of vector columns, unrolled so that they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(terms: list[Column]) -> Column:
    """Added from left to right, which fixes the last bit."""
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def _pairs(a: Column, b: Column, dims: int) -> list[tuple[Column, Column]]:
    return [(a[i].cast("double"), b[i].cast("double")) for i in range(dims)]


def squared_distance(a: Column, b: Column, dims: int) -> Column:
    return _total([(x - y) * (x - y) for x, y in _pairs(a, b, dims)])


def distance(a: Column, b: Column, dims: int) -> Column:
    return F.sqrt(squared_distance(a, b, dims))


def dot(a: Column, b: Column, dims: int) -> Column:
    return _total([x * y for x, y in _pairs(a, b, dims)])


def squared_norm(a: Column, dims: int) -> Column:
    return dot(a, a, dims)


def manhattan(a: Column, b: Column, dims: int) -> Column:
    return _total([F.abs(x - y) for x, y in _pairs(a, b, dims)])


def cosine_distance(a: Column, b: Column, dims: int) -> Column:
    """1 less the cosine; null where a vector is zero."""
    size = F.sqrt(squared_norm(a, dims) * squared_norm(b, dims))
    return 1 - F.try_divide(dot(a, b, dims), size)
