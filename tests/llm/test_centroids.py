"""Clusters against plain Python integers; intervals against exact distances."""

import hashlib
import math

import numpy as np
import pytest

from vicinity.llm import centroids
from vicinity.llm.centroids import Nearest, cluster, integers, shortlist

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k, rounds):
    """The contract, vector by vector."""
    kept = [(i, [math.floor(64 * x) if abs(x) < 2**50 else 64 * int(x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(x) for x in zip(*of[n], strict=True)] if n in of else c for n, c in enumerate(centres)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = {n: sum(d for _, d, m in found if m == n) for _, _, n in found}
    fits = lambda v: v if v < 1 << 63 else None
    return sorted(((i, n, fits(d), fits(total[n]), fits(sum(total.values())), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, d, n in found), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_plain_integers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=64) * rng.choice([0.1, 3, 900])).tolist()) for i in range(160)]
    rows += [(i, rows[i % 7][1]) for i in range(200, 260)]  # copies of few vectors
    rows += [(5, rows[9][1]), (None, rows[3][1]), (7, None), (8, [1.0] * 63), (9, [1.0] * 65), (10, [None] + [1.0] * 63), (11, [math.inf] * 64), (12, [math.nan] * 64), (13, [])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(cluster(df, 5, 3)) == plain(rows, 5, 3)


def test_ties_and_equal_centroids(spark):
    """Midpoints between centroids and centroids that are equal go to the lower number."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-2, 3, 64) / 64).tolist()) for i in range(60)] + [(100 + i, [0.0] * 64) for i in range(40)]
    assert rows_of(cluster(spark.createDataFrame(rows, SCHEMA), 16, 3)) == plain(rows, 16, 3)


def test_wide_vectors_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) * 10.0 ** (i % 12)).tolist()) for i in range(60)] + [(90, [1.7e308] * 64), (91, [-1e300] * 64), (92, [3.0] * 64)]
    found = rows_of(cluster(spark.createDataFrame(rows, SCHEMA), 6, 2))
    assert found == plain(rows, 6, 2) and any(r[2] is None for r in found)


@pytest.mark.parametrize("scale", [2, 1000, 1 << 26])
def test_intervals_hold_the_nearest(scale):
    rng = np.random.default_rng(scale)
    x = rng.integers(-scale, scale + 1, (400, 64))
    c = rng.integers(-scale, scale + 1, (16, 64))
    x[:16], x[16:32] = c, (c + np.roll(c, 1, 0)) // 2
    d = ((x[:, None, :] - c[None]) ** 2).sum(2)
    able = shortlist(x, c)
    assert able[d == d.min(1)[:, None]].all()
    number, distance = Nearest(c.tolist()).of(x)
    assert number.tolist() == d.argmin(1).tolist() and list(distance) == d.min(1).tolist()
    assert able.sum() < 2 * len(x)  # the shortlist is short


def test_overlaps_are_settled_by_integers():
    """Distances that float32 cannot tell apart: the centroids differ by one in one component of large ones."""
    c = np.full((4, 64), 1 << 25)
    c[1, 0] += 1
    c[3, 5] -= 1
    x = np.concatenate([c, c[:1] + 7])
    assert shortlist(x, c).sum() == x.shape[0] * 4
    d = ((x[:, None, :] - c[None]) ** 2).sum(2)
    assert Nearest(c.tolist()).of(x)[0].tolist() == d.argmin(1).tolist()


def test_edge_cases(spark):
    one = spark.createDataFrame([(4, [-0.001] * 64, 1, "c")] * 3, f"{SCHEMA}, cluster int, x string")
    assert [tuple(r)[:5] for r in cluster(one).collect()] == [(4, 0, 0, 0, 0)] * 3
    none = cluster(one.where("false"))
    assert none.count() == 0 and none.columns == cluster(one).columns
    assert integers(np.array([[-0.001, 0.0, 1.0]]))[0].tolist() == [[-1, 0, 64]]
    assert cluster(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0 and centroids.DIMS == 64


def test_floats_of_the_tables(spark):
    rows = [(i, np.random.default_rng(i).normal(size=64).astype(np.float32).tolist()) for i in range(50)]
    floats = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    assert rows_of(cluster(floats, 4, 3)) == plain(rows, 4, 3)
