"""Vantage-point trees: exact under three metrics, whatever the tree looks like."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.operators import metric as trees

REFS, QUERIES = "ref_id long, vector array<double>, is_fraud boolean", "query_id long, vector array<double>"
DIMS = 6


def plain(a, b, metric):
    if metric == "manhattan":
        return np.abs(a - b).sum()
    if metric == "euclid":
        return np.sqrt(((a - b) ** 2).sum())
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return np.arccos(np.clip(a @ b / size, -1, 1)) if size else (0.0 if a.any() == b.any() else np.pi / 2)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, DIMS)) * 5
    vectors = np.concatenate([centres[rng.integers(0, 20, 700)] + rng.normal(size=(700, DIMS)) / 4, np.repeat(centres[:1], 350, 0), np.zeros((5, DIMS))])
    asked = np.concatenate([vectors[::60] + 0.01, vectors[:3], centres[:1], np.zeros((1, DIMS))])
    refs = spark.createDataFrame([(i * 3 % 1055, v.tolist(), i % 3 == 0) for i, v in enumerate(vectors)], REFS).repartition(5)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], QUERIES), refs, asked, {i * 3 % 1055: v for i, v in enumerate(vectors)}


def check(found, asked, vectors, k, metric):
    """Distances of every rank equal brute force, each is the row's own, and no row is given twice; of equal vectors least ids come first."""
    rows = {}
    for r in found.collect():
        rows.setdefault(r.query_id, {})[r["rank"]] = r
    assert len(rows) == len(asked)
    for q, of in rows.items():
        real = sorted((plain(asked[q], v, metric), i) for i, v in vectors.items())[:k]
        got = [of[n + 1] for n in range(len(real))]
        assert len(of) == len(real) and len({r.ref_id for r in got}) == len(got)
        np.testing.assert_allclose([r.distance for r in got], [d for d, _ in real], atol=1e-7)
        np.testing.assert_allclose([r.distance for r in got], [plain(asked[q], vectors[r.ref_id], metric) for r in got], atol=1e-7)
        assert [(r.distance, r.ref_id) for r in got] == sorted((r.distance, r.ref_id) for r in got)


@pytest.mark.parametrize("metric", trees.METRICS)
def test_equals_brute_force(data, monkeypatch, metric):
    """With levels of nodes, branches of equal rows dealt out in parts, and queries in blocks."""
    queries, refs, asked, vectors = data
    monkeypatch.setattr(trees, "TASK", 60)
    monkeypatch.setattr(trees, "GRID_QUERIES", 3)
    monkeypatch.setattr(trees, "SOME", 2)
    tree = trees.build(refs, metric, DIMS, leaf_rows=8)
    assert len(tree.levels) >= 2 and tree.rows.count() == len(vectors) and sum(r.n for r in tree.sizes.collect()) == len(vectors)
    assert tree.sizes.where(F.col("n") >= 350).count() == 1  # the equal rows cannot be parted
    check(trees.search(queries, tree, 5, DIMS), asked, vectors, 5, metric)
    check(trees.search(queries, tree, 70, DIMS), asked, vectors, 70, metric)


@pytest.mark.parametrize("metric", trees.METRICS)
def test_columns_and_arrays_agree(spark, data, metric):
    queries, refs, asked, vectors = data
    pairs = queries.select("query_id", F.col("vector").alias("q")).crossJoin(F.broadcast(refs.where("ref_id < 40").select("ref_id", F.col("vector").alias("r"))))
    for r in pairs.select("query_id", "ref_id", trees.distance(F.col("q"), F.col("r"), DIMS, metric).alias("d")).collect():
        wanted = plain(asked[r.query_id], vectors[r.ref_id], metric)
        assert abs(r.d - wanted) < 1e-7 and abs(trees.between(asked[r.query_id], vectors[r.ref_id], metric) - wanted) < 1e-7


def test_prunes(spark):
    """Points of few clusters: a small part of all pairs is compared."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, DIMS)) * 20
    refs = spark.createDataFrame([(i, (centres[i % 60] + rng.normal(size=DIMS)).tolist(), False) for i in range(6000)], REFS)
    queries = spark.createDataFrame([(i, (centres[i % 60] + rng.normal(size=DIMS)).tolist()) for i in range(120)], QUERIES)
    for metric in ("euclid", "manhattan"):
        tree = trees.build(refs, metric, DIMS, leaf_rows=32)
        assert 0 < trees.pairs_compared(queries, tree, 5, DIMS) < 0.05 * 6000 * 120


def test_no_few_and_unsound_rows(spark, data):
    queries, refs, asked, vectors = data
    none = trees.search(queries, trees.build(refs.where("false"), "manhattan", DIMS), 5, DIMS)
    assert none.columns == ["query_id", "ref_id", "distance", "is_fraud", "rank"] and none.count() == 0
    few = trees.build(refs.where("ref_id < 3"), "angular", DIMS)
    assert trees.search(queries, few, 5, DIMS).count() == 3 * len(asked) and trees.search(queries.where("false"), few, 5, DIMS).count() == 0
    odd = [(1, None, True), (2, [1.0, 2.0], True), (3, [float("nan")] * DIMS, True), (4, [None] + [1.0] * 5, True), (5, [float("inf")] * DIMS, True), (6, [1.0] * DIMS, None), (6, [1.0] * DIMS, None)]
    found = trees.search(spark.createDataFrame([r[:2] for r in odd], QUERIES), trees.build(spark.createDataFrame(odd, REFS).withColumn("node", F.lit("x")), "euclid", DIMS), 5, DIMS).collect()
    assert {(r.query_id, r.ref_id) for r in found} == {(6, 6)} and len(found) == 4
    with pytest.raises(ValueError):
        trees.build(refs, "cosine", DIMS)
    with pytest.raises(ValueError):
        trees.search(queries, few, 0, DIMS)
