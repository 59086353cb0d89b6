"""Hash tables with probes: the order of probes, exact where all meet, recall elsewhere, hot buckets."""

import itertools

import numpy as np
import pytest

from vicinity.operators import ivf, lsh
from vicinity.operators.knn import knn

REFS = "ref_id long, vector array<double>, is_fraud boolean"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 8)) * 4
    vectors = np.concatenate([centres[rng.integers(0, 30, 2000)] + rng.normal(size=(2000, 8)), np.repeat(centres[:1], 700, 0)])  # one vector seven hundred times
    refs = spark.createDataFrame([(i, v.tolist(), i % 3 == 0) for i, v in enumerate(vectors)], REFS).repartition(4)
    queries = spark.createDataFrame([(i, (v + 0.05).tolist()) for i, v in enumerate(vectors[::45])], "query_id long, vector array<double>")
    return queries, refs, knn(queries, refs, 5, "scan", 8).persist()


def rows_of(df):
    return sorted((r.query_id, r.ref_id, r["rank"], r.d2, r.is_fraud) for r in df.collect())


def test_probes_are_ordered_by_distance_from_the_walls():
    places = np.random.default_rng(1).normal(size=(20, 2, 3)) * 5
    found = lsh.probed(places, 9)
    for n, t in itertools.product(range(20), range(2)):
        cell, down = np.floor(places[n, t]), places[n, t] % 1
        far = {s: sum({0: 0, 1: 1 - d, -1: d}[x] ** 2 for x, d in zip(s, down, strict=True)) for s in itertools.product((-1, 0, 1), repeat=3)}
        expected = []
        for s in sorted(far, key=far.get)[:9]:
            both = np.zeros((1, 2, 3))
            both[0, t] = cell + s
            expected.append(lsh._buckets(both)[0, t])
        assert found[n, :, t].tolist() == expected
    assert (found[:, 0] == lsh._buckets(np.floor(places))).all()


def test_nearest_equals_a_plain_loop(monkeypatch):
    monkeypatch.setattr(lsh, "PAIRS", 50)
    rng = np.random.default_rng(7)
    q, v = rng.integers(0, 3, (30, 2)).astype(float), rng.integers(0, 3, (90, 2)).astype(float)
    asked, cells = rng.integers(0, 9, 30), np.sort(rng.integers(0, 7, 90))
    found = list(zip(*(c.tolist() for c in lsh.nearest(q, asked, v, cells, 4)), strict=True))
    expected = []
    for i in range(30):
        among = sorted((((q[i] - v[j]) ** 2).sum(), j) for j in range(90) if cells[j] == asked[i])
        expected += [(i, j, d2) for d2, j in among[:4]]
    assert found == expected


def test_exact_where_all_rows_meet(data, monkeypatch):
    """With cells wider than the data every row shares a bucket, hot ones dealt out in parts and queries in blocks."""
    queries, refs, exact = data
    index = lsh.build(refs, 8, tables=2, projections=2, width=100.0)
    assert index.sizes.selectExpr("max(n)").first()[0] == refs.count()
    assert rows_of(lsh.search(queries, index, 5, 8, probes=9)) == rows_of(exact)
    monkeypatch.setattr(lsh, "PART", 90)
    monkeypatch.setattr(lsh, "BLOCK", 7)
    assert rows_of(lsh.search(queries, index, 5, 8, probes=9)) == rows_of(exact)


def test_recall_and_pairs(data):
    queries, refs, exact = data
    index = lsh.build(refs, 8)
    found = lsh.search(queries, index, 5, 8).persist()
    assert ivf.recall(found, exact).first().recall >= 0.95
    assert found.groupBy("query_id", "ref_id").count().where("count > 1").count() == 0
    own = {(r.query_id, r.ref_id): r.d2 for r in exact.collect()}
    assert all(own[key] == r.d2 for r in found.collect() if (key := (r.query_id, r.ref_id)) in own)
    assert lsh.compared(queries, index, 8, 3) < lsh.compared(queries, index, 8) < 0.5 * 6 * queries.count() * refs.count()
    few = ivf.recall(lsh.search(queries, index, 5, 8, probes=1), exact).first().recall
    assert few < ivf.recall(found, exact).first().recall


def test_odd_rows_and_no_rows(spark, data):
    queries, refs, _ = data
    odd = spark.createDataFrame([(1, [1.0, 2.0], True, 5), (2, None, True, 5), (3, [1.0], False, 5), (4, [float("nan"), 0.0], True, 5), (5, [1.0, 2.0], None, 5), (None, [1.0, 2.0], False, 5)], REFS + ", bucket int")
    asks = spark.createDataFrame([("a", [1.0, 2.0], 1), ("b", [1.0, float("inf")], 1), ("c", None, 1)], "query_id string, vector array<double>, cell int")
    found = lsh.search(asks, lsh.build(odd, 2), 5, 2).collect()
    assert {(r.query_id, r.ref_id, r.d2) for r in found} == {("a", 1, 0.0), ("a", 5, 0.0), ("a", None, 0.0)}
    assert lsh.search(queries, lsh.build(refs.where("false"), 8), 5, 8).count() == 0
    assert lsh.search(queries.where("false"), lsh.build(refs, 8), 5, 8).columns == ["query_id", "ref_id", "d2", "is_fraud", "rank"]
    with pytest.raises(ValueError, match="projections"):
        lsh.build(refs, 8, projections=8)


def test_copies_are_indexed_once(spark):
    """Many copies of each vector change neither the width of cells nor the number of vectors that are compared, and each is a neighbour."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(400, 6)).tolist()
    one = spark.createDataFrame([(i, v, i % 3 == 0) for i, v in enumerate(vectors)], REFS).repartition(4)
    many = one.selectExpr("explode(sequence(0, 39)) as copy", "*").selectExpr("ref_id + 1000 * copy as ref_id", "vector", "(ref_id + copy) % 3 = 0 as is_fraud")
    queries = many.where("ref_id % 20 = 0").selectExpr("ref_id as query_id", "transform(vector, x -> x + 0.01D) as vector")
    index, plain = lsh.build(many, 6), lsh.build(one, 6)
    assert index.width == pytest.approx(plain.width) and index.rows.count() == 400
    assert [[c.ref_id for c in r.copies] for r in index.rows.where("first = 7").collect()] == [[7 + 1000 * c for c in range(8)]]
    exact = knn(queries, many, 5, "scan", 6).persist()
    found = lsh.search(queries, index, 5, 6).persist()
    assert ivf.recall(found, exact).first().recall == 1
    assert rows_of(found) == rows_of(exact)
    more = lsh.search(queries.limit(50), index, 30, 6)  # more than the index keeps of a vector
    assert rows_of(more) == rows_of(knn(queries.limit(50), many, 30, "scan", 6))


def test_a_query_goes_once_to_each_bin_and_meets_what_shares_its_buckets(spark, monkeypatch):
    monkeypatch.setattr(lsh, "PART", 40)
    vectors = np.concatenate([np.random.default_rng(2).normal(size=(600, 6)), np.linspace(0, 1e-9, 150)[:, None] * np.ones((150, 6))])  # many in one bucket
    index = lsh.build(spark.createDataFrame([(i, v.tolist(), False) for i, v in enumerate(vectors)], REFS), 6)
    layout = lsh._layout(index, index.rows, 6)
    assert len(layout.split) > 6 and layout.parts.max() > 1 and layout.bins > 100
    keys = lsh._keys(np.floor(index.places(vectors)))
    group, parts = layout.place(keys)
    homes = layout.bin(group, lsh._mixed(np.arange(len(vectors)))[:, None] % parts)
    q = vectors[::25] + 0.02
    who, to, cell = lsh._routes(layout, index, q, 24)
    asked = lsh.probed(index.places(q), 24).reshape(len(q), -1)
    met = set(zip(who.tolist(), to.tolist(), cell.tolist(), strict=True))
    assert len(met) == len(who)
    buckets = keys[-1]
    for n in range(len(q)):
        shared = np.argwhere(np.isin(buckets, asked[n]))
        assert all((n, int(homes[r, t]), int(buckets[r, t])) in met for r, t in shared)
    wide = lsh.Layout(layout.split[:0], layout.parts[:0], 10_000)
    who, to, cell = lsh._routes(wide, index, q, 24)
    assert len(lsh._starts(who, to)) < len(who) / 4 and {int(c) for c in cell} == set(asked.ravel().tolist())
