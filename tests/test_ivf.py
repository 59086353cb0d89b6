"""Inverted lists with product quantisation: exact at the limit, recall elsewhere."""

import numpy as np
import pytest

from vicinity.operators import ivf
from vicinity.operators.knn import knn

REFS = "ref_id long, vector array<double>, is_fraud boolean"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 10)) * 6
    vectors = np.concatenate([centres[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 10)), np.repeat(centres[:1], 500, 0)])  # one vector five hundred times
    refs = spark.createDataFrame([(i, v.tolist(), i % 3 == 0) for i, v in enumerate(vectors)], REFS).repartition(4)
    queries = spark.createDataFrame([(i, (v + 0.1).tolist()) for i, v in enumerate(vectors[::40])], "query_id long, vector array<double>")
    return queries, refs, knn(queries, refs, 5, "scan", 10).persist()


def rows_of(df):
    return sorted((r.query_id, r.ref_id, r["rank"], r.d2) for r in df.collect())


def test_exact_where_all_is_probed(data, monkeypatch):
    """Also with lists dealt out in parts and queries in blocks."""
    queries, refs, exact = data
    index = ivf.build(refs, 10, lists=6, parts=3)
    assert index.rows.count() == refs.count() == sum(r.n for r in index.sizes.collect())
    assert rows_of(ivf.search(queries, index, 5, 10, probes=6, rerank=5000)) == rows_of(exact)
    monkeypatch.setattr(ivf, "PART", 90)
    monkeypatch.setattr(ivf, "BLOCK", 7)
    assert rows_of(ivf.search(queries, index, 5, 10, probes=9, rerank=5000)) == rows_of(exact)


def test_recall_with_few_probes(data):
    queries, refs, exact = data
    index = ivf.build(refs, 10, parts=5)
    found = ivf.recall(ivf.search(queries, index, 5, 10, probes=4, rerank=40), exact).first()
    assert len(index.centres) == 44 and found.queries == 50 and found.recall >= 0.9


def test_no_and_few_references(data):
    queries, refs, _ = data
    none = ivf.search(queries, ivf.build(refs.where("false"), 10), 5, 10)
    assert none.count() == 0 and none.columns == ["query_id", "ref_id", "d2", "is_fraud", "rank"]
    assert ivf.search(queries, ivf.build(refs.where("ref_id < 3"), 10), 5, 10).count() == 150
    assert ivf.search(queries.where("false"), ivf.build(refs, 10, lists=4), 5, 10).count() == 0


def test_bins_hold_bounded_rows_and_all_lists(monkeypatch):
    monkeypatch.setattr(ivf, "PART", 100)
    sizes = np.random.default_rng(4).integers(0, 60, 200)
    sizes[[3, 50, 199]] = 1000, 101, 250
    first, takes = ivf._bins(sizes)
    rows = np.zeros(int((first + takes).max()))
    for n, f, t in zip(sizes, first, takes, strict=True):
        rows[f : f + t] += n / t
    assert rows.max() <= 100 and rows.sum() == pytest.approx(sizes.sum()) and len(rows) <= 2 * sizes.sum() / 100
    assert takes[[3, 50, 199]].tolist() == [10, 2, 3]


def test_least_takes_the_first_of_equal_ones():
    guess = np.random.default_rng(5).integers(0, 9, (50, 40)).astype(float)
    for n in (1, 7, 39, 40):
        assert (ivf._least(guess, n) == np.sort(np.argsort(guess, axis=1, kind="stable")[:, :n], axis=1)).all()


def test_same_rows_as_query_by_query_and_as_many_tasks_as_bins(data, monkeypatch):
    """Few lists and rows, in bins and blocks of a few: what a plain loop over queries and lists finds; tasks follow the number of bins."""
    queries, refs, _ = data
    index = ivf.build(refs, 10, lists=12, parts=5)
    lists = {}
    for r in index.rows.orderBy("ref_id").collect():
        lists.setdefault(r.list, []).append((r.ref_id, np.array(r.vector), list(r.codes)))
    wanted = []
    for q in queries.collect():
        x, met = np.array(q.vector), []
        for one in np.argsort(((index.centres - x) ** 2).sum(1))[:5]:
            left = ivf._slices((x - index.centres[one])[None], 5)[:, 0]
            guess = [sum(((index.words[p][c] - left[p]) ** 2).sum() for p, c in enumerate(codes)) for _, _, codes in lists.get(one, [])]
            met += [(float(((lists[one][n][1] - x) ** 2).sum()), lists[one][n][0]) for n in np.argsort(np.round(guess, 9), kind="stable")[:20]]
        wanted += [(q.query_id, ref, n + 1) for n, (_, ref) in enumerate(sorted(met)[:5])]
    monkeypatch.setattr(ivf, "BLOCK", 20)
    found = ivf.search(queries, index, 5, 10, probes=5, rerank=20)
    assert [r[:3] for r in rows_of(found)] == sorted(wanted)
    monkeypatch.setattr(ivf, "PART", 1000)
    found = ivf.search(queries, index, 5, 10, probes=5, rerank=20)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()  # else small shuffles are put together into a few long tasks
