"""Neighbours by every strategy, decisions, indexes, evaluation and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.functions.features import vectorize
from vicinity.operators import aggregates, cells, decide, evaluate
from vicinity.operators import knn as search
from vicinity.operators.knn import STRATEGIES, knn
from vicinity.sources import generate
from vicinity.sources.index import ensure_index, index_ready, open_index
from vicinity.streaming.score import parquet_sink, score_stream

NEIGHBOURS = "query_id long, vector array<double>"
REFS = "ref_id long, vector array<double>, is_fraud boolean"


def squared(v, w):
    total = 0.0  # not sum(), which corrects rounding errors
    for a, b in zip(v, w, strict=True):
        total += (a - b) * (a - b)
    return total


def plain(queries, refs, k):
    out = []
    for q, v in queries:
        ranked = sorted((squared(v, w), r) for r, w, _ in refs)[:k]
        out += [(q, r, n + 1) for n, (_, r) in enumerate(ranked)]
    return sorted(out)


def rows_of(found):
    return sorted((r.query_id, r.ref_id, r["rank"]) for r in found.collect())


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    vectors = np.round(rng.random((300, 14)), 1)
    vectors[:, 9:12] = vectors[:, 9:12] > 0.5
    vectors[::4, 5:7] = -1
    vectors[50:90] = vectors[7]  # ties at the k-th place
    refs = [(i, v.tolist(), i % 3 == 0) for i, v in enumerate(vectors)]
    queries = [(i, v.tolist()) for i, v in enumerate(vectors[:25])] + [(100, [0.5] * 14)]
    return queries, refs, spark.createDataFrame(queries, NEIGHBOURS), spark.createDataFrame(refs, REFS).repartition(5)


@pytest.mark.parametrize("strategy", [*STRATEGIES, "AUTO", "no such"])
@pytest.mark.parametrize("k", [1, 5])
def test_strategies_equal_a_plain_loop(data, strategy, k):
    queries, refs, q, r = data
    assert rows_of(knn(q, r, k, strategy)) == plain(queries, refs, k)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_few_and_no_references(spark, data, strategy):
    queries, refs, q, r = data
    assert rows_of(knn(q, r.where("ref_id < 3"), 5, strategy)) == plain(queries, refs[:3], 5)
    assert knn(q, r.where("false"), 5, strategy).count() == 0
    assert knn(q.where("false"), r, 5, strategy).count() == 0
    votes = decide.vote(q, knn(q, r.where("false"), 5, strategy))
    assert {tuple(x)[1:] for x in decide.decide(votes).collect()} == {(0.0, True)}


@pytest.mark.parametrize("strategy", ["scan", "brute", "keyed"])
def test_queries_in_several_blocks(data, monkeypatch, strategy):
    queries, refs, q, r = data
    monkeypatch.setattr(search, "BLOCK", 7)
    monkeypatch.setattr(search, "BATCH", 11)
    monkeypatch.setattr(search, "GRID_QUERIES", 9)
    monkeypatch.setattr(search, "GRID_REFS", 70)
    assert rows_of(knn(q, r, 5, strategy)) == plain(queries, refs, 5)


@pytest.mark.parametrize("kind", ["cells", "boxes"])
def test_queries_of_one_cell_are_dealt_out(data, monkeypatch, kind):
    queries, refs, q, r = data
    monkeypatch.setattr(cells, "GRID_QUERIES", 4)
    monkeypatch.setattr(cells, "TASK", 50)
    assert rows_of(cells.search(q, cells.build(r, kind, leaf_rows=20), 5, 14)) == plain(queries, refs, 5)


@pytest.mark.parametrize(("kind", "gather"), [("cells", 150)])
def test_trees_of_many_levels(data, monkeypatch, kind, gather):
    """Nodes split by aggregations over all rows, equal rows dealt out in parts, and routes over ancestors of branches."""
    queries, refs, q, r = data
    for name, value in (("GATHER", gather), ("TASK", 12), ("SENT", 8), ("LEVELS", 5)):
        monkeypatch.setattr(cells, name, value)
    index = cells.build(r, kind, leaf_rows=5)
    found = index.rows.groupBy("branch", "leaf").agg(F.count("*").alias("n"), F.countDistinct("vector").alias("different")).collect()
    assert sum(b.n for b in index.branches.collect()) == len(refs) and len(found) > 40 and sum(f.n for f in found if f.n <= 5 or f.different == 1) > 250
    assert cells._routes(index, 14).depth == 3 and index.branches.count() > cells.SENT
    assert rows_of(cells.search(q, index, 5, 14)) == plain(queries, refs, 5)


def test_auto_follows_the_index_and_the_number_of_queries(data, monkeypatch):
    _, _, q, r = data
    assert search.chosen(q, "auto") == "scan" and search.chosen(q, "auto", cells.build(r, "boxes")) == "boxes" and search.chosen(q, "Keyed") == "keyed"
    monkeypatch.setattr(search, "BLOCK", 7)
    assert search.chosen(q, "auto") == search.chosen(q, "no such") == "boxes"


def test_fifty_thousand_queries(spark, monkeypatch):
    """No query reaches the driver; the answers are those of the cells."""
    refs, queries = generate.generate_references(spark, 1500, 42, 0.35).persist(), vectorize(generate.generate_payloads(spark, 50_000, 7, 0.47)).persist()
    monkeypatch.setattr(search, "_sent", None)
    total = lambda found: found.agg(F.count("*"), F.sum("ref_id"), F.sum(F.round("d2", 9))).first()
    a, b = total(knn(queries, refs, strategy="scan")), total(knn(queries, refs, strategy="cells", index=cells.build(refs, "cells", leaf_rows=100)))
    assert a[0] == b[0] == 250_000 and a[1] == b[1] and a[2] == pytest.approx(b[2])


def test_k_must_be_positive(data):
    with pytest.raises(ValueError):
        knn(data[2], data[3], 0)
    with pytest.raises(ValueError):
        knn(data[2], data[3], 5, "keyed", dims=3)


def test_small_example(spark):
    refs = [(1, [0.01, 0.08, 0.05], False), (2, [0.8, 1.0, 1.0], True), (3, [0.1, 0.05, 0.1], False), (4, [0.95, 0.9, 1.0], True), (5, [0.7, 0.95, 0.8], True), (6, [0.3, 0.2, 0.4], False)]
    q, r = spark.createDataFrame([(0, [1.0, 0.96, 0.96])], NEIGHBOURS), spark.createDataFrame(refs, REFS)
    near = knn(q, r, 3, dims=3)
    assert [x.ref_id for x in near.orderBy("rank").collect()] == [4, 2, 5]
    assert tuple(decide.analyze(q, r, 3, dims=3).first()) == (0, 1.0, False)


def test_generated_data_by_all_strategies(spark):
    refs = generate.generate_references(spark, 3000, 42, 0.35).persist()
    queries = vectorize(generate.generate_payloads(spark, 60, 7, 0.47)).persist()
    index = {kind: cells.build(refs, kind, leaf_rows=100) for kind in ("cells", "boxes")}
    expected = rows_of(knn(queries, refs, strategy="brute"))
    for strategy in STRATEGIES:
        assert rows_of(knn(queries, refs, strategy=strategy, index=index.get(strategy))) == expected
    near = generate.near_references(refs, 20, 0.0)
    found = knn(near, refs, 1).select("query_id", "ref_id", "d2").collect()
    assert len(found) == 20 and all(r.d2 == 0 for r in found)


def test_decision_at_the_edge(spark):
    votes = spark.createDataFrame([(1, 3, 5), (2, 2, 5), (3, 0, 0), (4, 5, 5)], "query_id long, frauds long, total long")
    assert {r.query_id: (r.fraud_score, r.approved) for r in decide.decide(votes).collect()} == {1: (0.6, False), 2: (0.4, True), 3: (0.0, True), 4: (1.0, False)}
    assert {r.query_id: r.approved for r in decide.decide(votes, 0.4).collect()} == {1: False, 2: False, 3: True, 4: False}


def test_index_on_disk(spark, data, tmp_path):
    queries, refs, q, r = data
    path = str(tmp_path / "index")
    assert not index_ready(spark, path)
    with pytest.raises(ValueError):
        open_index(spark, path)
    for kind in ("cells", "boxes"):
        index = ensure_index(r, path, kind, leaf_rows=40)
        assert index_ready(spark, path) and rows_of(knn(q, r, 5, kind, index=index)) == plain(queries, refs, 5)
    at = [p.stat().st_mtime_ns for p in (tmp_path / "index" / "meta").glob("*.parquet")]
    ensure_index(r, path, "boxes", leaf_rows=40)
    assert at == [p.stat().st_mtime_ns for p in (tmp_path / "index" / "meta").glob("*.parquet")]
    ensure_index(r.where("ref_id < 100"), path, "boxes", leaf_rows=40)
    assert open_index(spark, path).rows.count() == 100


def test_a_crash_leaves_the_version_before(spark, data, tmp_path, monkeypatch):
    from vicinity.sources import index as store

    queries, refs, q, r = data
    path = str(tmp_path / "index")
    ensure_index(r, path, leaf_rows=40)
    few = r.where("ref_id < 100")
    monkeypatch.setattr(store, "fingerprint", lambda rows: (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(OSError):
        store.write_index(cells.build(few, "cells", leaf_rows=40), few, path, 40, 14)  # rows and branches are there, the description is not
    monkeypatch.undo()
    assert index_ready(spark, path) and rows_of(knn(q, r, 5, index=open_index(spark, path))) == plain(queries, refs, 5)
    folder = store.describe(spark, path)["folder"]
    for part in list((tmp_path / "index" / folder / "rows").rglob("*.parquet"))[:1]:
        part.unlink()
    assert not index_ready(spark, path)
    ensure_index(r, path, leaf_rows=40)
    assert index_ready(spark, path)


def test_one_builder_at_a_time(spark, tmp_path, monkeypatch):
    import threading
    import time

    from vicinity.sources import index as store

    path, seen = str(tmp_path / "index"), []

    def work(n):
        with store.lock(spark, path):
            seen.append(n)
            time.sleep(0.3)
            seen.append(n)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(3)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert seen[::2] == seen[1::2]
    (tmp_path / "index" / "lock").write_text("")
    monkeypatch.setattr(store, "LOCK_SECONDS", -1)
    work(9)
    assert seen[-2:] == [9, 9]


def test_bounds_hold_their_rows(data, monkeypatch):
    monkeypatch.setattr(cells, "TASK", 60)
    for kind in ("cells", "boxes"):
        index = cells.build(data[3], kind, leaf_rows=30)
        bounds = {r.branch: r for r in index.branches.collect()}
        assert sum(b.n for b in bounds.values()) == 300 and len(bounds) > 1
        for r in index.rows.collect():
            b = bounds[r.branch]
            if kind == "cells":
                assert np.linalg.norm(np.array(r.vector) - np.array(b.centre)) <= b.radius + 1e-9
            else:
                assert all(lo <= x <= hi for lo, x, hi in zip(b.lo, r.vector, b.hi, strict=True))


def test_group_aggregates(spark):
    rows = spark.createDataFrame([(1, "a", [0.0, 0.0]), (2, "a", [2.0, 0.0]), (3, "a", [4.0, 1.0]), (4, "b", [1.0, 1.0])], "ref_id long, g string, vector array<double>")
    assert {r.g: (r.n, r.centre) for r in aggregates.centroids(rows, "g", 2).collect()}["a"] == (3, [2.0, pytest.approx(1 / 3)])
    assert {r.g: r.ref_id for r in aggregates.farthest(rows, "g", 2).collect()} == {"a": 3, "b": 4}
    assert {r.g: (r.dim, r.spread) for r in aggregates.spreads(rows, "g", 2).collect()} == {"a": (0, 4.0), "b": (0, 0.0)}
    sides = rows.select(aggregates.side(F.col("vector"), F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(4.0), F.lit(0.0)), 2)).collect()
    assert [s[0] for s in sides] == [True, True, False, True]
    assert [r.half for r in aggregates.median_halves(rows, "g", F.col("vector")[0]).orderBy("ref_id").collect()] == [1, 1, 2, 1]


@pytest.mark.parametrize(
    ("fp", "fn", "err", "latency", "expected"),
    [
        (0, 0, 0, 1, (3000, 3000, 6000)), (5, 5, 0, 3, (2522.88, 2001.27, 4524.15)), (0, 0, 0, 100, (1000, 3000, 4000)), (30, 20, 0, 10, (2000, 1157.02, 3157.02)), (100, 50, 0, 300, (522.88, 581.13, 1104.01)),
        (500, 250, 0, 200, (698.97, -327.12, 371.85)), (500, 300, 0, 10, (2000, -3000, -1000)), (0, 0, 5000, 60000, (-3000, -3000, -6000)), (0, 0, 0, 0, (0, 3000, 3000)),
    ],
)
def test_scores(spark, fp, fn, err, latency, expected):
    right = 5000 - fp - fn - err
    row = evaluate.detection_score(spark.createDataFrame([(right, 0, fp, fn, err, float(latency))], "tp long, tn long, fp long, fn long, err long, p99 double")).first()
    assert (row.p99_score, row.detection_score, row.final_score) == pytest.approx(expected, abs=0.006)


def test_confusion_statistics_and_ramp(spark):
    rows = spark.createDataFrame([(False, False), (True, True), (False, True), (True, False), (None, True), (True, False)], "approved boolean, expected_approved boolean")
    assert tuple(evaluate.confusion(rows).first()) == (1, 1, 1, 2, 1)
    assert tuple(evaluate.detection_score(evaluate.confusion(rows.where("false")).withColumn("p99", F.lit(5.0))).select("epsilon", "failure_rate").first()) == (0.0, 0.0)
    found = evaluate.set_statistics(spark.createDataFrame([(0.6, False), (0.2, True), (1.0, False)], "fraud_score double, approved boolean")).first()
    assert (found.total, found.fraud_count, found.edge_case_count, found.fraud_rate) == (3, 2, 1, 0.6667)
    assert evaluate.ramp(spark.createDataFrame([(1, 120, 900)], "stage int, duration int, target int"), 1).first().cumulative == 54060
    values = spark.createDataFrame([(float(i),) for i in range(1001)], "v double")
    assert evaluate.p99(values, "v").first().p99 == 990.0 and abs(evaluate.p99(values, "v", True).first().p99 - 990) <= 1
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c")], "k long, v string")
    assert sorted(map(tuple, evaluate.merge_results(old, new, ["k"]).collect())) == [(1, "a"), (2, "c")]


def test_stream_equals_batch(spark, tmp_path):
    from vicinity.sources import payloads

    rows = generate.generate_payloads(spark, 80, 3, 0.4).drop("profile", "coin")
    broken = rows.limit(1).withColumn("id", F.lit(""))
    rows.unionByName(broken).repartition(4).write.option("ignoreNullFields", "false").json(str(tmp_path / "in"))
    refs = generate.generate_references(spark, 500, 42, 0.35).persist()
    rejected = []
    stream = payloads.stream_payloads(spark, str(tmp_path / "in"), 2)
    score_stream(stream, refs, parquet_sink(str(tmp_path / "out")), str(tmp_path / "state"), rejects=lambda bad, n: rejected.extend(bad.collect())).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, decide.score(rows, refs).collect()))
    assert [r.errors for r in rejected] == [["id is blank"]]
    labelled = generate.labelled_set(rows, decide.score(rows, refs))
    payloads.write_test_set(labelled, str(tmp_path / "set"))
    assert payloads.read_test_set(spark, str(tmp_path / "set")).count() == 80


@pytest.mark.parametrize("strategy", ["scan", "keyed"])
def test_more_queries_than_a_block_are_not_compared_with_all(data, monkeypatch, strategy):
    queries, refs, q, r = data
    monkeypatch.setattr(search, "BLOCK", 7)
    monkeypatch.setattr(search, "scan", None)
    assert rows_of(knn(q, r, 5, strategy)) == plain(queries, refs, 5)


def test_wide_queries_in_several_blocks(data, monkeypatch):
    queries, refs, q, r = data
    for name, value in (("BLOCK", 7), ("GRID_QUERIES", 9), ("GRID_REFS", 70), ("PRUNED", 3)):
        monkeypatch.setattr(search, name, value)
    assert rows_of(knn(q, r, 5, "scan")) == plain(queries, refs, 5)


@pytest.mark.parametrize("strategy", ["scan", "keyed", "cells", "boxes"])
def test_equal_queries_are_searched_once(spark, data, monkeypatch, strategy):
    """Also with repeated references, of which the k of least id may be near."""
    queries, refs, *_ = data
    many = [(i + 1000 * n, v) for n in range(4) for i, v in queries]
    copies = [(i + 1000 * n, v, f) for n in range(4) for i, v, f in refs]
    q, r = spark.createDataFrame(many, NEIGHBOURS), spark.createDataFrame(copies, REFS)
    met, inner = [], search._found
    monkeypatch.setattr(search, "BLOCK", 30)
    monkeypatch.setattr(search, "_found", lambda some, among, *more: (met.append((some.count(), among.count())), inner(some, among, *more))[1])
    assert rows_of(knn(q, r, 5, strategy)) == plain(many, copies, 5)
    different = len({tuple(v) for _, v, _ in refs})
    assert met == [(len({tuple(v) for _, v in queries}), min(5, 4) * (different - 1) + 5)]


@pytest.mark.parametrize("kind", ["cells", "boxes"])
def test_the_upper_part_needs_no_pass_for_each_level(data, monkeypatch, kind):
    queries, refs, q, r = data
    for name, value in (("GATHER", 60), ("TASK", 20), ("_box_sides", None), ("_ball_sides", None)):
        monkeypatch.setattr(cells, name, value)
    index = cells.build(r, kind, leaf_rows=5)
    assert index.rows.count() == len(refs) and index.branches.count() > 8
    assert rows_of(cells.search(q, index, 5, 14)) == plain(queries, refs, 5)


def test_a_poor_sample_costs_levels_not_rows(data, monkeypatch):
    queries, refs, q, r = data
    for name, value in (("GATHER", 120), ("TASK", 20), ("SAMPLE", 4)):
        monkeypatch.setattr(cells, name, value)
    index = cells.build(r, "boxes", leaf_rows=5)
    assert index.rows.count() == len(refs) and rows_of(cells.search(q, index, 5, 14)) == plain(queries, refs, 5)


def test_brute_ranks_few_pairs(data, monkeypatch):
    queries, refs, q, r = data
    ranked, inner = [], search.best
    monkeypatch.setattr(search, "best", lambda pairs, k: (ranked.append(pairs.count()), inner(pairs, k))[1])
    assert rows_of(knn(q, r, 5, "brute")) == plain(queries, refs, 5)
    assert ranked[0] < len(queries) * len(refs) / 4
