"""Order statistics by counts, quantile sketches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vicinity.operators import aggregates, evaluate, selection
from vicinity.operators.selection import nth, quantile


@pytest.fixture
def small(monkeypatch):
    """Rounds of narrowing on small data."""
    monkeypatch.setattr(selection, "FEW", 5)
    monkeypatch.setattr(selection, "FINE", 8)


def made():
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 1), i) for i in range(700)] + [("ties", float(rng.choice([1, 1, 1, 2, 7])), i) for i in range(500)]
    rows += [("one", 5.0, 1), ("equal", 3.0, 9), *(("equal", 3.0, i % 40) for i in range(300)), ("none", None, 1), ("ties", None, 2)]
    rows += [("wide", rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300), i) for i in range(300)] + [("two", float(i % 2), i) for i in range(101)]
    return rows


@pytest.mark.parametrize("rank", [lambda n: F.ceil(n / 2), lambda n: n])
def test_ranks_of_groups(spark, small, rank):
    rows = made()
    df = spark.createDataFrame(rows, "g string, v double, ref_id long").repartition(5)
    found = {r.g: (r.value, r.ref_id) for r in nth(df, "g", F.col("v"), rank(F.col("n"))).collect()}
    expected = {}
    for g in {g for g, *_ in rows}:
        mine = sorted((v, k) for h, v, k in rows if h == g and v is not None)
        wanted = spark.range(1).select(rank(F.lit(len(mine))).cast("long")).first()[0]
        if 1 <= wanted <= len(mine):
            expected[g] = mine[wanted - 1]
    assert found == expected


def test_halves(spark, small):
    rows = made()
    df = spark.createDataFrame(rows, "g string, v double, ref_id long").repartition(3)
    found = {}
    for r in aggregates.median_halves(df, "g", F.col("v")).collect():
        found.setdefault(r.g, []).append((r.v is not None, r.v, r.ref_id, r.half))
    for g, mine in found.items():
        valued = sorted((v, k, half) for known, v, k, half in mine if known)
        if g != "equal":  # there, rows equal in value and key are on one side
            assert [half for *_, half in valued] == [1] * math.ceil(len(valued) / 2) + [2] * (len(valued) // 2)
        assert [half for *_, half in valued] == sorted(half for *_, half in valued) and all(half == 1 for known, *_, half in mine if not known)
    assert aggregates.median_halves(df.where("false"), "g", F.col("v")).count() == 0


@pytest.mark.parametrize("p", [0.5, 1.0])
def test_quantiles(spark, small, p):
    for g in ("ties", "one", "two"):
        df = spark.createDataFrame([r for r in made() if r[0] == g], "g string, v double, ref_id long")
        assert quantile(df, F.col("v"), p).first()[0] == pytest.approx(df.agg(F.percentile("v", p)).first()[0])
    assert quantile(df.where("false"), F.col("v"), p).first()[0] is None


def test_many_equal_rows_stay_in_bounded_tasks(spark):
    """One group, most rows equal: the row is found without ranking more than ``FEW`` rows."""
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.greatest(F.lit(0), F.col("id") - 150_000).cast("double").alias("v"), F.col("id").alias("ref_id"))
    assert tuple(nth(df, "g", F.col("v"), F.lit(100_000)).first()) == (1, 0.0, 99_999)
    assert tuple(nth(df, "g", F.col("v"), F.lit(170_000)).first()) == (1, 19_999.0, 169_999)


def test_sketches_merge_and_can_be_stored(spark, tmp_path):
    rng = random.Random(1)
    values = [rng.lognormvariate(0, 2) for _ in range(60_000)]
    df = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)] + [(1, None)], "day int, v double").repartition(6)
    evaluate.sketched(df, "v", "day").write.parquet(str(tmp_path / "s"))
    whole = evaluate.merged(spark.read.parquet(str(tmp_path / "s")))
    ordered = sorted(values)
    for r in evaluate.quantiles(whole, [0.01, 0.5, 0.9, 0.99]).collect():
        below, upto = sum(v < r.value for v in ordered), sum(v <= r.value for v in ordered)
        assert r.n == 60_000 and below / 60_000 - evaluate.rank_error() <= r["rank"] <= upto / 60_000 + evaluate.rank_error()
    assert evaluate.p99(df, "v", approximate=True).columns == evaluate.p99(df, "v").columns == ["p99"]
    assert evaluate.p99(df, "v").first()[0] == pytest.approx(df.agg(F.percentile("v", 0.99)).first()[0])
