"""Exact order statistics of very large groups: the interval of a rank is narrowed by counts until few rows are left.

A round takes a mergeable sketch of what lies in each group's interval, two values around the rank from it, and counts
exactly what lies below, on and between them. Either the rank falls on one of the two, or on an interval without them,
so a poor sketch costs a round and never a wrong answer. When ``FEW`` rows or fewer are left in an interval they are
ranked. Among rows of equal values the same rounds go over the key. Every step is an aggregation with partial results,
so a group of all rows is no single task's work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an interval that are ranked at last. Also how fine a sketch is: it errs by about one row in so many.
FEW, FINE = 10_000, 2_000
#: Groups that are few enough to be sent to all tasks.
FEW_GROUPS = 10_000


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` computed once: in the checkpoint folder, where the session names one."""
    spark = rows.sparkSession
    return rows.checkpoint() if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() else rows.persist()


def sent(groups: DataFrame) -> DataFrame:
    """A table of groups goes to all tasks if a count shows that it is small."""
    return F.broadcast(groups) if groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else groups


def _inside(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """Rows (``g``, ``x``) strictly between ``lo`` and ``hi`` of their group; a null end is open."""
    within = (F.col("lo").isNull() | (F.col("x") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("x") < F.col("hi")))
    return rows.join(sent(open_), "g").where(within)


def _narrowed(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """One round: ``open_`` with the rank among what is left, its new ends and number of rows; or with ``hit``, the value at the rank."""
    sketch = kept(_inside(rows, open_).groupBy("g").agg(F.percentile_approx("x", [i / FINE for i in range(FINE + 1)], 10 * FINE).alias("cuts")))
    at = F.floor((F.col("rank") - 0.5) / F.col("n") * FINE).cast("int")
    near = lambda d: F.get("cuts", F.greatest(F.lit(0), F.least(F.lit(FINE), at + d)))
    tried = kept(open_.join(sketch, "g").select("g", "rank", "lo", "hi", "n", near(-1).alias("a"), near(2).alias("b")))
    x, a, b, rank = (F.col(c) for c in ("x", "a", "b", "rank"))
    counts = {"under_a": x < a, "upto_a": x <= a, "under_b": x < b, "upto_b": x <= b}
    c = _inside(rows, tried).groupBy("g", "rank", "lo", "hi", "n", "a", "b").agg(*(F.count_if(v).alias(k) for k, v in counts.items()))
    # where the rank falls: below a, on a, between, on b, above b; (rank left, lo, hi, rows left, value)
    none = F.lit(None).cast(rows.schema["x"].dataType)
    cases = [
        (rank <= F.col("under_a"), (rank, F.col("lo"), a, F.col("under_a"), none)),
        (rank <= F.col("upto_a"), (rank - F.col("under_a"), a, a, F.lit(0), a)),
        (rank <= F.col("under_b"), (rank - F.col("upto_a"), a, b, F.col("under_b") - F.col("upto_a"), none)),
        (rank <= F.col("upto_b"), (rank - F.col("under_b"), b, b, F.lit(0), b)),
        (F.lit(True), (rank - F.col("upto_b"), b, F.col("hi"), F.col("n") - F.col("upto_b"), none)),
    ]
    pick = lambda i, name: F.coalesce(*(F.when(is_so, F.struct(v[i].alias("v"))) for is_so, v in cases))["v"].alias(name)
    return kept(c.select("g", *(pick(i, name) for i, name in enumerate(("rank", "lo", "hi", "n", "hit")))))


def _found(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``g``, ``rank`` (what is left of it among rows of equal ``x``) and ``x`` at the wanted ``rank`` of each group, by ``x`` alone."""
    open_, done = wanted, []
    while True:
        here = Window.partitionBy("g").orderBy("x")
        ranked = _inside(rows, open_.where(F.col("n") <= FEW)).select("g", "x", "rank", F.row_number().over(here).alias("r"), F.rank().over(here).alias("first"))
        done.append(ranked.where("r = rank").select("g", (F.col("rank") - F.col("first") + 1).alias("rank"), "x"))
        large = open_.where(F.col("n") > FEW)
        if not large.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        narrowed = _narrowed(rows, large)
        done.append(narrowed.where("hit is not null").select("g", "rank", F.col("hit").alias("x")))
        open_ = narrowed.where("hit is null").drop("hit")


def nth(rows: DataFrame, group: str, value: Column, rank: Column, key: str = "ref_id") -> DataFrame:
    """``group``, ``value`` and ``key`` of the row that stands at ``rank`` (from 1) of its group in order of (value, key).

    ``rank`` is an expression over ``n``, the number of the group's rows with a value. Rows without a value do not
    count; groups without such a row, or with a rank outside 1 to n, give none.
    """
    base = rows.select(F.col(group).alias("g"), value.alias("x"), F.col(key).alias("k")).where("x is not null")
    kind, id_kind = base.schema["x"].dataType, base.schema["k"].dataType
    sizes = base.groupBy("g").agg(F.count("*").alias("n"))
    ends = lambda t: (F.lit(None).cast(t).alias("lo"), F.lit(None).cast(t).alias("hi"))
    wanted = kept(sizes.select("g", rank.cast("long").alias("rank"), *ends(kind), "n").where("rank between 1 and n"))
    at = kept(_found(base, wanted))
    same = base.join(sent(at.select("g", F.col("x").alias("at"), "rank")), "g").where("x = at")
    keys = same.select("g", F.col("k").alias("x"), "rank")
    among = kept(keys.groupBy("g", "rank").agg(F.count("*").alias("n")).select("g", "rank", *ends(id_kind), "n"))
    chosen = _found(keys.drop("rank"), among)
    return at.select("g", F.col("x").alias("value")).join(chosen.select("g", F.col("x").alias(key)), "g").withColumnRenamed("g", group)


def quantile(rows: DataFrame, value: Column, p: float) -> DataFrame:
    """``quantile``: the value at position p (n - 1) from 0, between two rows in proportion; null without rows. One row."""
    one = rows.select(value.cast("double").alias("x")).where("x is not null").select(F.lit(0).alias("g"), "x", F.lit(0).alias("k"))
    n = one.count()
    if not n:
        return one.agg(F.max("x").alias("quantile"))
    below = int(p * (n - 1))
    at = nth(one, "g", F.col("x"), F.lit(below + 1), "k").first()["value"]
    after = one.agg(F.count_if(F.col("x") <= at).alias("upto"), F.min(F.when(F.col("x") > at, F.col("x"))).alias("next")).first()
    following = at if after["upto"] > below + 1 or after["next"] is None else after["next"]
    share = p * (n - 1) - below
    return rows.sparkSession.range(1).select(F.lit(at + share * (following - at)).alias("quantile"))
