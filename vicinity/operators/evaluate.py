"""How good decisions are: counts of right and wrong ones, latency and the combined score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import quantile


def confusion(results: DataFrame) -> DataFrame:
    """One row of counts from (approved, expected_approved); a null ``approved`` is an error."""
    a, e = F.col("approved"), F.col("expected_approved")
    return results.agg(
        F.count_if(~a & ~e).alias("tp"), F.count_if(a & e).alias("tn"), F.count_if(~a & e).alias("fp"), F.count_if(a & ~e).alias("fn"), F.count_if(a.isNull()).alias("err")
    )


def p99(results: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """The 99th percentile: exact, by rounds of counts and never a sort of the column in one task, or from a sketch."""
    if approximate:
        return quantiles(sketched(results, column), [0.99]).select(F.col("value").alias("p99"))
    return quantile(results, F.col(column), 0.99).withColumnRenamed("quantile", "p99")


#: Size of a quantile sketch, as a power that its rank error falls with: 2296 / K^0.9021 parts in a thousand at most, 99 times in 100 (published bound of KLL sketches).
K = 400


def sketched(rows: DataFrame, column: str, *groups: str, k: int = K) -> DataFrame:
    """``groups``, ``n`` and ``sketch``: mergeable quantile states of a column, which can be stored. Nulls do not count."""
    value = F.col(column).cast("double")
    return rows.where(value.isNotNull()).groupBy(*groups).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(value, k).alias("sketch"))


def merged(states: DataFrame, *groups: str, k: int = K) -> DataFrame:
    """States of parts made those of the whole, as of days made one of a month."""
    return states.groupBy(*groups).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantiles(states: DataFrame, ranks: list[float]) -> DataFrame:
    """A row for each state and rank: its columns but the sketch, ``rank`` and ``value``."""
    other = [c for c in states.columns if c != "sketch"]
    each = F.array(*(F.struct(F.lit(r).alias("rank"), F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(r))).alias("value")) for r in ranks))
    return states.select(*other, F.explode(each).alias("at")).select(*other, "at.*")


def rank_error(k: int = K) -> float:
    """What a sketch's ranks may be off by, as a share of the rows, with a confidence of 99 %."""
    return 2.296 / k**0.9021


def weighted_errors() -> Column:
    return F.col("fp") + 3 * F.col("fn") + 5 * F.col("err")


def detection_score(counts: DataFrame) -> DataFrame:
    """Scores from tp, tn, fp, fn, err and p99 (milliseconds), row by row."""
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn") + F.col("err")
    share = lambda x: F.coalesce(F.try_divide(x.cast("double"), n.cast("double")), F.lit(0.0))
    rows = counts.withColumns({"weighted_errors": weighted_errors(), "epsilon": share(weighted_errors()), "failure_rate": share(F.col("fp") + F.col("fn") + F.col("err"))})
    latency = F.when(F.col("p99") <= 0, 0.0).when(F.col("p99") > 2000, -3000.0).otherwise(1000 * F.log10(1000 / F.greatest(F.col("p99"), F.lit(1.0))))
    detection = F.when(F.col("failure_rate") > 0.15, -3000.0).otherwise(1000 * F.log10(1 / F.greatest(F.col("epsilon"), F.lit(0.001))) - 300 * F.log10(1.0 + F.col("weighted_errors")))
    return rows.withColumns({"p99_score": latency, "detection_score": detection}).withColumn("final_score", F.col("p99_score") + F.col("detection_score"))


def set_statistics(decisions: DataFrame) -> DataFrame:
    """Totals and shares of a labelled set from (fraud_score, approved)."""
    rows = decisions.agg(
        F.count("*").alias("total"), F.count_if(~F.col("approved")).alias("fraud_count"), F.count_if("approved").alias("legit_count"), F.count_if(F.abs(F.col("fraud_score") - 0.6) < 1e-9).alias("edge_case_count")
    )
    share = lambda c: F.coalesce(F.floor(F.try_divide(F.col(c).cast("double"), F.col("total").cast("double")) * 1e4 + 0.5) / 1e4, F.lit(0.0))
    return rows.withColumns({"fraud_rate": share("fraud_count"), "legit_rate": share("legit_count"), "edge_case_rate": share("edge_case_count")})


def ramp(stages: DataFrame, start: int) -> DataFrame:
    """Requests of a load that ramps linearly: ``stage, duration, target`` and the rate it starts from."""
    order = Window.orderBy("stage")  # a handful of stages
    rows = stages.withColumn("from_rate", F.coalesce(F.lag("target").over(order), F.lit(start)))
    rows = rows.withColumn("requests", F.floor((F.col("from_rate") + F.col("target")) * F.col("duration") / 2))
    return rows.withColumn("cumulative", F.sum("requests").over(order))


def merge_results(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key has no new row."""
    return old.join(new.select(keys), keys, "left_anti").unionByName(new)
