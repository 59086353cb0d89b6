"""Votes of the neighbours, and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DIMENSIONS, NEIGHBOURS, THRESHOLD, Norms
from ..functions.features import vectorize
from .knn import knn


def vote(queries: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``query_id``, ``frauds``, ``total``; queries without neighbours have 0 of 0."""
    votes = neighbours.groupBy("query_id").agg(F.count_if("is_fraud").alias("frauds"), F.count("*").alias("total"))
    return queries.select("query_id").join(votes, "query_id", "left").select("query_id", F.coalesce("frauds", F.lit(0)).alias("frauds"), F.coalesce("total", F.lit(0)).alias("total"))


def fraud_score(frauds: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(frauds.cast("double"), total.cast("double")), F.lit(0.0))


def approved(frauds: Column, total: Column, threshold: float = THRESHOLD) -> Column:
    """Strictly below the threshold; the usual 0.6 in whole numbers, so that 3 of 5 is denied."""
    if threshold == THRESHOLD:
        return (total == 0) | (5 * frauds < 3 * total)
    return fraud_score(frauds, total) < threshold


def decide(votes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``query_id``, ``fraud_score``, ``approved``."""
    f, n = F.col("frauds"), F.col("total")
    return votes.select("query_id", fraud_score(f, n).alias("fraud_score"), approved(f, n, threshold).alias("approved"))


def analyze(queries: DataFrame, refs: DataFrame, k: int = NEIGHBOURS, threshold: float = THRESHOLD, strategy: str = "auto", dims: int = DIMENSIONS, index=None) -> DataFrame:
    """Decisions for vectors."""
    return decide(vote(queries, knn(queries, refs, k, strategy, dims, index)), threshold)


def score(payloads: DataFrame, refs: DataFrame, k: int = NEIGHBOURS, threshold: float = THRESHOLD, strategy: str = "auto", norms: Norms | None = None, rounding: str = "all", index=None) -> DataFrame:
    """Decisions for payloads: ``id``, ``fraud_score``, ``approved``. Payloads should have passed validation."""
    found = analyze(vectorize(payloads, norms, rounding), refs, k, threshold, strategy, index=index)
    return found.withColumnRenamed("query_id", "id")
