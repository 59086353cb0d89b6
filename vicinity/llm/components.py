"""Connected components of an edge table, by label propagation with pointer jumping.

Edges with a null end and loops are ignored; repeated edges count once; a component is named by its least
node, so there are no ties; no edges give an empty table. Columns other than ``a`` and ``b`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the least node reachable) for the nodes of ``edges`` (``a``, ``b`` long).

    Each round takes the least label among a node's neighbours, by a join and an aggregation with
    partial sums, then follows labels to their labels, so a chain of n nodes takes about log n rounds.
    Only a count of changed rows comes to the driver. Loops, repeated edges and edges in one
    direction only are allowed; rows with a null end are ignored; no edges give an empty table. ``edges`` is
    evaluated once, as another time it may give other links that connect the same.
    """
    ends = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(ends.select(F.explode(ways).alias("way")).select("way.*").distinct())  # one evaluation gives both directions
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "m").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        step = cut(lower.join(jump, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("new"), "label"))
        if not step.where("new <> label").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
        labels = step.select("node", F.col("new").alias("label"))
