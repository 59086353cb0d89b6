"""Links between nodes that share keys, without all pairs of a group.

A similarity join files each node under keys, so that any near pair shares one. Every pair that shares a key
is settled, by these steps: each member of a key against the key's least one; then each member outside the
component of that one against members of other components than its own. Pairs within a component need no
test, so a large group of near copies costs one pair a member and key. Work grows with the square only
where many members of one key are neither near the least one nor in its component; such keys are cut into
bounded parts, so that no task holds a whole one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

#: Elements of the sets in a part of a key's group, and of those outside its main component that meet a part at a time.
PART, OTHERS = 500_000, 1_000_000


def connect(filed: DataFrame, near: Callable[[DataFrame], DataFrame], settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``a``, ``b``: links of near pairs that connect what all near pairs that share a key connect.

    ``filed`` has ``key``, ``fp`` and ``n`` (longs; one row a key and node; ``n`` is the size of its set). ``near`` takes
    pairs (``a``, ``b``, ``na``, ``nb``) and returns ``a``, ``b`` of those that are near. ``settle`` takes rows (``key``, ``part``,
    ``block``, ``fp``, ``n``, ``component``, ``other``) and returns links that connect, in each group of the first three,
    what near pairs of an ``other`` and a row of another component connect. No rows give no links.
    """
    first = filed.groupBy("key").agg(F.min(F.struct("fp", "n")).alias("first"), F.count("*").alias("size"), F.sum("n").alias("total")).where("size > 1")
    members = cut(filed.join(first, "key").selectExpr("key", "fp", "n", "first.fp as first", "first.n as n_first", "total"))
    star = cut(near(members.where("fp <> first").selectExpr("first as a", "fp as b", "n_first as na", "n as nb").distinct()))
    named = components(star)
    own, main = named.selectExpr("node as fp", "component"), named.selectExpr("node as first", "component as main")
    placed = members.join(own, "fp", "left").join(main, "first", "left").selectExpr("key", "fp", "n", "total", "coalesce(component, fp) as component", "coalesce(main, first) as main")
    others = placed.where("component <> main").groupBy("key").agg(F.sum("n").alias("others"))
    placed = cut(placed.join(others, "key").withColumns({"parts": 1 + F.floor(F.col("total") / PART), "blocks": 1 + F.floor(F.col("others") / OTHERS)}))
    deal = lambda count, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), F.col(count))
    all_of = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))
    node = ("fp", "n", "component")
    inside = placed.select("key", deal("parts", 1).alias("part"), all_of("blocks").alias("block"), *node, F.lit(False).alias("other"))
    outside = placed.where("component <> main").select("key", all_of("parts").alias("part"), deal("blocks", 2).alias("block"), *node, F.lit(True).alias("other"))
    return star.union(settle(inside.unionByName(outside)))
