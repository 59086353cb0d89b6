"""What each of five filters removes in every order: counts of failure masks and a subset-zeta transform.

A document fails a set of filters, a mask of five bits. Documents are counted by part and mask, 32 numbers a part;
all else follows from these. The zeta transform adds, for each subset T, the counts of all masks inside T, in five
passes over the 32 numbers. What survives a set S of filters is the sum inside its complement, so a step of an order
that turns S into S with f removes survivors(S) - survivors(S with f): a difference between neighbouring subsets. The
same transform of counts of labelled documents gives what a step loses of them.

Only the counts by mask read documents. Copies are found across the table without sending texts: the least id for
each digest of a text, and rows that are not such a first are copies. Rows equal in id, text and part are counted together
before they travel, so neither a text nor an id that many rows share is a burden.

Null texts count as empty, null parts as the empty string. A document without an id is later than all that have one
(among such documents none is a copy of another) and has no labels. Repeated rows count each, and rows with the id of
the first are not copies. A document of several label rows has a label if one of them has it. A part is there if it has a document; no
documents give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
COPY = 1 << FILTERS.index("E")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def text_mask(text: Column, words: Column) -> Column:
    """Bits of the filters A to D, which a text fails or not by itself."""
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 200, 100 * different < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]
    mask = F.lit(0)
    for i, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << i).otherwise(0)
    return mask


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic``: counts of documents by part and the filters that they fail."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), words(text).alias("words"))
    read = read.select("id", "part", F.unhex(F.sha2("text", 256)).alias("same"), text_mask(F.col("text"), F.col("words")).alias("mask"))
    rows = cut(read.groupBy("id", "same", "part", "mask").agg(F.count("*").alias("n")))
    first = rows.groupBy("same").agg(F.min("id").alias("id"), F.lit(True).alias("first"))
    of = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # ids are compared with nulls equal: a text that no row with an id has is first where it stands
    placed = rows.join(first, rows.id.eqNullSafe(first.id) & (rows.same == first.same), "left").select(rows.id, "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(COPY)).alias("mask"), "n")
    labelled = placed.join(of, "id", "left")
    given = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return labelled.groupBy("part", "mask").agg(F.sum("n").alias("n"), given("good").alias("good"), given("toxic").alias("toxic"))


def zeta(table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The array columns with, for each subset, the sum of the values of all its subsets. A projection for each pass, so that none is computed twice."""

    def with_bit(sums: Column, bit: int) -> Column:
        # without the bit: itself; with it: itself and its neighbour without the bit
        return F.transform(sums, lambda v, s: v + F.when(s.bitwiseAND(bit) > 0, F.get(sums, s - bit)).otherwise(0))

    for i in range(len(FILTERS)):
        table = table.withColumns({c: with_bit(F.col(c), 1 << i) for c in columns})
    return table


def _bits(letters: Column) -> Column:
    return sum((F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))


def survivors(counts: DataFrame) -> DataFrame:
    """``part``, and ``n``, ``good`` and ``toxic`` as arrays: what survives each subset of the filters."""
    one = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))  # at most 32 entries a part
    table = counts.groupBy("part").agg(one.alias("at"))
    counted = lambda c: F.array(*(F.coalesce(F.element_at("at", F.lit(s))[c], F.lit(0).cast("long")) for s in range(ALL + 1)))
    table = table.select("part", *(counted(c).alias(c) for c in ("n", "good", "toxic")))
    table = zeta(table, ("n", "good", "toxic"))
    return table.select("part", *(F.reverse(c).alias(c) for c in ("n", "good", "toxic")))  # the complement of S is ALL - S


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for every part, order of the filters and step of it; the columns are described with the query's contract."""
    left = survivors(masks(docs, labels))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = left.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    at = lambda c, s: F.get(F.col(c), s)
    steps = steps.withColumns({"bit": _bits(F.substring("filter_order", F.col("step"), F.lit(1))), "before": _bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})
    after, bit, before = F.col("before") + F.col("bit"), F.col("bit"), F.col("before")
    lost = lambda c: at(c, before) - at(c, after)
    # the same filter comes after the same set S in |S|! (4 - |S|)! of the orders
    share = F.lit(0).cast("long")
    for s in range(ALL + 1):
        size, orders_of = s.bit_count(), [24, 6, 4, 6, 24]
        if size < len(FILTERS):
            share = share + F.when(bit.bitwiseAND(s) == 0, orders_of[size] * (at("n", F.lit(s)) - at("n", bit + s))).otherwise(0)
    return steps.select(
        "part", "filter_order", "step",
        at("n", after).alias("kept"), lost("n").alias("removed"), (at("n", F.lit(0)) - at("n", bit) - lost("n")).alias("redundant"),
        (at("n", ALL - bit) - at("n", F.lit(ALL))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), share.alias("shapley"),
    )
