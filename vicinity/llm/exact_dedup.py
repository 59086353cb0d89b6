"""Exact duplicates by distributed MSD radix partitioning: groups split by successive bytes until single or ended.

The string that is split is a text's length in bytes followed by its bytes in UTF-8, A-Z in lower case. Texts are
equal just where these strings are, and strings of one group end together. A round takes the next bytes of each
document of every open group as a digit, counts documents by group and digit, and names what comes out. A document
alone in its group is settled, and so is one whose text has ended: all of its group are equal. Only the others go
on, with what is left of their texts, so every byte travels once as a digit, and most texts stop at the first
64 bytes. Digits grow sixteenfold, up to ``WIDEST`` bytes, so a text of n bytes takes about log n rounds and then one for each
``WIDEST``. Bytes themselves are compared: no digest decides what is equal.

Counts are combined before they are shuffled, and rows meet them in joins whose skewed keys adaptive execution
splits, so a group of a third of all rows is no single task's work.

A null text counts as empty. Of equal texts the largest id stays; a null id is less than any other; of rows equal in
id and text one stays. No rows give none. Texts of any length are compared whole. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

FIRST, GROWTH, WIDEST = 64, 16, 1 << 20


def normalised(name: str = "text") -> F.Column:
    return F.translate(F.coalesce(F.col(name).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def groups(docs: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``sha``, ``name`` and ``n``: rows of equal texts have one name, and n is their number (alone: no name).

    After the first round a group is named by what was read, the length and the digit; after later ones by its least row.
    Rows are numbered in what the first round wrote, so that numbers cannot change when a task is run again.
    """
    text = normalised()
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), text.cast("binary").alias("bytes"))
    rows = _digits(read.withColumn("name", F.unhex(F.lpad(F.hex(F.octet_length("bytes")), 8, "0"))), "bytes", FIRST)
    placed = cut(_placed(rows, rows.groupBy("name", "digit").agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("least")), F.concat("name", "digit")))
    placed = placed.withColumn("row", F.monotonically_increasing_id())
    width, settled = FIRST, []
    while True:
        settled.append(placed.where("rest is null").select("row", "doc_id", "sha", "name", "n"))
        going = placed.where("rest is not null")
        if not going.limit(1).count():
            return reduce(DataFrame.union, settled)
        width = min(width * GROWTH, WIDEST)
        rows = _digits(going, "rest", width)
        counted = rows.groupBy("name", "digit").agg(F.count("*").alias("n"), F.min("row").alias("least"))
        placed = cut(_placed(rows, counted, F.unhex(F.concat(F.lit("FF"), F.lpad(F.hex("least"), 16, "0"))), "row"))  # no length begins with FF


def _digits(rows: DataFrame, column: str, width: int) -> DataFrame:
    """The next ``width`` bytes as ``digit``, and what is left of them as ``rest``."""
    kept = [c for c in rows.columns if c not in (column, "n")]
    return rows.select(*kept, F.expr(f"substring({column}, 1, {width})").alias("digit"), F.expr(f"substring({column}, {width + 1})").alias("rest"))


def _placed(rows: DataFrame, counted: DataFrame, name: F.Column, *ids: str) -> DataFrame:
    """Rows in the groups that a round made; those that are settled have no ``rest``, those alone no ``name``."""
    joined = rows.join(counted, ["name", "digit"])
    several = F.col("n") > 1
    return joined.select(*ids, "doc_id", "sha", "n", F.when(several, name).alias("name"), F.when(several & (F.octet_length("rest") > 0), F.col("rest")).alias("rest"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row."""
    found = groups(docs)
    several = found.where("n > 1")
    best = several.groupBy("name").agg(F.max(F.struct("doc_id", "row")).alias("best"))
    out = several.join(best, "name").select("doc_id", F.col("best.doc_id").alias("keep_id"), "n", (F.col("row") == F.col("best.row")).alias("kept"), "sha")
    alone = found.where("n = 1").select("doc_id", F.col("doc_id").alias("keep_id"), "n", F.lit(True).alias("kept"), "sha")
    return alone.union(out).select("doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))
