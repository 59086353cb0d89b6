"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark's readers need to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A temporary one is used only
    where that setting is absent and Spark runs on this machine alone; elsewhere it would not be shared.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def id_bucket(buckets: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the decimal document id, modulo ``buckets``; a null id falls in bucket 0 of the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % buckets


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same batches in smaller ones, which bounds what a task holds beside its input."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


#: Texts of more characters are not learnt from; with the number of rows this bounds what a sample weighs.
LONGEST = 100_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, buckets: int, held_out: int) -> list:
    """(id, text, label) rows to learn from: about ``per_class`` of each class, whatever the corpus size.

    Rows of bucket ``held_out``, rows without label or text and texts over ``LONGEST`` are never taken. The
    rate of each class comes from an exact count over all labelled rows; a hash of the id picks the ids, so the
    sample is the same on every run. An id gives one text, however often it occurs (the one of least hash).
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (id_bucket(buckets) != held_out))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    rate = F.lit(0.0)
    for y, n in counts.items():
        rate = F.when(F.col("y") == y, F.lit(min(1.0, per_class / n))).otherwise(rate)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < rate).groupBy("doc_id").agg(F.max("y").alias("y"))  # about 2 x per_class rows, at any size
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") <= LONGEST)
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(one.alias("least")).select("doc_id", "least.text", "y").collect()
    return sorted(((r["doc_id"], r["text"], r["y"]) for r in rows), key=lambda r: (r[0], r[2], r[1]))
