"""JSON payloads in and out, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.evaluate import set_statistics
from ..schemas import PAYLOAD, TEST_ENTRY


#: Column with the text of a record that does not parse or fit the schema; null for others. ``split_payloads`` rejects such rows.
UNREADABLE = "unreadable"
_SCHEMA = T.StructType([*PAYLOAD.fields, T.StructField(UNREADABLE, T.StringType())])
_KEEP = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": UNREADABLE}


def read_payloads(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Payloads from JSON lines, or from whole files that hold an array each, with ``unreadable``."""
    return spark.read.schema(_SCHEMA).options(**_KEEP).option("multiLine", multi_line).json(path)


def stream_payloads(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(_SCHEMA).options(**_KEEP).option("maxFilesPerTrigger", files_per_trigger).json(path)


def parse_payloads(rows: DataFrame, column: str = "value", unreadable: bool = False) -> DataFrame:
    """Payloads from a column of JSON texts; of texts that do not parse, only nulls. With ``unreadable``, also that column (a null text shows as empty)."""
    parsed = rows.select(F.from_json(column, _SCHEMA, _KEEP).alias("p"), F.col(column).isNull().alias("absent"))
    broken = F.when(F.col("absent"), "").otherwise(F.col(f"p.{UNREADABLE}")).alias(UNREADABLE)
    return parsed.select(*(F.col(f"p.{f.name}") for f in PAYLOAD.fields), *([broken] if unreadable else []))


def flat(payloads: DataFrame) -> DataFrame:
    """One column per leaf of the payload."""
    groups = ("transaction", "customer", "merchant", "terminal", "last_transaction")
    return payloads.select("id", *(F.col(f"{g}.{n}").alias(f"{g}_{n}") for g in groups for n in PAYLOAD[g].dataType.names))


def to_text(struct: Column) -> Column:
    """JSON with nulls written out."""
    return F.to_json(struct, {"ignoreNullFields": "false"})


def write_test_set(entries: DataFrame, path: str) -> None:
    """Labelled entries as JSON lines: the request, what is expected, nulls written out."""
    entries.select("request", "expected_approved", "expected_fraud_score").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_test_envelope(entries: DataFrame, references: DataFrame, path: str) -> None:
    """One row a file set: the references' checksum and the statistics of ``entries``, which go to ``path``/entries as lines.

    The checksum is the SHA-256 of the rows' own digests in order of ``ref_id``, by an aggregation of
    digests of ranges of 10,000 ids each, so no task holds all references.
    """
    digest = F.sha2(F.to_json(F.struct("ref_id", "vector", "is_fraud")), 256)
    joined = lambda order, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x["digest"]), ""), 256).alias("digest")
    ranges = references.select((F.col("ref_id") / 10_000).cast("long").alias("range"), "ref_id", digest.alias("digest")).groupBy("range").agg(joined("ref_id", "digest"))
    checksum = ranges.agg(joined("range", "digest")).withColumnRenamed("digest", "references_checksum_sha256")
    stats = set_statistics(entries.select(F.col("expected_fraud_score").alias("fraud_score"), F.col("expected_approved").alias("approved")))
    write_test_set(entries, f"{path}/entries")
    checksum.select("references_checksum_sha256").join(stats.select(F.struct(*stats.columns).alias("stats"))).write.mode("overwrite").json(f"{path}/envelope")  # one row each


def read_test_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEST_ENTRY).json(path)
