"""Labelled reference vectors: JSON in, parquet store, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DIMENSIONS
from ..functions.validation import errors, is_fraud, reference_rules
from ..schemas import REFERENCE_JSON
from .arrays import read_array


def read_reference_json(spark: SparkSession, path: str) -> DataFrame:
    """``ref_id`` (position in the file), ``vector``, ``label`` from one array a file or from JSON lines, plain or gzipped.

    Records are read one by one (``arrays.read_array``), whatever the size of a file; null records are skipped. A gzipped
    file is one task's work; write it to a store once and read that afterwards.
    """
    return read_array(spark, path, REFERENCE_JSON).withColumnRenamed("position", "ref_id")


def encoded(references: DataFrame) -> DataFrame:
    return references.select("ref_id", "vector", is_fraud(F.col("label")).alias("is_fraud"))


def split_references(references: DataFrame, dims: int = DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected ones with their errors."""
    rows = references.withColumn("errors", errors(reference_rules(dims)))
    return rows.where(F.size("errors") == 0).drop("errors"), rows.where(F.size("errors") > 0)


def write_store(references: DataFrame, path: str, expected: int | None = None, dims: int = DIMENSIONS) -> None:
    """All references, checked, as parquet. Fails before writing if one is broken or their number is not ``expected``."""
    good, bad = split_references(references, dims)
    if bad.limit(1).count():
        raise ValueError(f"broken references: {bad.select('ref_id', 'errors').limit(3).collect()}")
    if expected is not None and (n := good.count()) != expected:
        raise ValueError(f"{n} references, {expected} expected")
    encoded(good).write.mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    missing = {"ref_id", "vector", "is_fraud"} - set(rows.columns)
    if missing:
        raise ValueError(f"not a reference store, without {sorted(missing)}")
    return rows


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``sha256`` of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
