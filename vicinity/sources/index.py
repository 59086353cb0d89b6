"""Neighbour indexes on disk: built once, checked, used again."""

from __future__ import annotations

import sys
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.cells import KEPT, Index, build
from .references import read_store

VERSION = 3
LOCK_SECONDS = 3600
META = "version int, kind string, leaf_rows int, dims int, fingerprint string, folder string, rows long, branches long, published long"


def fingerprint(refs: DataFrame) -> str:
    """Count and an order-free sum of row hashes."""
    hashed = F.xxhash64("ref_id", "vector", "is_fraud").cast("decimal(38,0)")
    row = refs.agg(F.count("*").alias("n"), F.coalesce(F.sum(hashed), F.lit(0)).alias("s")).first()
    return f"{row['n']}:{row['s']}"


def _files(spark: SparkSession, path: str):
    """The file system that ``path`` is on, and ``path`` as it knows it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def write_index(index: Index, refs: DataFrame, path: str, leaf_rows: int, dims: int) -> None:
    """Writes a new version to a folder of its own, then publishes it by one row of ``meta``.

    Until that row is committed, readers see the version before; a crash leaves a folder that nothing names.
    The version before stays for those who read it; older ones go.
    """
    spark = refs.sparkSession
    before = _published(spark, path)
    folder = f"v-{uuid.uuid4().hex}"
    index.rows.repartitionByRange("branch", "ref_id").sortWithinPartitions("branch", "leaf").write.parquet(f"{path}/{folder}/rows")
    index.branches.write.parquet(f"{path}/{folder}/branches")
    sizes = index.branches.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("branches")).first()
    number = max((r["published"] for r in before), default=0) + 1
    meta = [(VERSION, index.kind, leaf_rows, dims, fingerprint(refs), folder, sizes["rows"], sizes["branches"], number)]
    spark.createDataFrame(meta, META).coalesce(1).write.mode("append").parquet(f"{path}/meta")
    for row in before[1:]:
        files, old = _files(spark, f"{path}/{row['folder']}")
        files.delete(old, True)


def _published(spark: SparkSession, path: str) -> list:
    """The descriptions of all versions, the last one first."""
    try:
        return spark.read.schema(META).parquet(f"{path}/meta").orderBy(F.desc("published"), F.desc("folder")).collect()
    except AnalysisException:
        return []


def describe(spark: SparkSession, path: str):
    """The description row, or None where there is no readable index."""
    return next(iter(_published(spark, path)), None)


def _open(spark: SparkSession, path: str, found) -> Index:
    rows = spark.read.schema(KEPT).parquet(f"{path}/{found['folder']}/rows")
    return Index(rows, spark.read.parquet(f"{path}/{found['folder']}/branches"), found["kind"])


def _whole(spark: SparkSession, path: str, found) -> bool:
    """Is the version of this library, and has it as many rows and branches as were written?"""
    if found is None or found["version"] != VERSION:
        return False
    try:
        index = _open(spark, path, found)
        return index.rows.count() == found["rows"] and index.branches.count() == found["branches"]
    except AnalysisException:
        return False


def index_ready(spark: SparkSession, path: str) -> bool:
    return _whole(spark, path, describe(spark, path))


def open_index(spark: SparkSession, path: str) -> Index:
    found = describe(spark, path)
    if found is None or found["version"] != VERSION:
        raise ValueError(f"no index of version {VERSION} at {path}")
    return _open(spark, path, found)


class lock:
    """One builder at a time, by a file with the holder's mark. A file left by a crash counts for ``LOCK_SECONDS``.

    It only saves work: versions of two builders don't touch each other, and the later description counts.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.files, self.file = _files(spark, f"{path}/lock")
        self.mark = uuid.uuid4().hex

    def _made(self) -> bool:
        try:
            if self.files.exists(self.file):
                return False
            out = self.files.create(self.file, False)
            out.writeUTF(self.mark)
            out.close()
            time.sleep(0.2)  # not every file system refuses the second of two at the same moment; the last mark counts
            held = self.files.open(self.file)
            mark = held.readUTF()
            held.close()
            return mark == self.mark
        except Py4JJavaError as e:
            if any(kind in e.java_exception.toString() for kind in ("FileAlreadyExists", "FileNotFound", "EOF", "Checksum")):
                return False
            raise

    def __enter__(self) -> None:
        while not self._made():
            try:
                age = time.time() - self.files.getFileStatus(self.file).getModificationTime() / 1000
            except Py4JJavaError:  # it went in the meantime
                continue
            if age > LOCK_SECONDS:
                self.files.delete(self.file, False)
            else:
                time.sleep(1)

    def __exit__(self, *_) -> None:
        self.files.delete(self.file, False)


def ensure_index(refs: DataFrame, path: str, kind: str = "cells", dims: int = 14, leaf_rows: int = 512) -> Index:
    """The index at ``path``; built anew if there is none, it is not whole, or is of other references, another kind or shape."""
    spark = refs.sparkSession
    wanted = (VERSION, kind, leaf_rows, dims, fingerprint(refs))

    def ready() -> bool:
        found = describe(spark, path)
        return found is not None and tuple(found)[:5] == wanted and _whole(spark, path, found)

    if not ready():
        with lock(spark, path):
            if not ready():
                write_index(build(refs, kind, dims, leaf_rows), refs, path, leaf_rows, dims)
    return open_index(spark, path)


def main(arguments: list[str]) -> None:
    """Job: ``python -m vicinity.sources.index STORE PATH [cells|boxes]`` builds the index of a reference store ahead of its use."""
    store, path, *kind = arguments
    spark = SparkSession.builder.getOrCreate()
    ensure_index(read_store(spark, store), path, *kind)


if __name__ == "__main__":
    main(sys.argv[1:])
