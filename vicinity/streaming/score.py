"""Decisions for a stream of payloads against a static reference store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.validation import split_payloads
from ..operators.decide import score


def score_stream(payloads: DataFrame, refs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, rejects: Callable[[DataFrame, int], None] | None = None, **options) -> StreamingQuery:
    """Each micro-batch is checked, scored as a batch is, and handed to ``sink`` with its number.

    A batch may be run again after a failure; a sink that writes by batch number gets each result once.
    """

    def each(batch: DataFrame, number: int) -> None:
        good, bad = split_payloads(batch.persist())
        sink(score(good, refs, **options), number)
        if rejects:
            rejects(bad, number)
        batch.unpersist()

    return payloads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own, so that a repeated one replaces itself."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
