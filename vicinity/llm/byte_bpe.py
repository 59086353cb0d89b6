"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

``encode(docs, path, pattern)`` adds to each row the ids of its text and the bytes they decode to.

A null text counts as empty: no ids, no bytes. Text of any length is encoded whole; matches of all
lengths are merged in matrices, with block minima where rows are long. Equal texts give equal ids; repeated
rows give repeated rows; an empty table gives none. Columns other than the id and the text are
not looked at, so extra columns may have any name.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces
from .vocabulary import Chunks, Recent, Vocabulary, load


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str, value) -> Chunks:
    """Chunks whose values are the joined ``value(ids, vocabulary)`` of each match in a piece of text."""
    gc.disable()  # in this worker: what is kept has no cycles, and scanning it takes a third of the time
    vocabulary = load(path, pattern)
    known = Recent(200_000)

    def learn(texts: list[str]) -> list:
        rows = [vocabulary.split(t) for t in texts]
        known.fill({w for r in rows for w in r}, lambda fresh: [value(ids, vocabulary) for ids in vocabulary.encode_words([w.encode() for w in fresh])])
        word = known.young.__getitem__
        return [word(r[0]) if len(r) == 1 else _joined([word(w) for w in r]) for r in rows]

    return Chunks(learn)


def _joined(values: list[tuple[str, bytes]]) -> tuple[str, bytes]:
    return " ".join([v[0] for v in values]), b"".join([v[1] for v in values])


def _listing(ids: np.ndarray, vocabulary: Vocabulary) -> tuple[str, bytes]:
    numbers = ids.tolist()
    return " ".join(map(str, numbers)), b"".join([vocabulary.tokens[i] for i in numbers])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` (bytes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = encoder(path, pattern, _listing)
        for b in pieces(batches, 500):
            rows = chunks.values([t or "" for t in b.column("text").to_pylist()])
            ids = [np.array(" ".join([v[0] for v in r if v[0]]).split(), np.int32) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([b"".join([v[1] for v in r]) for r in rows], pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the SHA-256 of the listed ids and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = encoder(path, pattern, _listing)
        for b in pieces(batches, 4000):
            n, listed, decoded = [], [], []
            for row in chunks.values([t or "" for t in b.column("text").to_pylist()]):
                ids = " ".join([v[0] for v in row if v[0]])
                n.append(ids.count(" ") + bool(ids))
                listed.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([v[1] for v in row])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
