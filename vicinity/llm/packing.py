"""Packing along a space-filling curve.

Each document's token counts are hashed to a vector, projected to ``DIMENSIONS`` numbers and placed
on a Hilbert curve. The documents are range-sorted by that key, and each range is cut into
sequences of ``length`` tokens, so that neighbours on the curve share sequences. Only the last
sequence of a range can be short; it is cut again into powers of two, which need no padding.

Long documents are sorted in segments of ``SEGMENT`` tokens, as they lie close together on the curve:
ranges of as many rows then have about as many tokens. Segments that meet in a sequence are one piece.
There is a range for every ``RANGE_TOKENS`` tokens of the corpus, so tasks stay as large as they are
when it grows.

Ids are those of the ``tokenizers`` library with ``add_special_tokens=False``: nothing is added, and
the strings of the vocabulary's added tokens, where a text has them, are these tokens.

A null text counts as empty and has one token, the end mark 0. A null ``doc_id`` keeps its row and
sorts first. Ties on the curve go by ``doc_id`` and then by row, so equal rows, packed each by itself,
can be dealt to several ranges. An empty table gives no pieces. Any other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces

DIMENSIONS = 4
BITS = 10
BUCKET_BITS = 10
LENGTH = 1024
SEGMENT = 2048
#: Tokens of a range; a range is a task.
RANGE_TOKENS = 8_000_000


@lru_cache(maxsize=2)
def _encode(path: str):
    """The encoder of a byte-level BPE in the JSON form of the ``tokenizers`` library.

    That form spells each byte as one character: printable Latin-1 ones as they are, the others from
    U+0100 on. Its ids are also the order of its merges, so the quicker ``tiktoken`` gives the same
    ids; the tests compare the two. Texts with the string of an added token are cut there, as that
    library does.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    if max(*ranks.values(), *special.values()) >= 1 << 16:
        raise ValueError("ids are stored in 16 bits")
    encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    plainly = encoding.encode_ordinary

    def encode(text: str) -> list[int]:
        return encoding.encode(text, allowed_special="all") if any(s in text for s in special) else plainly(text)

    return encode


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of rows of unsigned coordinates below 2**bits.

    From the highest bit down, a coordinate whose bit is set flips the lower bits of the first
    coordinate, one whose bit is clear trades its lower bits with the first; a Gray code follows.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            on = x[i] >> b & 1 == 1
            trade = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, trade)
            x[i] ^= trade
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flips ^= np.where(x[n - 1] >> b & 1 == 1, (1 << b) - 1, 0)
    x ^= flips
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(0).standard_normal((1 << BUCKET_BITS, DIMENSIONS))


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of token lists: hashed counts, square roots, unit length, projection, grid."""
    if not ids:
        return np.zeros(0, np.int64)
    counts = np.stack([np.bincount(i.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(32 - BUCKET_BITS), minlength=1 << BUCKET_BITS) for i in ids])
    vectors = np.sqrt(counts)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    grid = np.clip((vectors @ _projection() + 4) * ((1 << BITS) / 8), 0, (1 << BITS) - 1)
    return hilbert(grid, BITS)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``doc_tokens`` and ``curve`` of every row, with ``start`` and ``ids`` (16-bit, the end mark last) of its segments.

    ``row`` numbers the rows of the table; it is the same on every run over the same partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = _encode(path), TaskContext.get().partitionId() << 40
        for b in pieces(batches, 500):
            ids = [np.array([*encode(t or ""), 0], "<u2") for t in b.column("text").to_pylist()]
            at = [(row, start) for row, i in enumerate(ids) for start in range(0, len(i), SEGMENT)]
            row, keys = np.array([r for r, _ in at], np.int64), curve_keys(ids)
            sizes = np.array([len(i) for i in ids], np.int64)
            parts = [ids[r][start : start + SEGMENT].tobytes() for r, start in at]
            columns = [b.column("doc_id").take(pa.array(row)), pa.array(sizes[row]), pa.array(keys[row]), pa.array(number + row), pa.array([start for _, start in at], pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_tokens", "curve", "row", "start", "ids"])
            number += len(ids)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, doc_tokens long, curve long, row long, start long, ids binary")


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def fill(rows: Iterator[tuple], length: int) -> Iterator[list[tuple]]:
    """Sequences in order, each a list of (document, doc_tokens, start, ids); the rest in powers of two."""
    room, held = length, []
    for row in rows:
        for part, room in _cut(row, room, length):
            held.append(part)
            if room == length:
                yield held
                held = []
    left = length - room
    sizes = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    if not sizes:
        return
    room, short = sizes.pop(0), []
    for doc_id, n, start, ids in held:
        at = 0
        while at < len(ids):
            take = min(room, len(ids) - at)
            short.append((doc_id, n, start + at, ids[at : at + take]))
            at, room = at + take, room - take
            if not room:
                yield short
                room, short = sizes.pop(0) if sizes else 0, []


def _cut(row: tuple, room: int, length: int) -> Iterator[tuple[tuple, int]]:
    """The parts of a row that go to this sequence and the next ones, with the room each leaves (``length`` once full)."""
    doc_id, n, start, ids = row
    at = 0
    while at < len(ids):
        take = min(room, len(ids) - at)
        part = (doc_id, n, start + at, ids[at : at + take])
        at, room = at + take, room - take or length
        yield part, room


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece of a document: where it starts there, and where it lies in which sequence."""
    if length < 1:
        raise ValueError("length must be positive")
    order = ("curve", "doc_id", "row", "start")
    ready = cut(tokenized(docs, path))
    tokens = ready.agg(F.sum(F.length("ids"))).first()[0] or 0
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, -(-tokens // (2 * RANGE_TOKENS)))
    sorted_docs = ready.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    names = ("doc_id", "doc_tokens", "row", "start", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40

        def rows() -> Iterator[tuple[tuple, int, int, np.ndarray]]:
            for b in pieces(batches, 1000):
                for doc_id, n, row, start, ids in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                    yield (doc_id, row), n, start, np.frombuffer(ids, "<u2")

        out: list[tuple] = []
        for held in fill(rows(), length):
            offset, last = 0, None
            for doc, n, start, ids in held:
                data, size = ids.astype("<u4").tobytes(), len(ids)
                if last == (doc, start):  # the next segment
                    _, begin, before, crc, *_, at = out.pop()
                    out.append((doc[0], begin, before + size, zlib.crc32(data, crc), n, sequence, at))
                else:
                    out.append((doc[0], start, size, zlib.crc32(data), n, sequence, offset))
                offset, last = offset + size, (doc, start + size)
            sequence += 1
            if len(out) >= 20_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return sorted_docs.select(*names).mapInArrow(run, ", ".join(f"{c} long" for c in COLUMNS))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(COLUMNS))
