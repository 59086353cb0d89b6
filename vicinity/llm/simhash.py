"""SimHash near-duplicate groups: pigeonhole shards, each searched through a BK-tree.

Two fingerprints that differ in at most ``RADIUS`` = 2 of 64 bits agree on two of four 16-bit
quarters. Each distinct fingerprint is filed under its six pairs of quarters. Where one shard gets
more than ``SHARD`` fingerprints, its members are filed again under two of the four quarters of
their other 32 bits; such a shard has 16 free bits, so at most 65,536 members whatever the corpus.
A shard is a BK-tree: a child hangs from its parent under their integer Hamming distance, and a
search follows only edges within the radius of the distance just measured. A shard's links come
out as links to the least member that each can reach there, at most one a member; the components
of the union are those of all links.

Shard trees are dealt out to tasks, not broadcast: together they grow with the corpus.

A null text counts as empty. A text without words has fingerprint zero, linked like any other. A
null ``doc_id`` keeps its row and is ignored when the least id of a component is taken (null if
there is no other). Repeated rows stay. Any other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces
from .components import components

RADIUS = 2
SHARD = 1024
SEED = 42
WORDS = 3


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 values of all three-word shingles, A-Z in lower case."""
    words = text.lower().split()  # bytes: only A-Z change; splits at 0x20 and 0x09-0x0D
    if not words:
        return 0
    if len(words) < WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:], strict=False)))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[start : start + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``h`` (hash of the text) and ``fp``, the fingerprint as a signed long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1000):
            fp = np.array([fingerprint(t or b"") for t in b.column("text").to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(fp)], ["doc_id", "h", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash("text").alias("h"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, h long, fp long")


class BKTree:
    """Nodes and their children by integer Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Indices of the nodes within ``radius`` of ``value``."""
        found, todo = [], [0] if self.values else []
        while todo:
            i = todo.pop()
            d = (self.values[i] ^ value).bit_count()
            if d <= radius:
                found.append(i)
            todo += [c for at, c in self.children[i].items() if d - radius <= at <= d + radius]
        return found

    def add(self, value: int) -> None:
        i = 0
        while self.values:
            d = (self.values[i] ^ value).bit_count()
            if d not in self.children[i]:
                self.children[i][d] = len(self.values)
                break
            i = self.children[i][d]
        self.values.append(value)
        self.children.append({})


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(value, least value that it reaches in this shard), for values that reach another."""
    if len(values) == 2:
        a, b = sorted(values)
        return [(b, a)] if a != b and (a ^ b).bit_count() <= radius else []
    values = sorted(set(values))
    tree, root = BKTree(), list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, v in enumerate(values):
        for j in tree.near(v, radius):
            a, b = sorted((find(i), find(j)))
            root[b] = a
        tree.add(v)
    return [(v, values[find(i)]) for i, v in enumerate(values) if find(i) != i]


def _quarters(bits: int, value: str, shift: int = 0) -> list[str]:
    return [f"shiftrightunsigned({value}, {shift + bits * i}) & {(1 << bits) - 1}" for i in range(4)]


def links(fps: DataFrame) -> DataFrame:
    """``a``, ``b``: links that connect what the links of all pairs within the radius connect."""
    q = _quarters(16, "fp")
    pairs = list(combinations(range(4), 2))
    first = ", ".join(f"named_struct('shard', {n}, 'key', ({q[i]}) << 16 | ({q[j]}), 'rest', ({q[r]}) << 16 | ({q[s]}))" for n, (i, j) in enumerate(pairs) for r, s in [sorted({0, 1, 2, 3} - {i, j})])
    filed = fps.selectExpr("fp", f"explode(array({first})) as at").select("fp", "at.*")
    sizes = filed.groupBy("shard", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = filed.join(sizes, ["shard", "key"])
    k = _quarters(8, "rest")
    again = ", ".join(f"struct({n + 1} as sub, ({k[i]}) << 8 | ({k[j]}) as deep)" for n, (i, j) in enumerate(pairs))
    placed = shared.selectExpr("fp", "shard", "key", f"explode(case when n <= {SHARD} then array(struct(0 as sub, 0L as deep)) else array({again}) end) as at")
    shards = placed.groupBy("shard", "key", "at.sub", "at.deep").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 5000):
            found = [x for values in b.column("fps").to_pylist() for x in shard_links([v & (1 << 64) - 1 for v in values])]
            a, c = np.array(found, np.uint64).reshape(-1, 2).astype(np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(c))], ["a", "b"])

    return shards.select("fps").mapInArrow(run, "a long, b long")


def id_or_last(name: str) -> Column:
    """The id as a long; a null one comes after all others."""
    return F.coalesce(F.col(name).cast("long"), F.lit((1 << 63) - 1))


def text_hash(name: str) -> Column:
    """A hash of the text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("")))


def grouped(marked: DataFrame) -> DataFrame:
    """``fp``, ``component`` (the least fingerprint reached) and ``least`` (the least document id with ``fp``)."""
    named = components(links(marked.select("fp").distinct())).withColumnRenamed("node", "fp")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    return cut(least.join(named, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the least document id of all that its links reach."""
    marked = cut(fingerprints(docs))
    named = grouped(marked)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(ids, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def named_rows(docs: DataFrame) -> DataFrame:
    """``id``, ``h``, ``fp`` and ``component`` (the least fingerprint that links reach) of every row."""
    marked = cut(fingerprints(docs))
    return marked.join(grouped(marked).select("fp", "component"), "fp").select(id_or_last("doc_id").alias("id"), "h", "fp", "component")


def keep_one(docs: DataFrame, named: Callable[[DataFrame], DataFrame] = named_rows) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns, whatever their names.

    It is a row with the component's least id (rows without an id come last), then with the least
    fingerprint; of rows with the same id and text, one. ``named`` tells what is linked, as ``named_rows`` does.
    Rows are made one by id and text before they travel, so many equal ones are no burden; an empty table gives none.
    """
    first = named(docs).groupBy("component").agg(F.min(F.struct("id", "fp", "h")).alias("k")).select("k.id", "k.h")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(id_or_last("doc_id").alias("id"), text_hash("text").alias("h"), whole.alias("row")).groupBy("id", "h").agg(F.first("row").alias("row"))
    return rows.join(first, ["id", "h"], "left_semi").select("row.*")
