"""Near copies by SimHash and BK-trees, with an exact check: Jaccard of five-word shingles of 0.8 or more.

A text's set is that of its five-word shingles as XXH64 values, split and lowered as in ``simhash``;
a text of fewer words is one shingle, one without words has the empty set. Texts of one set are one
node, named by the XXH64 of the set. A node's fingerprint is a SimHash of ``BITS`` bits of the set.

Sets at a similarity of 0.8 differ in about 15 % of the bits (small ones in up to 19 %), too many for shards by
equal pieces of the fingerprint, which ``simhash`` uses for its radius of 2. Shards are the nodes that agree
on one of 24 bands of four MinHash values instead: a pair at exactly 0.8 shares none with probability 3e-6,
a closer one with less. Within a shard (``linking.connect``), nodes within ``RADIUS`` bits of its least one are
compared with that; the rest are looked up in BK-trees of bounded parts of the shard. What is within the
radius is settled by the Jaccard similarity of the sets, there and then (of a text and all that its lookup found, at once), in the first shard that both are in; a part
gives a spanning set of its links, never all pairs. ``RADIUS`` is five standard deviations above the mean distance of
small sets at 0.8. Sets are compared by 32 bits of each hash: two shingles of a pair of texts fall together with a
chance of about 1e-5.

Nulls, ids and repeated rows are as in ``simhash``. Empty tables give none; other columns are kept by
``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, pieces
from .components import components
from .linking import connect

WORDS = 5
BANDS, ROWS = 24, 4
PIECES = 4
BITS = 64 * PIECES
RADIUS = 79
_rng = np.random.default_rng(5)
_XOR, _TIMES = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64), _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_SEEDS = _rng.integers(0, 1 << 64, PIECES, np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles' hashes in order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[i:] for i in range(WORDS)), strict=False) if len(words) >= WORDS else [words]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s) for s in map(b" ".join, runs)], np.uint64))


def name(hashes: np.ndarray) -> int:
    """The name of a set."""
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes())


def bands(hashes: np.ndarray) -> list[int]:
    """One key a band; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[start : start + 2048] ^ _XOR) * _TIMES).min(1))
    return [xxhash.xxh64_intdigest(row.astype("<u8").tobytes(), n) for n, row in enumerate(least.reshape(BANDS, ROWS))]


def prints(hashes: np.ndarray) -> list[int]:
    """The SimHash of a set, as ``PIECES`` numbers of 64 bits."""
    out = []
    for seed in _SEEDS:
        total = np.zeros(64, np.int64)
        for start in range(0, len(hashes), 1 << 15):
            h = hashes[start : start + (1 << 15)] ^ seed
            h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(33)
            total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0]))
    return out


def _longs(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).astype(np.int64)


def short(hashes: np.ndarray) -> np.ndarray:
    """32 bits of each hash of a set."""
    return np.unique(hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)


def marks(docs: DataFrame) -> DataFrame:
    """``id``, ``h`` (hash of the text), ``fp``, the number ``n`` of shingles, their ``hashes``, the ``prints`` and the band ``keys`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for b in pieces(batches, 500):
            sets = [shingles(t or b"") for t in b.column("text").to_pylist()]
            columns = [b.column("id"), b.column("h"), pa.array(_longs([name(s) for s in sets])), pa.array([len(s) for s in sets], pa.int64()), pa.array([short(s) for s in sets], pa.list_(pa.int32()))]
            columns += [pa.array([_longs(of(s)) for s in sets], longs) for of in (prints, bands)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h", "fp", "n", "hashes", "prints", "keys"])

    rows = docs.select(simhash.id_or_last("doc_id").alias("id"), simhash.text_hash("text").alias("h"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, h long, fp long, n long, hashes array<int>, prints array<long>, keys array<long>")


def _within(a: str, b: str) -> str:
    """SQL: do the prints ``a`` and ``b`` differ in at most ``RADIUS`` bits?"""
    return " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(PIECES)) + f" <= {RADIUS}"


def links(marked: DataFrame) -> DataFrame:
    """``a``, ``b``: links of near pairs that connect what all near pairs connect."""
    nodes = cut(marked.select("fp", "n", "prints", "keys").dropDuplicates(["fp"]))
    filed = nodes.select("fp", "n", F.explode("keys").alias("key"))
    of = lambda table, column: [table.selectExpr(f"fp as {c}", f"{column} as of_{c}") for c in "ab"]

    def near(pairs: DataFrame) -> DataFrame:
        """Those within the radius whose sets are at 0.8 or more: 4/5 <= c / (a + b - c), in whole numbers."""
        left, right = of(nodes, "prints")
        close = cut(pairs.where("5 * least(na, nb) >= 4 * greatest(na, nb)").select("a", "b").join(left, "a").join(right, "b").where(_within("of_a", "of_b")).select("a", "b"))
        wanted = close.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        sets = marked.select("fp", "hashes").join(wanted, "fp", "left_semi").groupBy("fp").agg(F.first("hashes").alias("hashes"))
        left, right = of(sets, "hashes")
        return cut(close.join(left, "a").join(right, "b").where("9 * size(array_intersect(of_a, of_b)) >= 4 * (size(of_a) + size(of_b))").select("a", "b"))

    def settle(rows: DataFrame) -> DataFrame:
        """Links that BK-trees and the exact check find between the others and the members of each part."""
        wanted = rows.select("fp").distinct()
        sets = marked.select("fp", "hashes").join(wanted, "fp", "left_semi").groupBy("fp").agg(F.first("hashes").alias("hashes"))
        whole = rows.join(nodes.select("fp", "prints", "keys"), "fp").join(sets, "fp")
        node = F.struct("fp", "component", "other", "prints", "keys", "hashes")
        grouped = whole.groupBy("key", "part", "block").agg(F.collect_list(node).alias("rows"))  # bounded by PART and OTHERS
        return grouped.select("key", "rows").mapInArrow(_tree_links, "a long, b long")

    return connect(filed, near, settle)


def _tree_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 1):
        found = tree_links(b.column("key")[0].as_py(), b.column("rows")[0].values)
        columns = list(zip(*found, strict=True)) or [()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


#: Members of one edge of a tree that are kept as an array.
LEAF = 512


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of prints (rows of ``PIECES`` numbers)."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class Tree:
    """A BK-tree over rows of prints: children hang from a pivot under their integer distance to it, small ones as arrays."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        self.root = self._node(np.arange(len(prints))) if len(prints) else None

    def _node(self, ids: np.ndarray) -> tuple[int, dict]:
        pivot, rest = int(ids[0]), ids[1:]
        d = _far(self.prints[rest], self.prints[pivot])
        order = np.argsort(d, kind="stable")
        edges, first = np.unique(d[order], return_index=True)
        parts = np.split(rest[order], first[1:]) if len(rest) else []
        return pivot, {int(e): self._node(part) if e and len(part) > LEAF else part for e, part in zip(edges, parts, strict=True)}

    def near(self, value: np.ndarray, radius: int) -> np.ndarray:
        """Indices of the rows within ``radius`` of ``value``, by edges within the radius only."""
        met, todo = [np.zeros(0, np.int64)], [self.root] if self.root else []
        while todo:
            pivot, children = todo.pop()
            met.append(np.array([pivot]))
            d = int(_far(self.prints[pivot], value))
            for edge, child in children.items():
                if d - radius <= edge <= d + radius:
                    (todo if isinstance(child, tuple) else met).append(child)
        ids = np.concatenate(met)
        return ids[_far(self.prints[ids], value) <= radius]


def tree_links(key: int, rows: pa.StructArray) -> list[tuple[int, int]]:
    """Links that connect what near pairs of others and members connect, of pairs whose first shared key is ``key``."""
    column = lambda c: rows.field(c).to_numpy(zero_copy_only=False)
    matrix = lambda c, width: np.asarray(rows.field(c).flatten()).reshape(len(rows), width)
    fp, component, other = column("fp"), column("component"), column("other").astype(bool)
    prints, keys = matrix("prints", PIECES).view(np.uint64), matrix("keys", BANDS)
    sets = rows.field("hashes")
    ends = np.asarray(sets.offsets)
    values, flat = np.unique(np.asarray(sets.values)[ends[0] : ends[-1]], return_inverse=True)  # numbers of elements
    ends = ends - ends[0]
    held = np.zeros(len(values), bool)
    members = np.flatnonzero(~other)
    own, sizes = component[members], np.diff(ends)[members]
    tree = Tree(prints[members])
    names = component.copy()  # of others, as they are joined
    out = []
    for q in np.flatnonzero(other):
        mine = flat[ends[q] : ends[q + 1]]
        at = tree.near(prints[q], RADIUS)
        at = at[(own[at] != names[q]) & (5 * np.minimum(sizes[at], len(mine)) >= 4 * np.maximum(sizes[at], len(mine)))]
        theirs = keys[members[at]]
        at = at[np.where(theirs == keys[q], theirs, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max) == key]  # equal keys stand at the same place
        if not len(at):
            continue
        held[mine] = True
        stops = np.cumsum(sizes[at])
        both = np.add.reduceat(held[flat[np.arange(stops[-1]) + np.repeat(ends[members[at]] + sizes[at] - stops, sizes[at])]], stops - sizes[at], dtype=np.int64)
        held[mine] = False
        for m in at[9 * both >= 4 * (len(mine) + sizes[at].astype(np.int64))].tolist():
            if own[m] != names[q]:
                old, new = max(own[m], names[q]), min(own[m], names[q])
                own[own == old], names[names == old] = new, new
                out.append((int(fp[q]), int(fp[members[m]])))
    return out


def named_rows(docs: DataFrame) -> DataFrame:
    """``id``, ``h``, ``fp`` and ``component`` (the least node that links reach) of every row."""
    marked = cut(marks(docs))
    named = components(links(marked)).withColumnRenamed("node", "fp")
    return marked.select("id", "h", "fp").join(named, "fp", "left").select("id", "h", "fp", F.coalesce("component", "fp").alias("component"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, chosen as ``simhash.keep_one`` does."""
    return simhash.keep_one(docs, named_rows)
