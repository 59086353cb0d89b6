"""SpotSigs fingerprints: chains of content words that follow common words.

An anchor is one of the commonest words; its signature is the anchor and the next ``CHAIN`` words
that are no anchors. A text's fingerprint is the set of its signatures' hashes. Where there are fewer
signatures than one for ``COVER`` words, as in lists, code or other languages, runs of three words (all
words, if fewer) are signatures too; a text without words is one itself; so every text has a signature,
and equal texts have equal fingerprints. A null text counts as empty.

``near_duplicates`` is a self-join of the different fingerprints by Jaccard, at ``LEAST`` or more. Sets are
partitioned by their size, into classes so wide that a near pair lies in the same or the next one. Within a
class a set is filed under its rarest signatures, as many as any near set must share one of; rarity is that
of 65,536 buckets of signatures, counted over all sets. Sets that meet under a signature are settled as
``linking.connect`` says, pruned by their sizes first and then by exact Jaccard. A null ``doc_id`` keeps its
row and is ignored when the least id of a group is taken (null if there is no other).

``against_edits`` pairs each row with the next one in descending ``doc_id`` order. A null id comes
after all others; rows with equal ids go by a hash of their texts. The rows are cut in this order into ranges, so rows
of one id can be in several; each range gets its neighbour's largest row beside its own rows, and texts travel
compressed. Only rows equal in id and text are always together. A table of one row is its own next row; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces
from .components import components
from .linking import connect

CHAIN = 2
#: Words for each of which a text should have a signature.
COVER = 20
#: The least Jaccard of near fingerprints, as a fraction.
LEAST = (4, 5)
#: Ranges of ids for each shuffle partition, so that partitions are even.
RANGES = 4

# The commonest words of English, German, French and Spanish.
ANCHORS = frozenset(
    """
the of and to in is that for on with as was by it from be are this an at
der die und den von zu das mit sich des auf für ist im dem nicht ein eine als
de la le et les en un du une que est pour qui dans par pas sur au avec
el y los del se las por para con no su al es lo
""".split()
)
_WORDS = re.compile(r"\w+").findall


def signatures(text: str) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the text's signatures."""
    words = _WORDS(text.lower())
    content: list[str] = []
    heads: list[tuple[str, int]] = []
    for w in words:
        if w in ANCHORS:
            heads.append((w, len(content)))
        else:
            content.append(w)
    last = len(content) - CHAIN
    found = {f"{a} {' '.join(content[k : k + CHAIN])}" for a, k in heads if k <= last}
    if words and COVER * len(found) < len(words):
        found |= {" ".join(("", *words[i : i + 3])) for i in range(max(1, len(words) - 2))}
    digest = xxhash.xxh32_intdigest
    return np.unique(np.array([digest(s) for s in found or {"\0" + text}], np.uint32))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 without comparing where their sizes keep it below ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    value = both / (len(a) + len(b) - both)
    return value if value >= least else 0.0


def size_class(size: int, least: tuple[int, int] = LEAST) -> int:
    """Class of a set's size: sets of a Jaccard of ``least`` or more lie in the same or the next class."""
    return int(np.floor(np.log(max(1, size)) / (2 * np.log(least[1] / least[0]))))


def rarest(signs: np.ndarray, loads: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """The rarest signatures of a set, one of which any set near it shares."""
    n = len(signs)
    order = np.lexsort((signs, loads[signs >> 16]))
    return signs[order[: n - -(-least[0] * n // least[1]) + 1]]


def keys(signs: np.ndarray, loads: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """What a set is filed under: its rarest signatures within its size class, and within the next one if a near set may lie there."""
    n = len(signs)
    first, last = size_class(n, least), size_class(n * least[1] // least[0], least)
    return np.concatenate([rarest(signs, loads, least).astype(np.int64) << 16 | c for c in range(first, last + 1)])


def show(signs: np.ndarray) -> str:
    return base64.b64encode(signs.astype(">u4").tobytes()).decode()


def read(shown: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(shown), ">u4").astype(np.uint32)


def name(signs: np.ndarray) -> int:
    """The name of a set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(signs.astype("<u4").tobytes())).astype(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` (the name of the set) and ``signs`` (its signatures as 32-bit numbers) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            signs = [signatures(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([name(s) for s in signs], pa.int64()), pa.array([s.view(np.int32) for s in signs], pa.list_(pa.int32()))], ["doc_id", "fp", "signs"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, fp long, signs array<int>")


def _sets(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.array(s, np.int32).view(np.uint32) for s in b.column("signs").to_pylist()]


def _loads(nodes: DataFrame) -> np.ndarray:
    """How many signatures of all sets fall in each of 65,536 buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for s in _sets(b):
                total += np.bincount(s >> 16, minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    loads = np.zeros(1 << 16, np.int64)
    for r in nodes.select("signs").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        loads[r["bucket"]] = r["n"]
    return loads


def links(nodes: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """``a``, ``b``: links of near pairs that connect what all near pairs of ``nodes`` (``fp``, ``signs``) connect."""
    loads, longs = _loads(nodes), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = _sets(b)
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array([len(s) for s in sets], pa.int64()), pa.array([keys(s, loads, least) for s in sets], longs)], ["fp", "n", "keys"])

    filed = nodes.mapInArrow(run, "fp long, n long, keys array<long>").select("fp", "n", F.explode("keys").alias("key"))
    num, den = least

    def near(pairs: DataFrame) -> DataFrame:
        close = cut(pairs.where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)").select("a", "b"))
        wanted = close.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        sets = nodes.join(wanted, "fp", "left_semi")
        left, right = (sets.selectExpr(f"fp as {c}", f"signs as of_{c}") for c in "ab")
        both = "size(array_intersect(of_a, of_b))"
        return cut(close.join(left, "a").join(right, "b").where(f"{den} * {both} >= {num} * (size(of_a) + size(of_b) - {both})").select("a", "b"))

    def settle(rows: DataFrame) -> DataFrame:
        """Links that exact Jaccard, pruned by sizes, finds between the others and the members of each part."""
        sets = nodes.join(rows.select("fp").distinct(), "fp", "left_semi")
        node = F.struct("fp", "component", "other", "signs")
        grouped = rows.join(sets, "fp").groupBy("key", "part", "block").agg(F.collect_list(node).alias("rows"))  # bounded by PART and OTHERS
        return grouped.select("rows").mapInArrow(compare, "a long, b long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            found = part_links(b.column("rows").to_pylist()[0], least)
            columns = list(zip(*found, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return connect(filed, near, settle)


def part_links(rows: list[dict], least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """Links that connect what near pairs of others and members of another component connect."""
    num, den = least
    for r in rows:
        r["signs"] = np.array(r["signs"], np.int32)
    members = sorted((r for r in rows if not r["other"]), key=lambda r: len(r["signs"]))
    sizes = [len(r["signs"]) for r in members]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = c = root.get(root[c], root[c])
        return c

    out = []
    for q in (r for r in rows if r["other"]):
        n = len(q["signs"])
        for m in members[bisect.bisect_left(sizes, -(-num * n // den)) : bisect.bisect_right(sizes, den * n // num)]:
            a, b = find(q["component"]), find(m["component"])
            if a != b:
                both = len(np.intersect1d(q["signs"], m["signs"], assume_unique=True))
                if den * both >= num * (n + len(m["signs"]) - both):
                    root[max(a, b)] = min(a, b)
                    out.append((q["fp"], m["fp"]))
    return out


def grouped(docs: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """``fp`` and ``group_id``, the least document id of all fingerprints that its links reach, for every fingerprint."""
    marked = fingerprints(docs)
    nodes = cut(marked.groupBy("fp").agg(F.first("signs").alias("signs"), F.min("doc_id").alias("least")))
    named = components(links(nodes.select("fp", "signs"), least)).withColumnRenamed("node", "fp")
    named = nodes.select("fp", "least").join(named, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("group_id"))
    return named.join(ids, "component").select("fp", "group_id")


def near_duplicates(docs: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """``doc_id`` and ``group_id`` of every row."""
    return fingerprints(docs).select("doc_id", "fp").join(grouped(docs, least), "fp").select("doc_id", "group_id")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the first characters of ``following``, as many or all."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _cuts(rows: DataFrame, ranges: int) -> list[tuple[bool, int, int]]:
    """Rows, as (has an id, id, hash of the text), that end about even ranges, the largest last: quantiles of some twenty rows a range, drawn by a hash.

    Only where partitions end hangs on the draw; every row is in exactly one range.
    """
    key = (F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("h"))
    found = rows.agg(F.count("*").alias("n"), F.max(F.struct(*key)).alias("most")).first()
    if found["most"] is None:
        return []
    every = max(1, found["n"] // (20 * ranges))
    drawn = sorted(map(tuple, rows.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(every)) == 0).select(*key).distinct().collect()))
    ends = {drawn[n * len(drawn) // ranges] for n in range(1, ranges)} if drawn else set()
    return sorted(ends | {tuple(found["most"])})


def _in_ranges(docs: DataFrame) -> DataFrame:
    """Rows with their range, and the row that follows each range's last one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"), F.col("text").cast("binary").alias("text"))
    cuts = _cuts(rows.select("doc_id", "h"), RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for b in pieces(batches, 1000):
            out: list[tuple] = []
            for doc_id, h, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "h", "text")), strict=True):
                packed, key = press(text or b""), (doc_id is not None, doc_id or 0, h)
                k = bisect.bisect_left(cuts, key)
                out.append((k, False, doc_id, h, packed))
                if key == cuts[k]:  # the largest of its range: follows the next range, or after all the lowest
                    out.append(((k + 1) % len(cuts), True, doc_id, h, packed))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["range", "beside", "doc_id", "h", "packed"])

    dealt = rows.mapInArrow(run, "range int, beside boolean, doc_id long, h long, packed binary").repartition("range")
    return dealt.sortWithinPartitions("range", "beside", F.desc_nulls_last("doc_id"), F.desc("h"), F.desc("packed"))


def against_edits(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint against its edited text's and the next row's."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress

        def rows() -> Iterator[tuple]:
            for b in pieces(batches, 1000):
                for at, beside, doc_id, packed in zip(*(b.column(c).to_pylist() for c in ("range", "beside", "doc_id", "packed")), strict=True):
                    text = unpack(packed).decode()
                    yield at, beside, doc_id, text, signatures(text)

        out: list[tuple] = []
        held = None
        for row in rows():
            if held and held[0] == row[0] and not held[1]:
                _, _, doc_id, text, signs = held
                other = edited(text, row[3])
                other_signs = signatures(other)
                out.append((doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), show(signs), show(other_signs), likeness(signs, other_signs), likeness(signs, row[4])))
                if len(out) == 2000:
                    yield _batch(out, names, kinds)
                    out = []
            held = row
        yield _batch(out, names, kinds)

    return _in_ranges(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
