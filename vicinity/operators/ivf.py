"""Approximate neighbours: inverted lists with product quantisation, and an exact re-rank of what these put first.

Training is k-means in rounds of Spark aggregations over a sample of about ``SAMPLE`` rows (all rows, if fewer; a hash of the id draws it, so
it is the same on every run): first ``lists`` coarse centres, then, for each of ``parts`` slices of the dimensions, ``CODES`` code words
of what the coarse centre leaves. The driver holds only centres and code words, whose number is set by parameters.

Every row is indexed: it goes to its nearest list with a byte for each slice. A query looks into its ``probes`` nearest
lists. There a table of distances from the query to all code words gives an estimate for each row by ``parts`` look-ups,
and the ``rerank`` rows of least estimate are compared exactly. One task compares a block of queries with a bin of rows: short lists
share bins, a long one is dealt over several (each re-ranks its own rows), and a query goes once to each bin that has rows of its lists. Tasks
become more, not longer, as the tables grow. Nothing is capped but the number of lists and rows that a query asks for, which are the method's own parameters.

Neighbours come with exact distances, but some may be missing; ``recall`` measures how many against an exact search.
With all lists probed and all rows re-ranked the answer is exact. No references give no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import _matrix
from .knn import MOST_PARTITIONS, NEIGHBOUR_SCHEMA, SLACK, Best, best, parts_of
from .selection import kept

SAMPLE = 65_536
CODES = 64
ROUNDS = 6
#: Rows of a bin, and queries of a block, that one task compares.
PART, BLOCK = 16_384, 8192
#: Queries that are estimated at a time, and components of the vectors that they re-rank.
STEP, COMPONENTS = 128, 1 << 21


@dataclass
class Ivf:
    """``rows`` (ref_id, vector, is_fraud, list, codes), coarse centres (lists x dims) and code words (parts x codes x width)."""

    rows: DataFrame
    sizes: DataFrame
    centres: np.ndarray
    words: np.ndarray


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * (x @ centres.T)).argmin(1)


def _slices(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows cut into equal slices, the last one filled with zeros: (parts, rows, width)."""
    width = -(-x.shape[1] // parts)
    full = np.zeros((len(x), parts * width))
    full[:, : x.shape[1]] = x
    return full.reshape(len(x), parts, width).transpose(1, 0, 2)


def _means(rows: DataFrame, dims: int, place, groups: int, width: int) -> np.ndarray:
    """One round: (groups, width + 1) sums and counts, added in tasks and then by Spark. ``place`` gives the group and values of a matrix's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((groups, width + 1))
        for b in batches:
            for group, values in place(_matrix(b.column("vector"), dims)):
                np.add.at(total, group, np.concatenate([values, np.ones((len(values), 1))], 1))
        some = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].tolist(), pa.list_(pa.float64()))], ["g", "sums"])

    out = np.zeros((groups, width + 1))
    added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width + 1)]
    for r in rows.select("vector").mapInArrow(run, "g long, sums array<double>").groupBy("g").agg(*added).collect():  # at most ``groups`` rows
        out[r["g"]] = r[1:]
    return out


def _moved(centres: np.ndarray, sums: np.ndarray) -> np.ndarray:
    n = sums[:, -1:]
    return np.where(n > 0, sums[:, :-1] / np.maximum(n, 1), centres)


def build(refs: DataFrame, dims: int, lists: int = 0, parts: int = 8) -> Ivf:
    """Centres and code words from the sample, then a list and codes for every row. ``lists``: by the square root of the number of rows, if 0; 4,096 at most."""
    refs = refs.selectExpr("cast(ref_id as bigint) ref_id", "cast(vector as array<double>) vector", "is_fraud")
    n = refs.count()
    lists = lists or int(min(4096, max(1, np.sqrt(n))))
    draw = F.pmod(F.xxhash64("ref_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = kept(refs.where(draw < min(1.0, SAMPLE / max(1, n))))
    first = sample.orderBy(F.xxhash64("ref_id", F.lit(1)), "ref_id").limit(max(lists, CODES)).toArrow()  # as many as centres or code words
    start = _matrix(first.column("vector"), dims)
    centres = start[:lists]
    if not len(centres):
        empty = refs.selectExpr("*", "0 as list", "cast(null as binary) as codes").where("false")
        return Ivf(empty, empty.groupBy("list").agg(F.count("*").alias("n")), centres, np.zeros((parts, 1, 1)))
    for _ in range(ROUNDS):
        centres = _moved(centres, _means(sample, dims, lambda x, c=centres: [(_nearest(x, c), x)], len(centres), dims))
    rest = lambda x: x - centres[_nearest(x, centres)]
    words = _slices(rest(start[:CODES]), parts)
    codes, width = words.shape[1], words.shape[2]
    for _ in range(ROUNDS):
        place = lambda x, w=words: [(p * codes + _nearest(s, w[p]), s) for p, s in enumerate(_slices(rest(x), parts))]
        words = _moved(words.reshape(-1, width), _means(sample, dims, place, parts * codes, width)).reshape(parts, codes, width)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vector"), dims)
            at = _nearest(x, centres)
            code = np.stack([_nearest(s, words[p]) for p, s in enumerate(_slices(x - centres[at], parts))], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("ref_id", "vector", "is_fraud")), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], ["ref_id", "vector", "is_fraud", "list", "codes"])

    rows = kept(refs.mapInArrow(file, "ref_id long, vector array<double>, is_fraud boolean, list int, codes binary"))
    return Ivf(rows, kept(rows.groupBy("list").agg(F.count("*").alias("n"))), centres, words)


def _bins(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first bin of each list, and how many bins it takes: one that others share too, or several of its own."""
    first, takes = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // PART))
    at = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > PART:
            at, held = at + 1, 0
        first[i] = at
        at, held = (at + takes[i], 0) if takes[i] > 1 else (at, held + n)
    return first, takes


def _least(guess: np.ndarray, n: int) -> np.ndarray:
    """Positions of the ``n`` least of each row, of equal ones the first; in order of position."""
    most = np.partition(guess, n - 1, axis=1)[:, n - 1, None]
    take = guess <= most
    many = np.flatnonzero(take.sum(1) > n)
    below, same = guess[many] < most[many], guess[many] == most[many]
    take[many] = below | (same & (np.cumsum(same, 1) <= n - below.sum(1)[:, None]))
    return np.nonzero(take)[1].reshape(len(guess), n)


def _rerank(near: Best, only: np.ndarray, at: np.ndarray, vectors: np.ndarray, ids: np.ndarray, fraud: np.ndarray) -> None:
    """The rows at the positions ``at`` (a row of them for each query of ``only``) for these queries, estimated first as ``Best`` does."""
    size = near.norms[only][:, None] + (vectors * vectors).sum(1)[at]
    guess = size - 2 * (vectors[at] @ near.queries[only][:, :, None])[:, :, 0]
    worst = near.worst[only]
    if at.shape[1] > near.k:
        worst = np.minimum(worst, np.partition(guess + SLACK * (1 + size), near.k - 1, axis=1)[:, near.k - 1])
    who, place = np.nonzero(guess - SLACK * (1 + size) <= worst[:, None])
    near.settle(only[who], at[who, place], vectors, ids, fraud)


def search(queries: DataFrame, index: Ivf, k: int, dims: int, probes: int = 8, rerank: int = 64) -> DataFrame:
    """``query_id, ref_id, d2, is_fraud, rank`` of the k nearest that the probed lists give. Query ids are taken to be unique."""
    kind = queries.schema["query_id"].dataType.simpleString()
    centres, words = index.centres, index.words
    parts = len(words)
    looks = min(probes, len(centres))
    sizes = np.zeros(len(centres), np.int64)
    for r in index.sizes.collect():  # a row for each centre, at most
        sizes[r["list"]] = r["n"]
    first, takes = _bins(sizes)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                b = whole.slice(start, STEP)
                q = _matrix(b.column("q"), dims)
                far = (centres**2).sum(1)[None, :] - 2 * (q @ centres.T)
                near = np.argpartition(far, looks - 1, axis=1)[:, :looks] if looks else np.zeros((len(q), 0), np.int64)
                who, of = np.repeat(np.arange(len(q)), looks), near.ravel()
                who, of = who[sizes[of] > 0], of[sizes[of] > 0]
                n = takes[of]
                to = np.repeat(first[of] - np.cumsum(n) + n, n) + np.arange(n.sum())  # all bins of a list
                who, of = np.repeat(who, n), np.repeat(of, n)
                order = np.lexsort((of, to, who))
                who, of, to = who[order], of[order], to[order]
                new = np.flatnonzero(np.diff(who, prepend=-1) | np.diff(to, prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(of)).astype(np.int32)), pa.array(of.astype(np.int32)))
                one = pa.array(who[new])
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(one), b.column("q").take(one), lists, pa.array(to[new])], ["query_id", "q", "lists", "bin"])

    blocks = parts_of(queries.count(), BLOCK)
    asked = queries.selectExpr("query_id", "cast(vector as array<double>) q").mapInArrow(route, f"query_id {kind}, q array<double>, lists array<int>, bin long")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    places = queries.sparkSession.createDataFrame([(i, int(f), int(n)) for i, (f, n) in enumerate(zip(first, takes, strict=True))], "list int, first long, takes long")
    to_bin = (F.col("first") + F.pmod(F.xxhash64("ref_id"), F.col("takes"))).alias("bin")
    copies = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block")
    rows = index.rows.join(F.broadcast(places), "list").select("ref_id", "vector", "is_fraud", "list", "codes", to_bin, copies)

    def compare(some: pa.Table, among: pa.Table) -> pa.Table:
        among = among.sort_by([("list", "ascending"), ("ref_id", "ascending")])  # of equal estimates those of least id come first
        names, asking = some.column("query_id").combine_chunks(), _matrix(some.column("q"), dims)
        lists = some.column("lists").combine_chunks()
        ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        wanted = lists.flatten().to_numpy(zero_copy_only=False)
        vectors, ids, of = _matrix(among.column("vector"), dims), among.column("ref_id").to_numpy(), among.column("list").to_numpy()
        fraud = np.asarray(among.column("is_fraud").to_pylist(), bool)
        code = np.frombuffer(b"".join(among.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
        norms = (words**2).sum(2)[:, None, :]
        step = max(1, min(STEP, COMPONENTS // (max(1, rerank) * dims)))
        found = []
        for start in range(0, len(names), step):
            near = Best(asking[start : start + step], k)
            who = np.repeat(np.arange(len(near.queries)), np.diff(ends[start : start + step + 1]))
            mine = wanted[ends[start] : ends[start + len(near.queries)]]
            for one in np.unique(mine):
                only, here = who[mine == one], slice(*np.searchsorted(of, [one, one + 1]))
                v, i, f = vectors[here], ids[here], fraud[here]
                if len(i) <= rerank:
                    near.add(v, i, f, only)
                    continue
                table = norms - 2 * (_slices(near.queries[only] - centres[one], parts) @ words.transpose(0, 2, 1))  # less a number of each query's own
                guess = np.zeros((len(only), len(i)))
                for p in range(parts):
                    guess += table[p][:, code[here, p]]
                _rerank(near, only, _least(guess, rerank), v, i, f)
            found.append(near.batch(names.slice(start, step)))
        return pa.Table.from_batches(found or [Best(asking, k).batch(names)])

    n = min(MOST_PARTITIONS, 2 * blocks * int((first + takes).max(initial=1)))
    each = lambda t: t.repartition(n, "bin", "block").groupBy("bin", "block")
    return best(each(asked).cogroup(each(rows)).applyInArrow(compare, NEIGHBOUR_SCHEMA.format(id=kind)), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``queries``, ``recall``: the share of the exact neighbours that were found, in the mean over all pairs. One row."""
    hit = found.select("query_id", "ref_id", F.lit(1).alias("hit"))
    joined = exact.join(hit, ["query_id", "ref_id"], "left")
    return joined.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))
