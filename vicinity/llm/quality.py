"""Quality by a factorisation machine over hashed words, structure statistics and size metadata.

Score: a logistic of w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2); the second
sum has all pairwise interactions and takes time linear in the features of the text.

At most ``PER_CLASS`` labelled texts of each class (in expectation) of up to ``common.LONGEST`` characters are
learnt from, drawn by a hash of the id, so the driver's work does not grow with the corpus. A null text counts as empty; an empty
text is scored by its size alone. Without labelled rows every score is 0.5. Repeated rows stay;
other columns are ignored.
"""

from __future__ import annotations

import operator
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, labelled_sample, pieces

PER_CLASS = 2000
HELD_OUT = (5, 0)
THRESHOLD = 0.3
HASHES = 1 << 14
FACTORS = 6
_UPPER, _LOWER, _DIGIT, _SPACE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c"
_MARKS = bytes(b for b in range(33, 127) if b not in _UPPER + _LOWER + _DIGIT)
_STOPS = b".,;:'\"-()"
SIZE_BINS = 12
STATISTICS = 18


def statistics(text: str, words: list[str], counts: Counter) -> np.ndarray:
    """Shares that tell prose from junk, each about 0 to 1."""
    raw = text.encode()
    n, size = max(1, len(words)), max(1, len(raw))
    without = lambda drop: size - len(raw.translate(None, drop))
    upper, lower, digit, marks, stops = map(without, (_UPPER, _LOWER, _DIGIT, _MARKS, _STOPS))
    lines = text.split("\n")
    top = max(counts.values(), default=0)
    twins = sum(map(operator.eq, words, words[1:]))
    return np.array(
        [
            1.0, upper / size, upper / (upper + lower + 1), digit / size, marks / size, (marks - stops) / n, stops / n, text.count("!") / n, text.count("|") / n,
            len(counts) / n, top / n, twins / n, sum(map(str.isupper, words)) / n, len(raw) / n / 20, 1 - len(set(lines)) / len(lines), len(lines) / n, min(1.0, text.count("�") / 5), 1 - without(_SPACE) / size,
        ]
    )


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: statistics first, then bins of the sizes, then hashed words of unit length."""
    words = text.split()
    counts = Counter(words)
    bins = [min(SIZE_BINS - 1, int(np.log2(1 + size))) for size in (len(text) // 8, len(words), text.count("\n"))]
    at = [STATISTICS + k * SIZE_BINS + b for k, b in enumerate(bins)]
    base = STATISTICS + 3 * SIZE_BINS
    hashed = np.array([zlib.crc32(w.encode()) for w in counts], np.int64) % HASHES + base
    values = np.sqrt(np.fromiter(counts.values(), float, len(counts)))
    norm = np.linalg.norm(values)
    return np.concatenate([np.arange(STATISTICS), np.array(at), hashed]).astype(np.int64), np.concatenate([np.minimum(statistics(text, words, counts), 3), np.ones(3), values / (norm or 1)])


@dataclass
class Machine:
    """w0, w and V."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        return float(self.bias + self.weights[at] @ x + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*features(text or "")), -30, 30))))


def learn(rows: list[tuple[int, str, int]], epochs: int = 12, rate: float = 0.05, ridge: float = 1e-4) -> Machine:
    """Adagrad on the log loss, in small batches in an order fixed by a seed."""
    size = STATISTICS + 3 * SIZE_BINS + HASHES
    rng = np.random.default_rng(0)
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.01, (size, FACTORS)))
    if len({y for *_, y in rows}) < 2:
        return Machine(0.0, m.weights, np.zeros_like(m.factors))
    data = [features(t) for _, t, _ in rows]
    ys = np.array([y for *_, y in rows], float)
    g0, gw, gv = 1e-6, np.full(size, 1e-6), np.full((size, FACTORS), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for start in range(0, len(order), 32):
            batch = order[start : start + 32]
            at, x = np.concatenate([data[i][0] for i in batch]), np.concatenate([data[i][1] for i in batch])
            ends = np.cumsum([len(data[i][0]) for i in batch])
            first = np.concatenate([[0], ends[:-1]])
            row = np.repeat(np.arange(len(batch)), np.diff(np.concatenate([[0], ends])))
            v = m.factors[at] * x[:, None]
            sums = np.add.reduceat(v, first)
            z = m.bias + np.add.reduceat(m.weights[at] * x, first) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((v**2).sum(1), first))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - ys[batch]) / len(batch)
            seen, back = np.unique(at, return_inverse=True)
            e = error[row] * x
            dw = np.bincount(back, e) + ridge * m.weights[seen]
            dv = np.stack([np.bincount(back, e * (sums[row, f] - v[:, f])) for f in range(FACTORS)], 1) + ridge * m.factors[seen]
            g0 += error.sum() ** 2
            gw[seen] += dw**2
            gv[seen] += dv**2
            m.bias -= rate * error.sum() / np.sqrt(g0)
            m.weights[seen] -= rate * dw / np.sqrt(gw[seen])
            m.factors[seen] -= rate * dv / np.sqrt(gv[seen])
    return m


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    return learn(labelled_sample(docs, labels, "quality", PER_CLASS, *HELD_OUT))


def scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    model = pickle.dumps(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(model)
        for b in pieces(batches, 1000):
            score = np.array([known.score(t) for t in b.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket(HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` whose score is at least the threshold, with all their columns."""
    model = pickle.dumps(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(model)
        for b in pieces(batches, 1000):
            yield b.filter(pa.array([known.score(t) >= THRESHOLD for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
