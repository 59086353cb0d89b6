"""Language identification by a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon (whole word) features; transitions between the
languages of neighbouring words are learnt with them, so that words of code-switched text are
labelled in context. Forward-backward gives every word's label probabilities; a document's language
is the one with the largest mean probability over all its words, which is also the score.

Training takes about ``PER_LANGUAGE`` different texts of each language that has any (in expectation, drawn by a
hash of id and text) of at most ``LONGEST`` characters, splices runs of words from different documents so that
there are switches to learn from, and stops at ``SEQUENCES`` of these a language. Every text is labelled whole,
in windows of ``WINDOW`` words; ``CONTEXT`` words on both sides of a window are labelled with it and not counted,
so that words at its ends have their neighbours. Words are runs of letters of any length, taken whole.

A null text, or one without a letter, is ``und`` with score 0; so is every text where there is
nothing to learn from. Ties go to the language that sorts first. Repeated rows stay; other columns
are ignored.
"""

from __future__ import annotations

import gc
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONGEST, id_bucket, pieces
from .vocabulary import Recent

PER_LANGUAGE = 250
SEQUENCES = 625
WINDOW = 448
CONTEXT = 32
HELD_OUT = (4, 2)
HASHES = 1 << 16
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+").findall
_LETTERS = regex.compile(r"\p{L}+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case. What counts as a number or sign, such as a superscript or a fraction, is none."""
    words = _WORDS(text.lower())
    return words if all(map(str.isalpha, words)) else [w for run in words for w in _LETTERS(run)]


def word_features(word: str) -> list[int]:
    """Hashed features: the word, its prefixes and suffixes to three letters, its n-grams of two and three."""
    w = f"^{word}$"
    names = ["w" + word, *("p" + word[:n] for n in (1, 2, 3)), *("s" + word[-n:] for n in (1, 2, 3))]
    names += ["g" + w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)]
    return [zlib.crc32(f.encode()) % HASHES for f in names]


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (T, B, L) of padded rows, and the scale of each step.

    ``emission`` is (T, B, L) and ``transition`` (L, L), both exponentials. Steps are normalised, so
    long rows neither overflow nor vanish. What stands after a row's end has no meaning.
    """
    steps = len(emission)
    alpha = np.empty_like(emission)
    scale = np.empty(emission.shape[:2], emission.dtype)
    state = emission[0]
    for t in range(steps):
        if t:
            state = (alpha[t - 1] @ transition) * emission[t]
        scale[t] = state.sum(1)
        alpha[t] = state / scale[t][:, None]
    beta = np.ones_like(emission[0])
    for t in range(steps - 2, -1, -1):
        back = (emission[t + 1] * beta) @ transition.T
        beta = np.where((t + 1 < lengths)[:, None], back / back.sum(1, keepdims=True), 1)
        alpha[t] *= beta
    alpha /= alpha.sum(2, keepdims=True)
    return alpha, scale


@dataclass
class Field:
    """Languages, feature weights (HASHES, L) and transition weights (L, L)."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of each word's summed weights, the largest 1."""
        rows = [word_features(w) for w in words]
        ends = np.cumsum([0, *map(len, rows)])[:-1]
        total = np.add.reduceat(self.weights[np.array([f for r in rows for f in r])], ends, axis=0)
        return np.exp(np.maximum(total - total.max(1, keepdims=True), -30)).astype(np.float32)

    def label(self, texts: list[str | None], known: Recent) -> list[tuple[str, float]]:
        """Language and score of each text. ``known`` keeps the emissions of words seen before."""
        words = [words_of(t or "") for t in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        known.fill({w for row in words for w in row}, lambda fresh: list(self.emissions(fresh)))
        window, owner, inner = [], [], []
        for n, row in enumerate(words):
            for start in range(0, len(row), WINDOW):
                before = min(CONTEXT, start)
                window.append(row[start - before : start + WINDOW + CONTEXT])
                owner.append(n)
                inner.append((before, before + min(WINDOW, len(row) - start)))
        total = np.zeros((len(texts), len(self.languages)))
        order = np.argsort([len(w) for w in window], kind="stable") if window else []
        transition, value = np.exp(self.transitions).astype(np.float32), known.young.__getitem__
        for start in range(0, len(order), 512):
            block = order[start : start + 512]
            lengths = np.array([len(window[i]) for i in block])
            emission = np.ones((lengths.max(), len(block), len(self.languages)), np.float32)
            for column, i in enumerate(block):
                emission[: lengths[column], column] = list(map(value, window[i]))
            probability, _ = forward_backward(emission, lengths, transition)
            first, last = np.array([inner[i] for i in block]).T
            at = np.arange(len(emission))[:, None]
            probability *= ((first <= at) & (at < last))[:, :, None]
            np.add.at(total, [owner[i] for i in block], probability.sum(0, dtype=np.float64))
        out = []
        for row, sums in zip(words, total, strict=True):
            best = int(sums.argmax())
            out.append((self.languages[best], float(min(1.0, sums[best] / len(row)))) if row else (UNKNOWN, 0.0))
        return out


def spliced(rows: list[tuple[str, int]], rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Word sequences with a label each: runs of one to thirty words from documents in random order."""
    runs = []
    for text, label in rows:
        words, at = words_of(text), 0
        while at < len(words):
            size = int(rng.integers(1, 31))
            runs.append((words[at : at + size], label))
            at += size
    by_label: dict[int, list] = {}
    for i in rng.permutation(len(runs)):
        by_label.setdefault(runs[i][1], []).append(runs[i][0])
    out, labels = [], sorted(by_label)
    while len(out) < SEQUENCES * len(labels) and any(by_label.values()):
        words, marks = [], []
        for _ in range(3):
            label = labels[int(rng.integers(len(labels)))]
            if by_label[label]:
                run = by_label[label].pop()
                words += run
                marks += [label] * len(run)
        if words:
            out.append((words, marks))
    return out


def learn(rows: list[tuple[str, str]], epochs: int = 3, rate: float = 0.2, ridge: float = 1e-4) -> Field:
    """Adagrad on the conditional log-likelihood of spliced sequences of (text, language) rows."""
    languages = sorted({lang for _, lang in rows})
    n = len(languages)
    model = Field(languages, np.zeros((HASHES, n)), np.eye(n))
    rng = np.random.default_rng(0)
    data = spliced([(t, languages.index(lang)) for t, lang in rows], rng)
    if n < 2 or not data:
        return model
    gw, gt = np.full((HASHES, n), 1e-6), np.full((n, n), 1e-6)
    for _ in range(epochs):
        for block in np.array_split(rng.permutation(len(data)), max(1, len(data) // 64)):
            lengths = np.array([len(data[i][0]) for i in block])
            t, b = np.nonzero(np.arange(lengths.max())[:, None] < lengths)
            words = [data[block[j]][0][i] for i, j in zip(t, b, strict=True)]
            truth = np.array([data[block[j]][1][i] for i, j in zip(t, b, strict=True)])
            rows_ = [word_features(w) for w in words]
            flat = np.array([f for r in rows_ for f in r])
            word = np.repeat(np.arange(len(words)), [len(r) for r in rows_])
            total = np.stack([np.bincount(word, model.weights[flat, k], len(words)) for k in range(n)], 1)
            emission = np.ones((lengths.max(), len(block), n))
            emission[t, b] = np.exp(total - total.max(1, keepdims=True))
            transition = np.exp(model.transitions)
            p, _ = forward_backward(emission, lengths, transition)
            error = p[t, b]
            error[np.arange(len(words)), truth] -= 1
            error /= len(block)
            seen, back = np.unique(flat, return_inverse=True)
            dw = np.stack([np.bincount(back, error[word, k], len(seen)) for k in range(n)], 1) + ridge * model.weights[seen]
            gw[seen] += dw**2
            model.weights[seen] -= rate * dw / np.sqrt(gw[seen])
            # expected transitions, from neighbouring probabilities and the transition weights between them
            inside = np.arange(1, lengths.max())[:, None] < lengths
            joint = p[:-1, :, :, None] * p[1:, :, None, :] * transition
            joint /= joint.sum((2, 3), keepdims=True)
            dt = (joint * inside[:, :, None, None]).sum((0, 1))
            mark = np.zeros(emission.shape[:2], np.int64)
            mark[t, b] = truth
            np.subtract.at(dt, (mark[:-1][inside], mark[1:][inside]), 1)
            dt = dt / len(block) + ridge * model.transitions
            gt += dt**2
            model.transitions -= rate * dt / np.sqrt(gt)
    return model


def train(docs: DataFrame) -> Field:
    """A field from documents outside the held-out part that have a text and a language."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (id_bucket(HELD_OUT[0]) != HELD_OUT[1]))
    known = known.where(F.length("text") <= LONGEST).select("lang", "text", F.xxhash64("doc_id", "lang", "text").alias("h"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()  # a row a language
    if not counts:
        return Field([], np.zeros((HASHES, 0)), np.zeros((0, 0)))
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, PER_LANGUAGE / r["n"]))).otherwise(rate)
    drawn = known.where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < rate)
    rows = drawn.groupBy("lang", "h").agg(F.first("text").alias("text")).collect()  # about PER_LANGUAGE rows a language; repeated rows are one
    return learn([(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"]))])


def identify(docs: DataFrame, model: Field) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row."""
    data = pickle.dumps(Field(model.languages, model.weights.astype(np.float32), model.transitions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # what is kept has no cycles
        known, words = pickle.loads(data), Recent(60_000)
        for b in pieces(batches):
            found = known.label(b.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket(HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
