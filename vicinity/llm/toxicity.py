"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers case, maps look-alike letters to Latin ones and digits and signs that stand for
letters to those letters. Terms count where no letter touches them; a term inside an exception
phrase does not count. The weights of the found terms are summed and normalised by the length of
the text; a logistic of both numbers is the score.

The lexicon starts from ``SEEDS`` and gets weights, and further terms, from labelled texts: the
log-odds of a term's presence in toxic and other texts. At most ``LEARNT`` further terms are taken, those of
the largest log-odds: more fit the sample, not the language. At most ``PER_CLASS`` texts of each class (in
expectation) of up to ``common.LONGEST`` characters are learnt from, drawn by a hash of the id; that bounds what
the driver holds.

A null or empty text, and one without a term, gets the score of no term at all. Without labelled
rows of both classes the seeds count alike. Repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, labelled_sample, pieces

PER_CLASS = 2500
HELD_OUT = (5, 0)
LEARNT = 400
LEAST_SHARE = 0.004
LEAST_ODDS = 2.0

# Insults that the lexicon starts from, in English, German, French and Spanish.
SEEDS = """
asshole bastard bitch bullshit clown coward cretin creep crap degenerate disgusting dumb dumbass fool
freak garbage idiot idiotic imbecile jerk loser lunatic moron moronic pathetic pig psycho retard scum scumbag
shit shitty sick slut stupid trash ugly vermin whore worthless wretch
arschloch blödmann depp dreckskerl dummkopf idioten miststück scheisse schlampe trottel versager widerlich
abruti connard connasse crétin débile imbécile merde minable ordure pourriture salaud salope
basura cabrón estúpido gilipollas idiota imbécil inútil mierda payaso patético pendejo puta
""".split()

# Phrases in which a term is meant plainly.
EXCEPTIONS = [
    "clown fish", "clown car", "class clown", "trash can", "trash bin", "trash bag", "trash collection", "garbage can", "garbage collection", "garbage collector",
    "garbage truck", "idiot proof", "pig iron", "guinea pig", "sick leave", "sick day", "pond scum", "soap scum", "fool proof", "ugly duckling", "sore loser",
]

# Letters of other scripts that look like Latin ones, and digits and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "й": "n", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y",
    "х": "x", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Marks that are slipped between letters: zero-width signs and the soft hyphen.
HIDDEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿"), None)
_WIDE = {c: chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)}
_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | _WIDE | HIDDEN
_SIGNS = str.maketrans(DIGITS)
#: A sign stands for a letter only inside a word: next to a letter, in a run that ends with a letter or digit.
_MIXED = re.compile(r"(?=[^\W_]*[@$!0-9])(?=[\d@$!]*[^\W\d_])[\w@$!]*\w")
_WORD = re.compile(r"[^\W\d_]{3,}")


def fold(text: str) -> str:
    """Lower case, Latin look-alikes, and letters for digits inside words."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    return _MIXED.sub(lambda m: m[0].translate(_SIGNS), text) if any(d in text for d in DIGITS) else text


@dataclass
class Lexicon:
    """Terms with weights, phrases that excuse them, and the logistic over (sum, density)."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    curve: tuple[float, float, float] = (-3.0, 1.0, 10.0)

    def __post_init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for phrase in self.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        for term, weight in self.weights.items():
            if term not in self.exceptions:
                self.automaton.add_word(term, (len(term), weight))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def found(self, text: str) -> list[float]:
        """Weights of the terms in ``text``, as often as each occurs."""
        if not len(self.automaton):
            return []
        folded = fold(text)
        spans, excused = [], []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if (start and folded[start - 1].isalpha()) or (end + 1 < len(folded) and folded[end + 1].isalpha()):
                continue
            (excused if weight is None else spans).append((start, end, weight))
        if excused and spans:
            cover = np.zeros(len(folded), bool)
            for start, end, _ in excused:
                cover[start : end + 1] = True
            spans = [s for s in spans if not cover[s[0]]]
        return [s[2] for s in spans]

    def numbers(self, text: str) -> tuple[float, float]:
        """Sum of weights, damped; and the sum per hundred characters."""
        total = sum(self.found(text))
        return math.log1p(max(0.0, total)), 100 * total / (100 + len(text))

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        x, y = self.numbers(text or "")
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def weigh(rows: list[tuple[int, str, int]]) -> dict[str, float]:
    """Terms and weights: the seeds, and words whose presence tells toxic texts from others."""
    total, present = Counter(), {0: Counter(), 1: Counter()}
    for _, text, y in rows:
        total[y] += 1
        present[y].update(set(_WORD.findall(fold(text))))
    odds = lambda w: math.log((present[1][w] + 0.5) / (total[1] + 1)) - math.log((present[0][w] + 0.5) / (total[0] + 1))
    seeds = {fold(s) for s in SEEDS}
    weights = {s: max(0.5, min(4.0, odds(s))) if present[0][s] + present[1][s] >= 5 else 1.0 for s in seeds}
    floor = max(5, LEAST_SHARE * total[1])
    new = [w for w, n in present[1].items() if n >= floor and odds(w) > LEAST_ODDS and w not in seeds]
    weights |= {w: min(4.0, odds(w)) for w in sorted(new, key=lambda w: (-odds(w), w))[:LEARNT]}
    return dict(sorted(weights.items()))


def learn(rows: list[tuple[int, str, int]]) -> Lexicon:
    """A lexicon from (id, text, 0 or 1) rows.

    The logistic is fitted to what lexicons from one half of the rows find in the other half, so
    that words which only happen to stand in the texts learnt from don't count as proof.
    """
    if len({y for *_, y in rows}) < 2:
        return Lexicon({fold(s): 1.0 for s in sorted(SEEDS)})
    halves = [[r for n, r in enumerate(rows) if n % 2 == side] for side in (0, 1)]
    x, y = [], []
    for known, other in (halves, halves[::-1]):
        lexicon = Lexicon(weigh(known))
        x += [(1.0, *lexicon.numbers(t)) for _, t, _ in other]
        y += [r[2] for r in other]
    a, b, w = np.array(x), np.array(y, float), np.zeros(3)
    for _ in range(100):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(3), a.T @ (p - b) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Lexicon(weigh(rows), curve=tuple(w.tolist()))


def train(docs: DataFrame, labels: DataFrame) -> Lexicon:
    return learn(labelled_sample(docs, labels, "toxic", PER_CLASS, *HELD_OUT))


def scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    model = pickle.dumps(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(model)
        for b in pieces(batches):
            score = np.array([known.score(t) for t in b.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket(HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, with all their columns."""
    model = pickle.dumps(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(model)
        for b in pieces(batches):
            yield b.filter(pa.array([known.score(t) < 0.5 for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
