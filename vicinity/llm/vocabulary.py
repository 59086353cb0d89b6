"""Byte-level BPE vocabularies: rank files, a hashed pair table and the batched merge loop."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import regex

NO_PAIR = np.int32(2**31 - 1)
#: Cells of one padded matrix, unless a single row has more.
MATRIX_CELLS = 1 << 20


class PairTable:
    """Open-addressed hash table in numpy arrays: (left id, right id) -> id of the merged token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(left))))))
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, NO_PAIR, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            at = (slots[todo] + self.probes) & self.mask
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = np.zeros(len(at), bool)
            won[first] = free[first]
            self.keys[at[won]], self.values[at[won]] = keys[todo[won]], merged[todo[won]]
            todo, self.probes = todo[~won], self.probes + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of every pair, NO_PAIR where the vocabulary has none or a side is padding (-1)."""
        keys = (left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        out = np.full(len(keys), NO_PAIR, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self._slot(keys[todo])
        for probe in range(self.probes):
            at = (slots + probe) & self.mask
            seen = self.keys[at]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (seen != -1)
            todo, slots = todo[more], slots[more]
            if not len(todo):
                break
        return out.reshape(left.shape)


class Vocabulary:
    """Tokens by id, and what is needed to encode the matches of a splitting pattern.

    A token's id is its rank. A pair can be merged when the two tokens' bytes together are a token.
    """

    def __init__(self, tokens: dict[bytes, int], pattern: str) -> None:
        self.tokens = [b""] * (1 + max(tokens.values()))
        for token, rank in tokens.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        pairs = [(tokens[t[:i]], tokens[t[i:]], r) for t, r in tokens.items() for i in range(1, len(t)) if t[:i] in tokens and t[i:] in tokens]
        self.pairs = PairTable(*np.array(pairs, np.int64).T) if pairs else PairTable(*np.zeros((3, 0), np.int64))
        self.split = regex.compile(pattern).findall

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, merged within the word only. Words are bucketed by length and padded."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        start = int(np.searchsorted(sizes[order], 1))
        while start < len(order):
            width = int(sizes[order[start]])
            step = 4 if width <= 64 else 1 << width.bit_length() - 2
            width = -(-width // step) * step
            end = min(int(np.searchsorted(sizes[order], width, "right")), start + max(1, MATRIX_CELLS // width))
            rows = order[start:end]
            flat = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in rows]), np.uint8).reshape(len(rows), width)
            matrix = np.where(np.arange(width) < sizes[rows][:, None], self.byte_ids[flat], -1).astype(np.int32)
            for i, ids in zip(rows, self._merge_matrix(matrix), strict=True):
                out[i] = ids
            start = end
        return out

    def _merge_matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """Each round merges the leftmost pair of least rank in every row that has one.

        Ranks lie in blocks with their minima, of about the square root of the width each, so a round looks at the minima and one
        block of a row, not at all of it; tokens are linked over the gaps. A row loses a token a round, and when half
        of the width is gone, rows are compacted and those without a pair leave the matrix.
        """
        out: list[np.ndarray] = [None] * len(ids)  # type: ignore[list-item]
        rows = np.arange(len(ids))
        while len(ids):
            n, width = ids.shape
            block = width + 1 if width <= 64 else 1 << (width.bit_length() + 1) // 2
            blocks = width // block + 1  # at least one more place than the width, for the ends of the links
            token = np.full((n, blocks * block), -1, np.int32)
            token[:, :width] = ids
            rank = np.full(token.shape, NO_PAIR, np.int32)
            rank[:, : width - 1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
            tiles = rank.reshape(n, blocks, block)
            least = tiles.min(2)
            places = np.arange(width + 1, dtype=np.int32)
            after, before = np.tile(places + 1, (n, 1)), np.tile(places - 1, (n, 1))
            before[:, 0] = width
            each = np.arange(n)
            rounds = width if blocks == 1 else width // 2
            for _ in range(rounds):
                at = least[each].argmin(1)
                near = tiles[each, at]
                i = near.argmin(1)
                new = near[np.arange(len(each)), i]
                i += at * block
                live = new != NO_PAIR
                if not live.all():
                    each, i, new = each[live], i[live], new[live]
                    if not len(each):
                        break
                j, h = after[each, i], before[each, i]
                k = after[each, j]
                token[each, i], token[each, j] = new, -1
                after[each, i], before[each, k] = k, i
                rank[each, j] = NO_PAIR
                both, changed = np.concatenate([each, each]), np.concatenate([i, h])
                rank[both, changed] = self.pairs.find(np.concatenate([new, token[each, h]]), np.concatenate([token[each, k], new]))
                if blocks > 1:
                    row, tile = np.concatenate([both, each]), np.concatenate([changed, j]) // block
                    least[row, tile] = tiles[row, tile].min(1)
            ended = np.ones(n, bool)
            ended[each] = False
            left = token[ended]
            flat, ends = left[left >= 0], np.cumsum((left >= 0).sum(1)).tolist()
            for r, first, last in zip(rows[ended].tolist(), [0, *ends], ends, strict=False):
                out[r] = flat[first:last]
            rows, token = rows[each], token[each]
            ids = np.take_along_axis(token, np.argsort(token < 0, axis=1, kind="stable")[:, : width - rounds], 1)
        return out


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Vocabulary:
    """A vocabulary from a rank file (one base64 token and its rank a line). Kept by each Python worker."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


class Recent:
    """A dict of what was used lately: two generations of at most ``limit`` entries each."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def fill(self, keys, learn) -> None:
        """Afterwards ``young`` has all ``keys``; ``learn`` gives the values of those not known."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        fresh = []
        for k in keys:
            if k not in self.young:
                if k in self.old:
                    self.young[k] = self.old[k]
                else:
                    fresh.append(k)
        if fresh:
            self.young.update(zip(fresh, learn(fresh), strict=True))


class Chunks:
    """Texts cut before every space that a non-space follows; what is known of each piece is kept.

    No match of the splitting pattern crosses such a cut: a space joins what follows it, and a run
    of white space gives up its last character to a word that follows. Natural text repeats its
    words, so most pieces are looked up. ``learn`` gets the pieces that are new and returns one
    value for each; ``limit`` bounds what a worker keeps.
    """

    def __init__(self, learn, limit: int = 200_000) -> None:
        self.learn = learn
        self.head, self.tail = Recent(limit // 10), Recent(limit)
        self.cut = regex.compile(r" (?=\S)").split

    def values(self, texts: list[str]) -> list[list]:
        """For each text, the values of its pieces in order."""
        parts = [t.split(" ") for t in texts]
        seen: set[str] = set()
        for p in parts:
            seen.update(p[1:])
        if odd := {p for p in seen if not p or p[0].isspace()}:
            parts = [self.cut(t) if not odd.isdisjoint(p[1:]) else p for t, p in zip(texts, parts, strict=True)]
            seen = set()
            for p in parts:
                seen.update(p[1:])
        self.tail.fill(seen, lambda fresh: self.learn([" " + p for p in fresh]))
        self.head.fill({p[0] for p in parts}, self.learn)
        head, tail = self.head.young, self.tail.young.__getitem__
        return [[head[p[0]], *map(tail, p[1:])] for p in parts]
