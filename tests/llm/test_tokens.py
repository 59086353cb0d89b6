"""Byte-level BPE against tiktoken, packing against tokenizers, and the curve."""

import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from vicinity.llm import byte_bpe, packing, vocabulary

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
RNG = random.Random(1)
TEXTS = [None, "", "a", " ", "  ", "a  b", "a \n b", "foo.\nBar", "x \n", "\n\n x", "héllo wörld  ", "ab" * 700, " " * 1500 + "x", "日本語 テスト" * 50, "don't we'll 12345 <|endoftext|>", "\x1c x \x1cy"]
TEXTS += ["".join(RNG.choice(" \n\tab.é1' ") for _ in range(RNG.randint(0, 60))) for _ in range(300)]
TEXTS += ["".join(RNG.choice("abcdefgh") for _ in range(3000))]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def docs_of(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "a b", ""), (1, "", "clash")], "doc_id long, text string, ids string")


def test_ids_and_bytes(spark, reference):
    out = byte_bpe.encode(docs_of(spark), RANKS, public_tokenizers.PATTERN).collect()
    assert len(out) == len(TEXTS) + 2
    for r, text in zip(out, [*TEXTS, "a b", ""], strict=True):
        assert r.ids == reference.encode_ordinary(text or "") and bytes(r.decoded) == (text or "").encode()


def test_digests(spark, reference):
    out = byte_bpe.digest(docs_of(spark), RANKS, public_tokenizers.PATTERN).collect()
    for r, text in zip(out, [*TEXTS, "a b", ""], strict=True):
        ids = reference.encode_ordinary(text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.digest(docs_of(spark).where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_rows_of_all_lengths_merge_as_in_a_plain_loop(reference):
    """One block and many, one compaction and several, padded beside longer rows and alone."""
    v = vocabulary.load(RANKS, public_tokenizers.PATTERN)
    ranks = {t: i for i, t in enumerate(v.tokens)}

    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    words = ["".join(RNG.choice("theandr ") for _ in range(n)).encode() for n in (1, 2, 3, 50, 60, 63, 64, 65, 66, 100, 200, 255, 256, 257, 400) for _ in range(4)]
    words += [b"", b" " * 300, b"a" * 257, bytes(range(256)), "日本é".encode() * 40]
    expected = [plain(w) for w in words]
    assert [ids.tolist() for ids in v.encode_words(words)] == expected
    assert [v.encode_words([w])[0].tolist() for w in words] == expected


def test_very_long_rows(reference):
    v = vocabulary.load(RANKS, public_tokenizers.PATTERN)
    words = ["".join(RNG.choice("theandrio") for _ in range(n)) for n in (5000, 5001, 7000, 30_000)] + [" " * 20_000]
    for word, ids in zip(words, v.encode_words([w.encode() for w in words]), strict=True):
        assert ids.tolist() == reference._encode_single_piece(word)


def test_what_is_kept_is_bounded(reference):
    chunks = vocabulary.Chunks(lambda texts: texts, limit=10)
    for i in range(50):
        assert chunks.values([f"a b{i} c{i}"]) == [["a", f" b{i}", f" c{i}"]]
    assert len(chunks.tail.young) + len(chunks.tail.old) <= 26


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(dimensions, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = packing.hilbert(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    assert np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1).max() == 1


@pytest.mark.parametrize("length", [1024, 64, 1])
def test_packing(spark, length):
    docs = docs_of(spark)
    out = packing.pack(docs, JSON, length).collect()
    tokenizer = Tokenizer.from_file(JSON)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(TEXTS) if i != 1} | {None: [*tokenizer.encode("a b", add_special_tokens=False).ids, 0]}
    rows = {}
    for r in out:
        rows.setdefault(r.doc_id, []).append(r)
    assert len(rows.pop(1)) == 2  # a repeated row
    for doc_id, found in rows.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[doc_id])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc_id][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[doc_id])
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in sequences.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= length and not at & (at - 1)


def test_equal_rows_can_go_to_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_TOKENS", 100)
    docs = spark.createDataFrame([(None, "the same words in every row of this table", "")] * 200, "doc_id long, text string, ids string")
    out = packing.pack(docs, JSON, 16).collect()
    assert len({r.sequence_id >> 40 for r in out}) > 5 and sum(r.length for r in out) == 200 * out[0].doc_tokens


def test_added_tokens_are_those_of_the_library():
    ids = packing._encode(JSON)("a <|endoftext|> b")
    assert ids == Tokenizer.from_file(JSON).encode("a <|endoftext|> b", add_special_tokens=False).ids and 50256 in ids


def test_packing_nothing(spark):
    assert packing.pack(docs_of(spark).where("false"), JSON).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs_of(spark), JSON, 0)


def test_neighbours_on_the_curve_are_alike():
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 100, 300) for _ in range(40)] + [rng.integers(20_000, 20_100, 300) for _ in range(40)]
    order = packing.curve_keys(ids).argsort() >= 40
    assert (np.diff(order.astype(int)) != 0).sum() < 20
