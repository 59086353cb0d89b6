"""Signatures, likeness and the edited texts against a plain loop."""

import hashlib
import random

import numpy as np
import pytest

from vicinity.llm import linking, spotsigs


def test_signatures_and_likeness():
    a, b = spotsigs.signatures("The cat sat of mats and the dog ran"), spotsigs.signatures("the CAT, sat")
    assert len(a) == 4 and len(b) == 1 and spotsigs.likeness(a, b) == 1 / 4
    assert spotsigs.likeness(a, b, 0.5) == 0.0 and spotsigs.likeness(a, a, 0.9) == 1.0
    assert (spotsigs.read(spotsigs.show(a)) == a).all()
    for text in ("", " .", "word", "no anchor words here", "the", "the x"):
        assert len(spotsigs.signatures(text)) >= 1
    assert (spotsigs.signatures("ab cd") != spotsigs.signatures("ab ce")).any()


def test_sets_with_few_anchors_are_covered_by_runs_of_words():
    text = "the cat sat " + " ".join(f"w{i}" for i in range(300))
    other = text.replace("w250", "x250")
    a, b = spotsigs.signatures(text), spotsigs.signatures(other)
    assert len(a) > 250 and 0.9 < spotsigs.likeness(a, b) < 1


@pytest.mark.parametrize("least", [(1, 2), (4, 5), (9, 10)])
def test_near_sets_share_a_key(least):
    """Any two sets of the least Jaccard or more are filed under a common signature and size class."""
    rng, loads = np.random.default_rng(2), np.random.default_rng(3).integers(0, 50, 1 << 16)
    found = 0
    for _ in range(3000):
        same, own = rng.integers(0, 1 << 32, rng.integers(1, 40), dtype=np.uint32), rng.integers(0, 1 << 32, rng.integers(0, 12), dtype=np.uint32)
        k = rng.integers(0, len(own) + 1)
        a, b = np.unique(np.concatenate([same, own[:k]])), np.unique(np.concatenate([same, own[k:]]))
        if least[1] * len(np.intersect1d(a, b)) >= least[0] * len(np.union1d(a, b)):
            found += 1
            assert set(spotsigs.keys(a, loads, least).tolist()) & set(spotsigs.keys(b, loads, least).tolist())
    assert found > 300


def families(rng, n):
    """Texts in families of edited copies, all with the same common words."""
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(3000)}"
    texts = []
    for _ in range(n):
        first = [word() for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, 9)):
            text = list(first)
            for _ in range(rng.randint(0, len(text) // 25)):
                text[rng.randrange(len(text))] = word()
            texts.append(" ".join(text))
    return texts


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linking, "PART", 100)
    texts = families(random.Random(5), 40)
    texts += [texts[0], texts[1].upper(), "", None, "one", "  "]
    rows = [(i * 7 % 1009 if i % 11 else None, t, 1) for i, t in enumerate(texts)]
    sets, group = [set(spotsigs.signatures(t or "").tolist()) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert 40 < len(set(group)) < len(texts) - 40
    least = {g: min((i for (i, _, _), h in zip(rows, group, strict=True) if h == g and i is not None), default=None) for g in set(group)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, group_id int").repartition(5)
    found = spotsigs.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.group_id) for r in found), key=str) == sorted(((i, least[g]) for (i, _, _), g in zip(rows, group, strict=True)), key=str)
    assert spotsigs.near_duplicates(docs.where("false")).count() == 0


def test_against_edits(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["the", "of", "and", "cat", "dog", "é", "mat", "run"]) for _ in range(rng.randint(0, 60)))
    rows = [(i * 3 - 50, text()) for i in range(120)] + [(1000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {r.doc_id: r for r in spotsigs.against_edits(docs).collect()}
    assert len(found) == len(rows)
    ordered = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        k = len(t) // 3
        other, r = t[: len(t) - k] + following[:k], found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(other.encode()).hexdigest())
        sets = [set(spotsigs.signatures(x).tolist()) for x in (t, other, following)]
        assert r.near_edited == len(sets[0] & sets[1]) / len(sets[0] | sets[1]) and r.near_next == len(sets[0] & sets[2]) / len(sets[0] | sets[2])
        assert r.fingerprint == spotsigs.show(spotsigs.signatures(t)) and r.edited_fingerprint == spotsigs.show(spotsigs.signatures(other))


def test_edge_cases(spark):
    one = spark.createDataFrame([(4, "the cat sat", 1)], "doc_id long, text string, near_next int")
    (row,) = spotsigs.against_edits(one).collect()
    assert row.near_next == 1.0
    assert spotsigs.against_edits(one.where("false")).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "c"), (1, None), (1, "the x y z" * 20_000), (1, None)], "doc_id long, text string")
    assert len(spotsigs.against_edits(odd).collect()) == 5
    nulls = spark.createDataFrame([(None, "a b"), (None, "c")], "doc_id long, text string")
    assert spotsigs.against_edits(nulls).count() == 2
    assert spotsigs.fingerprints(odd).where("size(signs) > 0").count() == 5


def test_rows_of_one_id_are_in_several_ranges(spark):
    docs = spark.createDataFrame([(None if i % 3 else 7, f"the cat number{i} sat of a mat{i}") for i in range(300)], "doc_id long, text string").repartition(3)
    assert spotsigs._in_ranges(docs).where("not beside").select("range", "doc_id").distinct().groupBy("doc_id").count().where("count < 4").count() == 0
    hashed = docs.selectExpr("doc_id", "text", "xxhash64(text) h").collect()
    ordered = sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h), reverse=True)
    expected = sorted(hashlib.sha256(spotsigs.edited(a.text, b.text).encode()).hexdigest() for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True))
    assert sorted(r.edited_sha256 for r in spotsigs.against_edits(docs).collect()) == expected
