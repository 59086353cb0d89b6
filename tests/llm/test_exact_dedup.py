"""Exact duplicates against a dictionary of texts."""

import hashlib
import random
import string

import pytest

from vicinity.llm import exact_dedup
from vicinity.llm.exact_dedup import deduplicate

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows):
    """(id, id that stays, size, digest) of every row, and how many rows stay of each text."""
    of = {}
    for i, t in rows:
        of.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for t, ids in of.items():
        best = max((i for i in ids if i is not None), default=None)
        out += [(i, best, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr), len(of)


def check(found, rows):
    expected, groups = plain(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == expected
    kept = [r for r in found if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def made():
    rng = random.Random(2)
    base = ["".join(rng.choice("abÀà \n\U0001f600") for _ in range(n)) for n in (0, 1, 63, 64, 65, 500, 1087, 1088, 1089, 20_000)]
    texts = [*base, None, "x" * 64, "X" * 64, "ß", "ẞ", "İ", "i̇", "É", "é"]
    for t in base[5:]:
        at = rng.randrange(len(t))
        texts += [t[:at] + "q" + t[at + 1 :], t[:-1] + "z", t + " ", t.upper(), t.translate(LOWER)]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(1000 + i, "the same") for i in range(300)]
    return rows + [(None, base[5]), (None, None), (None, "alone"), (None, "two"), (None, "Two"), (7, rows[7][1]), (7, rows[7][1]), (7, "other")]


@pytest.mark.parametrize("sizes", [(64, 16, 1 << 20), (1, 1, 1), (2, 3, 9)])
def test_against_a_dictionary(spark, monkeypatch, sizes):
    """Also byte by byte, and with digits that stop growing."""
    rows = made()
    if sizes[2] < 64:
        rows = [r for r in rows if len(r[1] or "") < (40 if sizes[2] == 9 else 8)]
    for name, value in zip(("FIRST", "GROWTH", "WIDEST"), sizes, strict=True):
        monkeypatch.setattr(exact_dedup, name, value)
    check(deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), rows)


def test_long_texts_that_differ_at_the_end(spark):
    long = "word " * 500_000
    rows = [(1, long + "a"), (2, long + "b"), (3, long + "A"), (4, long)]
    check(deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (None, None)], "doc_id int, text string")
    clash = docs.selectExpr("*", "1 as row", "2 as n", "'g' as `group`", "3 as digit", "4 as rest", "5 as next", "6 as keep_id", "'s' as sha")
    found = deduplicate(clash)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in found.collect()) == [(0, 0, 1, True), (1, 2, 2, False), (2, 2, 2, True)]
    assert deduplicate(docs.where("false")).count() == 0
