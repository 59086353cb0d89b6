"""Fingerprints, BK-trees, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vicinity.llm import simhash
from vicinity.llm.components import components


def plain_fingerprint(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius):
    root = {v: v for v in values}
    for _ in values:
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= radius:
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_fingerprints():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("aBÉ \t\n\x1c x") for _ in range(rng.randint(0, 40)))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n") == 0


def test_hash_is_the_one_of_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)).astype(np.int64)


@pytest.mark.parametrize("seed", range(5))
def test_shards_connect_what_pairs_connect(seed):
    rng = random.Random(seed)
    values = list({rng.getrandbits(8) << 20 | rng.getrandbits(4) for _ in range(60)})
    tree = simhash.BKTree()
    for v in values:
        assert {tree.values[i] for i in tree.near(v, 2)} == {w for w in tree.values if (v ^ w).bit_count() <= 2}
        tree.add(v)
    expected = plain_components(values, 2)
    assert dict(simhash.shard_links(values)) == {v: r for v, r in expected.items() if v != r}


@pytest.mark.parametrize("shard", [1024, 2])
def test_links_over_all_shards(spark, monkeypatch, shard):
    """Also with shards so small that all are filed again."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = set(base)
    for b in base:
        for _ in range(8):
            b ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(b)
    for _ in range(30):
        values.add(rng.getrandbits(64))
    signed = {int(np.uint64(v).astype(np.int64)): v for v in values}
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {r.node: r.component for r in components(simhash.links(fps)).collect()}
    groups = {}
    for s, v in signed.items():
        groups.setdefault(found.get(s, s), set()).add(v)
    expected = {}
    for v, r in plain_components(list(values), 2).items():
        expected.setdefault(r, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5), (100, 101), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def docs_of(spark):
    text = " ".join(f"word{i} is" for i in range(200))
    rows = [(5, text, 1), (3, text, 2), (9, text + " end", 3), (4, None, 4), (8, " ", 5), (7, "alone here", 6), (None, text, 7), (3, text, 2), (None, "only without id", 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp int")


def test_near_duplicates(spark):
    out = simhash.near_duplicates(docs_of(spark)).collect()
    found = {r.doc_id: r.component_id for r in out if r.doc_id is not None}
    assert len(out) == 9
    assert found[5] == found[3] == found[9] == 3 and found[4] == found[8] == 4 and found[7] == 7
    assert sorted((r.component_id is None, r.component_id or 0) for r in out if r.doc_id is None) == [(False, 3), (True, 0)]
    assert simhash.near_duplicates(docs_of(spark).where("false")).count() == 0


def test_one_of_each_group_stays(spark):
    kept = simhash.keep_one(docs_of(spark))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fp) for r in kept.collect()) == [(-1, 8), (3, 2), (4, 4), (7, 6)]


def test_clashing_columns_and_nothing(spark):
    docs = docs_of(spark).selectExpr("doc_id", "text", "fp as id", "'a' as h", "2 as row", "3 as component", "4 as __fp")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and all((r.h, r.row, r.component, r["__fp"]) == ("a", 2, 3, 4) for r in kept.collect())
    assert sorted(r.id for r in kept.collect()) == [2, 4, 6, 8]
    assert simhash.keep_one(docs.where("false")).count() == 0
