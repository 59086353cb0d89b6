"""The near-dedup stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from vicinity.llm import linking, resemblance
from vicinity.llm.components import components


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    sets, group = [plain_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and (a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j])):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def family(rng, words, copies, edits):
    """A text and copies of copies of it, each with some words changed."""
    texts = [[f"w{rng.randrange(5000)}" for _ in range(words)]]
    for _ in range(copies):
        text = list(rng.choice(texts))
        for _ in range(rng.randint(1, edits)):
            text[rng.randrange(words)] = f"w{rng.randrange(5000)}"
        texts.append(text)
    return [" ".join(t) for t in texts]


def test_bands_find_pairs_at_the_threshold():
    rng = random.Random(3)
    for _ in range(300):
        same = [rng.getrandbits(64) for _ in range(80)]
        a, b = (resemblance.np.array(sorted(same + [rng.getrandbits(64) for _ in range(10)]), resemblance.np.uint64) for _ in range(2))
        assert set(resemblance.bands(a)) & set(resemblance.bands(b))
    assert resemblance.bands(resemblance.shingles(b" ")) == []


def test_stage_equals_brute_force(spark):
    rng = random.Random(11)
    texts = [t for words, copies, edits in [(60, 12, 3), (120, 12, 6), (300, 20, 10), (40, 8, 2), (9, 6, 1)] for t in family(rng, words, copies, edits)]
    texts += [texts[0], texts[5].upper(), "", None, "two words", "two  words", "other words"] + [" ".join(f"x{rng.random()}" for _ in range(50)) for _ in range(20)]
    rows = [(i if i % 9 else None, t, 7 * i) for i, t in enumerate(texts)]
    group = plain_groups(texts)
    expected = sorted(str(min((rows[i][0] for i, g in enumerate(group) if g == n and rows[i][0] is not None), default=None)) for n in set(group))
    assert 30 < len(expected) < len(texts) - 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(5)
    kept = corpus_pipeline.without_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == expected


def test_exact_boundary(spark):
    """8 shingles of 10 are linked, 7 of 9 are not."""
    text = lambda of, shared, last: " ".join([*(f"{of}{i}" for i in range(shared)), last])
    rows = [(1, text("v", 12, "a")), (2, text("v", 12, "b")), (3, text("z", 11, "a")), (4, text("z", 11, "b"))]
    assert sorted(r.doc_id for r in resemblance.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 3, 4]
    assert resemblance.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_stay_within_the_radius():
    """Sets at a similarity of 0.8, of all sizes, are within the radius of the BK-trees."""
    rng = random.Random(6)
    for _ in range(1500):
        size = rng.choice([4, 8, 8, 12, 20, 80, 400])
        same, own = [rng.getrandbits(64) for _ in range(size)], rng.randint(0, size // 4)
        a, b = (resemblance.np.array(sorted(same + [rng.getrandbits(64) for _ in range(n)]), resemblance.np.uint64) for n in (own, size // 4 - own))
        far = sum((x ^ y).bit_count() for x, y in zip(resemblance.prints(a), resemblance.prints(b), strict=True))
        assert far <= resemblance.RADIUS


def test_parts_of_a_shard_connect_what_pairs_connect(spark, monkeypatch):
    """Shards cut into small parts, with several families in one shard, against all pairs."""
    monkeypatch.setattr(linking, "PART", 3)
    monkeypatch.setattr(linking, "OTHERS", 2)
    values = [1, 2, 3, 10, 11, 12, 13, 20, 30, 31, 32, 33, 34]
    chain = lambda a, b: abs(a - b) == 1

    def near(pairs):
        return spark.createDataFrame([(r.a, r.b) for r in pairs.collect() if chain(r.a, r.b)], "a long, b long")

    def settle(rows):
        groups = {}
        for r in rows.collect():
            groups.setdefault((r.key, r.part, r.block), []).append(r)
        assert all(len(g) < 12 for g in groups.values()) and len(groups) > 8
        return spark.createDataFrame([(q.fp, m.fp) for g in groups.values() for q in g for m in g if q.other and not m.other and q.component != m.component and chain(q.fp, m.fp)], "a long, b long")

    filed = spark.createDataFrame([(7, v, 1) for v in values] + [(8, 13, 1), (8, 14, 1), (9, 99, 1)], "key long, fp long, n long")
    found = {r.node: r.component for r in components(linking.connect(filed, near, settle)).collect()}
    assert found == {**dict.fromkeys([1, 2, 3], 1), **dict.fromkeys([10, 11, 12, 13, 14], 10), **dict.fromkeys([30, 31, 32, 33, 34], 30)}
    assert linking.connect(filed.where("false"), near, lambda rows: rows.selectExpr("fp as a", "fp as b")).count() == 0


def test_small_parts_give_the_same_stage(spark, monkeypatch):
    monkeypatch.setattr(linking, "PART", 100)
    monkeypatch.setattr(linking, "OTHERS", 100)
    rng = random.Random(21)
    base = [f"w{rng.randrange(9000)}" for _ in range(60)]
    texts = [" ".join(base)]
    for _ in range(30):  # each near the first, most of them not near each other
        text = list(base)
        text[rng.randrange(60)] = f"x{rng.randrange(9000)}"
        texts.append(" ".join(text))
    texts += [" ".join([f"y{i}", *base[: 40 - i]]) for i in range(12)]
    group = plain_groups(texts)
    kept = resemblance.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(i for i, h in enumerate(group) if h == g) for g in set(group))


def test_trees_find_what_a_scan_finds(monkeypatch):
    monkeypatch.setattr(resemblance, "LEAF", 5)
    rng = resemblance.np.random.default_rng(4)
    prints = rng.integers(0, 1 << 64, (300, resemblance.PIECES), resemblance.np.uint64)
    prints[100:200] = prints[7]
    prints[200:] = prints[3] ^ (rng.integers(0, 1 << 64, (100, resemblance.PIECES), resemblance.np.uint64) & rng.integers(0, 1 << 64, (100, resemblance.PIECES), resemblance.np.uint64))
    tree = resemblance.Tree(prints)
    for q in range(0, 300, 13):
        for radius in (0, 60, 79):
            assert sorted(tree.near(prints[q], radius).tolist()) == [i for i in range(300) if resemblance._far(prints[i], prints[q]) <= radius]
    assert len(resemblance.Tree(prints[:0]).near(prints[0], 79)) == 0


def test_a_shared_passage_costs_no_check_of_its_own_for_each_pair(monkeypatch):
    """Texts that share a passage and few of which are near: the links of brute force, by one check a text looked up."""
    np, pa = resemblance.np, resemblance.pa
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(70)]
    texts = [" ".join(passage + [f"o{rng.random()}" for _ in range(10 + i % 9)]) for i in range(60)]
    texts += [t + " end" for t in texts[:15]]
    sets = [resemblance.shingles(t.encode()) for t in texts]
    key = int(resemblance._longs(resemblance.bands(sets[0])[:1])[0])
    rows = []
    for other in (False, True):
        for i, s in enumerate(sets):
            keys = [key, *range(100 * i, 100 * i + resemblance.BANDS - 1)]  # only the first is shared
            rows.append({"fp": i, "component": i, "other": other, "prints": resemblance._longs(resemblance.prints(s)).tolist(), "keys": keys, "hashes": resemblance.short(s).tolist()})
    longs = pa.list_(pa.int64())
    kind = pa.struct([("fp", pa.int64()), ("component", pa.int64()), ("other", pa.bool_()), ("prints", longs), ("keys", longs), ("hashes", pa.list_(pa.int32()))])
    calls, plain = [], np.intersect1d
    monkeypatch.setattr(np, "intersect1d", lambda *a, **b: calls.append(1) or plain(*a, **b))
    found = resemblance.tree_links(key, pa.array(rows[:1] + rows, kind).slice(1))
    group = list(range(len(texts)))
    for a, b in found:
        old, low = max(group[a], group[b]), min(group[a], group[b])
        group = [low if g == old else g for g in group]
    want = plain_groups(texts)
    assert group == want and len(texts) - 15 >= len(set(want)) > 20
    assert len(calls) <= len(texts)


def test_links_that_differ_between_evaluations(spark):
    """Edges that connect the same nodes by other links each time they are evaluated are one component."""

    def star(batches):
        for _ in batches:
            middle = random.SystemRandom().randrange(60)
            others = [i for i in range(60) if i != middle]
            yield resemblance.pa.RecordBatch.from_pydict({"a": [middle] * 59, "b": others})

    edges = spark.range(1, numPartitions=1).mapInArrow(star, "a long, b long")
    for _ in range(2):
        assert {r.node: r.component for r in components(edges).collect()} == dict.fromkeys(range(60), 0)


def test_clashing_columns(spark):
    rows = [(1, "the same text of some words here", "x"), (2, "the same text of some words here", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").selectExpr("*", "fp as id", "fp as row", "fp as hashes", "fp as component")
    kept = resemblance.keep_one(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, rows[0][1], "x", "x", "x", "x", "x")]
