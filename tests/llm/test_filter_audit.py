"""The audit against a simulation of every order, document by document."""

import random
import re
from itertools import permutations

from vicinity.llm.filter_audit import FILTERS, audit, masks


def fails(docs):
    out = []
    for i, text, _ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        earlier = any((j is not None) and (i is None or j < i) and (u or "") == t for j, u, _ in docs)
        out.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": earlier})
    return out


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    bad, out = fails(docs), []
    for part in {lang or "" for *_, lang in docs}:
        mine = [(i, f) for (i, _, lang), f in zip(docs, bad, strict=True) if (lang or "") == part]
        share, rows = dict.fromkeys(FILTERS, 0), []
        for order in permutations(FILTERS):
            left = mine
            for n, c in enumerate(order, 1):
                gone = [d for d in left if d[1][c]]
                left = [d for d in left if not d[1][c]]
                share[c] += len(gone)
                failing = [d for d in mine if d[1][c]]
                only = sum(sum(f.values()) == 1 for _, f in failing)
                rows.append((c, part, "".join(order), n, len(left), len(gone), len(failing) - len(gone), only, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out += [(*r[1:], share[r[0]]) for r in rows]
    return sorted(out)


def made():
    rng = random.Random(9)
    words = [f"w{n}" for n in range(400)] + ["Big", "#tag", "é x", "a\x0bb"]

    def text():
        n = rng.choice([0, 3, 199, 200, 260])
        return rng.choice([" ", "\n\t", "  "]).join(rng.choice(words[: rng.choice([20, 400, 404])]) for _ in range(n)) + rng.choice(["", "", "A" * 40, "|", " "])

    texts = [text() for _ in range(60)] + [None, "", " ", "\x00"]
    docs = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(150)]
    docs += [(None, texts[0], "en"), (None, texts[0], "fr"), (None, "only without id", "en"), (None, "only without id", "en"), (3, docs[3][1], docs[3][2]), (3, "other", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def tables(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_every_order_against_a_simulation(spark):
    docs, labels = made()
    assert sorted(map(tuple, audit(*tables(spark, docs, labels)).collect())) == plain(docs, labels)


def test_masks(spark):
    docs, labels = made()
    found = {(r.part, r["mask"]): r.n for r in masks(*tables(spark, docs, labels)).collect()}
    expected = {}
    for (*_, lang), f in zip(docs, fails(docs), strict=True):
        key = lang or "", sum(1 << i for i, c in enumerate(FILTERS) if f[c])
        expected[key] = expected.get(key, 0) + 1
    assert found == expected


def test_edge_cases(spark):
    docs, labels = tables(spark, [(1, None, None)], [(1, 1, 1)])
    rows = audit(docs, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and {r.kept for r in rows if r.step == 5} == {0}
    assert audit(docs.where("false"), labels).count() == 0
    clash = docs.selectExpr("doc_id", "text", "lang", "1 as n", "2 as mask", "'p' as part", "3 as good", "4 as id", "5 as step", "6 as at", "7 as same")
    assert sorted(map(tuple, audit(clash, labels.selectExpr("*", "1 as n", "2 as id", "'x' as part")).collect())) == sorted(map(tuple, rows))
    assert {r.good_lost for r in audit(docs, labels.where("false")).collect()} == {0}


def test_very_long_and_very_many(spark):
    docs = [(1, "word " * 300_000, "en")] + [(i, "the same text", "en") for i in range(2, 3000)]
    rows = audit(*tables(spark, docs, [(2, 1, 0)])).where("filter_order = 'EABCD'").orderBy("step").collect()
    assert [(r.kept, r.removed) for r in rows] == [(2, 2997), (1, 1), (0, 1), (0, 0), (0, 0)]
