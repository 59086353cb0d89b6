"""The stages over planted documents, each against what it must keep and drop."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from vicinity.llm import quality, toxicity

from .test_pii import plain
from .test_resemblance import plain_groups


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    prose = lambda: " ".join("".join(rng.choice(["the", "an", "er", "ing", "st", "ou"]) for _ in range(rng.randint(1, 3))) for _ in range(90))
    docs, labels = [], []
    for i in range(400):
        text = prose()
        bad, toxic = i % 5 == 0, i % 7 == 0
        text = text.upper().replace(" ", "!! ") if bad else text
        text = text.replace(" ", " moron ", 3).replace(" ", " scum ", 3) if toxic and not bad else text
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), int(toxic and not bad)))
    clean = prose()
    docs += [(1000, clean, "en", "s", 0), (1001, clean, "en", "s", 0), (1001, clean, "en", "s", 0), (1002, prose() + " write to someone@example.com now", "en", "s", 0), (1003, None, None, None, None), (None, prose(), "en", "s", 0)]
    home = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    return home


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus).write.parquet(str(tmp_path / name.replace(" ", "")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "")))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = {name: [r.doc_id for r in rows] for name, rows in kept.items()}
    good, clean, single, masked = (ids[n] for n, _ in corpus_pipeline.STAGES[:4])
    assert not [i for i in good if i is not None and i < 400 and i % 5 == 0]
    assert sum(i is not None and i < 400 for i in good) == 320
    assert not [i for i in clean if i is not None and i < 400 and i % 7 == 0]
    assert single.count(1000) == 1 and 1001 not in single and None in single and len(single) == len(set(single))
    assert sorted(masked, key=str) == sorted(single, key=str)
    text = next(r.text for r in kept["PII"] if r.doc_id == 1002)
    assert "someone@example.com" not in text and "[EMAIL]" in text
    packed = {}
    for r in kept["packing"]:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert set(packed) == set(masked) and all(packed[r.doc_id] == r.doc_tokens for r in kept["packing"])


def test_stages_against_brute_force(spark, corpus):
    """Each stage's decisions, taken one document at a time by the operators' plain functions."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    machine, lexicon = quality.train(docs, labels), toxicity.train(docs, labels)
    rows = [r for r in docs.collect() if machine.score(r.text) >= quality.THRESHOLD and lexicon.score(r.text) < 0.5]
    group = plain_groups([r.text for r in rows])
    least = {}
    for r, g in zip(rows, group, strict=True):
        order = r.doc_id is None, r.doc_id or 0
        least[g] = min(least.get(g, (order, r)), (order, r), key=lambda x: x[0])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {}
    for _, r in least.values():
        expected[r.doc_id] = np.array([*tokenizer.encode(plain_mask(r.text or ""), add_special_tokens=False).ids, 0], "<u4")
    found = corpus_pipeline.run(spark, corpus).collect()
    assert {r.doc_id for r in found} == set(expected)
    for doc_id, ids in expected.items():
        at = 0
        for r in sorted((r for r in found if r.doc_id == doc_id), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def plain_mask(text):
    """Base spans by Python's patterns; the invented prose has no contexts to find more."""
    out, at = "", 0
    for a, b, kind in sorted((a, b, kind) for kind, spans in plain(text).items() for a, b in spans):
        if a >= at:
            out, at = f"{out}{text[at:a]}[{kind.upper()}]", b
    return out + text[at:]


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert set(__spark_entry__.oracle_sql()) <= names
