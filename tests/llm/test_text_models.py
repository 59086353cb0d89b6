"""Language, toxicity and quality: learnt on small samples, edge cases, and held-out accuracy on invented texts."""

import random

import numpy as np
import pytest

from vicinity.llm import language, quality, toxicity
from vicinity.llm.common import id_bucket, labelled_sample
from vicinity.llm.vocabulary import Recent

SOUNDS = {"en": ["the", "th", "ing", "and", "wh", "er"], "de": ["der", "sch", "ung", "und", "ch", "ö"], "fr": ["le", "eau", "oui", "é", "que", "ç"]}


def words(lang, n, rng):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def field():
    rng = random.Random(1)
    return language.learn([(words(lang, 60, rng), lang) for lang in SOUNDS for _ in range(40)])


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    e, t = rng.random((3, 1, 2)) + 0.1, rng.random((2, 2)) + 0.1
    p, _ = language.forward_backward(e, np.array([3]), t)
    weight = {}
    for path in np.ndindex(2, 2, 2):
        weight[path] = np.prod([e[i, 0, path[i]] for i in range(3)]) * t[path[0], path[1]] * t[path[1], path[2]]
    for i in range(3):
        expected = sum(w for path, w in weight.items() if path[i] == 1) / sum(weight.values())
        assert p[i, 0, 1] == pytest.approx(expected)


def test_rows_of_different_length_do_not_touch_each_other():
    rng = np.random.default_rng(1)
    e, t = rng.random((4, 2, 3)) + 0.1, rng.random((3, 3)) + 0.1
    e[2:, 1] = 1
    both, _ = language.forward_backward(e, np.array([4, 2]), t)
    alone, _ = language.forward_backward(e[:2, 1:], np.array([2]), t)
    assert np.allclose(both[:2, 1], alone[:, 0])


def test_languages_of_held_out_texts(field):
    rng = random.Random(2)
    rows = [(words(lang, rng.randint(5, 80), rng), lang) for lang in SOUNDS for _ in range(30)]
    found = field.label([t for t, _ in rows], Recent(100))
    assert np.mean([f[0] == lang for f, (_, lang) in zip(found, rows, strict=True)]) > 0.95


def test_code_switched_text_goes_to_the_larger_part(field):
    rng = random.Random(3)
    (found,) = field.label([words("de", 60, rng) + " " + words("fr", 10, rng)], Recent(100))
    assert found[0] == "de" and 0.5 < found[1] < 1


def test_language_edge_cases(field):
    found = field.label([None, "", "12 !? _", words("en", 3000, random.Random(4))], Recent(100))
    assert found[:3] == [("und", 0.0)] * 3
    assert found[3][0] == "en" and 0 <= found[3][1] <= 1


def test_letters_only(field):
    assert language.words_of("x² ½ ① a1b été_ok") == ["x", "a", "b", "été", "ok"]
    assert [f[0] for f in field.label(["² ½ ①", "7"], Recent(10))] == ["und", "und"]
    long = "".join(random.Random(1).choice(SOUNDS["fr"]) for _ in range(400))
    assert len(language.word_features(long)) > 2 * len(long) and field.label([long], Recent(10))[0][0] == "fr"


def test_windows_know_their_neighbours(field, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(words(lang, 7, rng) for lang in ("en", "fr", "de", "fr") for _ in range(20)) for _ in range(5)]
    monkeypatch.setattr(language, "WINDOW", 10_000)
    whole = field.label(texts, Recent(5000))
    monkeypatch.setattr(language, "WINDOW", 50)
    assert all(a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-4) for a, b in zip(whole, field.label(texts, Recent(5000)), strict=True))


def test_every_language_is_learnt_and_repeated_rows_once(spark):
    rows = [(None, "le même texte", "fr")] * 500 + [(i, f"lang{i % 70} words{i % 70} here{i % 70}", f"l{i % 70:02}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language.train(docs).languages) == 71


def test_an_id_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "x" * 200_000), (3, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    assert [(r[0], r[2]) for r in labelled_sample(docs, labels, "toxic", 1000, 5, 9)] == [(1, 1), (3, 0)]


def test_language_operator(spark):
    rng = random.Random(5)
    rows = [(i, words(lang, 30, rng), lang if i % 3 else None, "x") for i in range(120) for lang in [list(SOUNDS)[i % 2]]] + [(None, None, None, "x"), (7, "!!", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = language.identify(docs, language.train(docs)).collect()
    assert len(out) == len(rows)
    assert {r.lang_pred for r in out} <= {"en", "de", "und"}
    assert sum(r.lang_pred == "und" for r in out) == 2
    empty = docs.where("false")
    assert language.identify(empty, language.train(empty)).count() == 0


def test_held_out_rows_are_never_learnt_from(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 1000, 5, 0)
    held = {r.doc_id for r in docs.where(id_bucket(5) == 0).collect()}
    assert rows and not held & {r[0] for r in rows}
    assert len(labelled_sample(docs, labels, "toxic", 10, 5, 0)) < 60
    assert labelled_sample(docs, labels.where("false"), "toxic", 10, 5, 0) == []


def test_folding():
    assert toxicity.fold("ІDІ0T  m0r0n") == "idiot  moron"
    assert toxicity.fold("ＳＣＵＭ st​upid") == "scum stupid"
    assert toxicity.fold("in 2024 we paid $50 at 10:30!") == "in 2024 we paid $50 at 10:30!"


def test_lexicon_matches_whole_words_and_excuses_phrases():
    lexicon = toxicity.Lexicon({"trash": 2.0, "clown": 1.0}, exceptions=["trash can"])
    assert lexicon.found("trash, clown; trashy uptrash") == [2.0, 1.0]
    assert lexicon.found("put it in the trash can, clown") == [1.0]
    assert lexicon.found("") == [] and toxicity.Lexicon({}, exceptions=[]).found("trash") == []


def test_matches_equal_a_plain_search():
    rng = random.Random(6)
    lexicon = toxicity.Lexicon({"ab": 1.0, "b": 2.0, "abba": 4.0}, exceptions=["b ab"])
    for _ in range(300):
        text = "".join(rng.choice("ab .") for _ in range(rng.randint(0, 30)))
        excused = {p for m in range(len(text)) if text.startswith("b ab", m) and not text[m - 1 : m].isalpha() and not text[m + 4 : m + 5].isalpha() for p in range(m, m + 4)}
        expected = [w for m in range(len(text)) for t, w in lexicon.weights.items() if text.startswith(t, m) and not (m and text[m - 1].isalpha()) and not text[m + len(t) : m + len(t) + 1].isalpha() and m not in excused]
        assert sorted(lexicon.found(text)) == sorted(expected), text


def test_toxicity_learns_and_keeps_clean_texts(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        text = words("en", 60, rng)
        rows.append((i, text + " you moron idiot scum" if i % 4 == 0 else text, int(i % 4 == 0)))
    lexicon = toxicity.learn([r for r in rows if r[0] < 300])
    assert np.mean([(lexicon.score(t) >= 0.5) == y for i, t, y in rows if i >= 300]) > 0.97
    docs = spark.createDataFrame([(1, "you moron idiot scum", 5), (2, None, 6), (None, "", 7), (3, "the and", 8), (3, "the and", 8)], "doc_id long, text string, score int")
    assert sorted(r.score for r in toxicity.keep_clean(docs, lexicon).collect()) == [6, 7, 8, 8]
    out = toxicity.scores(docs, lexicon).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert toxicity.scores(docs.where("false"), lexicon).count() == 0
    assert 0 <= toxicity.learn([]).score("idiot") <= 1


def test_factorisation_identity():
    rng = np.random.default_rng(8)
    size = quality.STATISTICS + 3 * quality.SIZE_BINS + quality.HASHES
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.FACTORS)))
    at, x = quality.features("some words and some more words!\nand a line")
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert m.raw(at, x) == pytest.approx(0.3 + m.weights[at] @ x + pairs)


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        text = words("en", 80, rng)
        rows.append((i, text if i % 2 else rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "$$$ "), " ".join(w for w in text.split()[:4] for _ in range(20))]), i % 2))
    machine = quality.learn([r for r in rows if r[0] < 200])
    assert np.mean([(machine.score(t) >= quality.THRESHOLD) == y for i, t, y in rows if i >= 200]) > 0.97
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "x" * 200_000), (2, "a b"), (2, "a b")], "doc_id long, text string")
    out = quality.scores(docs, machine).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert quality.scores(docs.where("false"), machine).count() == 0
    assert quality.learn([]).score("text") == 0.5
    assert set(quality.keep_good(docs, machine).columns) == {"doc_id", "text"}
