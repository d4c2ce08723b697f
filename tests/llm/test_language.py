from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from lintel.llm import language

LANGS = {"en": "the of and to in that this with from have ", "fr": "le de la et les des dans une pour que éèç ", "de": "der die und das ist nicht mit für ein ü ö ß "}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for k, (lang, words) in enumerate(LANGS.items()):
        own = words.split()
        rows += [(1000 * k + i, " ".join(own[(i * 7 + j * 3 + j * j) % len(own)] for j in range(30)), lang) for i in range(60)]
    rows += [(9000, None, "en"), (9001, "", "fr"), (9002, "1234 !!", None), (None, "the of and", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_learns_and_predicts(labelled):
    profiles = language.learn(labelled, sample=40)
    assert [name for name, _ in profiles] == ["de", "en", "fr"]
    out = language.predict(labelled, profiles, carry=("doc_id", "lang")).collect()
    assert len(out) == labelled.count()
    known = [r for r in out if r["lang"] and r["doc_id"] is not None and r["doc_id"] < 9000]
    assert np.mean([r["lang"] == r["lang_pred"] for r in known]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    assert all(r["lang_pred"] == "und" for r in out if r["doc_id"] in (9000, 9001, 9002))


def test_same_profiles_whatever_the_partitions(labelled):
    assert language.learn(labelled) == language.learn(labelled.repartition(7))


def test_empty(odd, empty):
    assert language.learn(empty) == []
    assert language.predict(empty, []).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd, []).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from lintel.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = queries.op1_identify_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert len(out) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.98


def test_n_grams_of_words_only():
    assert len(language.n_grams("12 !? ")) == 0
    codes = language.n_grams("Ab")
    assert len(codes) == 2 + 3 + 2
    assert np.array_equal(np.sort(language.n_grams("ab, AB")), np.sort(np.concatenate([codes, codes])))


def grams(text):
    """The 1-, 2- and 3-grams of words in blanks, as texts."""
    out = []
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        held = f" {word} "
        out += [*word, *(held[i : i + 2] for i in range(len(held) - 1)), *(held[i : i + 3] for i in range(len(held) - 2))]
    return out


def code(gram):
    points = [0 if c == " " else ord(c) for c in gram]
    value = 0
    for p in points:
        value = (value << 21) | p
    return value | {1: (1 << 63) | (1 << 62), 2: 1 << 63, 3: 0}[len(gram)]


def ranked(counts, top):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:top]]


def test_matches_plain_python(spark, labelled):
    """Profiles, distances, predictions and scores by texts and dictionaries; very long, repeated and tied texts among them."""
    rows = [tuple(r) for r in labelled.collect()] + [(9100, "the of and " * 5_000, None), (9101, "x", None), (9102, "ß", None), (9101, "x", None), (9103, "ẞİ ﬁ ª", None)]
    profiles = language.learn(labelled)
    counted = {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            counted.setdefault(lang, Counter()).update(grams(text))
    want = {lang: ranked(c, language.TOP) for lang, c in counted.items() if c}
    assert {name: [np.int64(x).view(np.uint64).item() for x in codes] for name, codes in profiles} == {name: [code(g) for g in own] for name, own in want.items()}

    def judged(text):
        own = ranked(Counter(grams(text or "")), language.TOP)
        if not own:
            return "und", 0.0
        apart = {name: sum(abs(i - known[g]) if g in known else language.TOP for i, g in enumerate(own)) for name, p in want.items() for known in [{g: i for i, g in enumerate(p)}]}
        best = min(sorted(apart), key=lambda n: apart[n])
        return best, 1 - min(1, apart[best] / (language.TOP * len(own)))

    out = language.predict(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), profiles, carry=("doc_id", "text")).collect()
    for r in out:
        assert r["lang_pred"] == judged(r["text"])[0] and r["score"] == pytest.approx(judged(r["text"])[1]), r["text"] and r["text"][:40]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the", "a", 2.0)], "doc_id long, __text string, Lang_Pred string, score double")
    out = language.predict(docs, [], "__text", ("doc_id", "Lang_Pred", "score", "__text"))
    assert out.columns == ["doc_id", "Lang_Pred_in", "score_in", "__text_in", "lang_pred", "score"]


def test_more_labels_than_are_learnt(spark, labelled, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    assert [name for name, _ in language.learn(labelled)] == ["de", "fr"]
