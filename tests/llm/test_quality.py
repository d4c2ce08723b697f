from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lintel.llm import quality

from .conftest import odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [r[1] for r in odd_rows()] + ["a b c d e " * 7, "a b c d e x a b c d e", "a a a a a a", "same\nsame\nother\nsame \n\n\n", "### a&b <x> |y|", "x" * 5000, prose(9, 300) + "\n" + prose(9, 300)]


def test_counts_match_plain_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    q = F.col("quality")
    got = {r[0]: tuple(r)[1:] for r in quality.assess(docs).select("doc_id", *(q[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), q["base_failed"]).collect()}
    for i, text in enumerate(TEXTS):
        want = brute(text)
        assert got[i] == (*want, want[0] < 10 or 100 * want[4] > 20 * want[0]), text and text[:50]


def test_keep_good_keeps_columns_and_good_rows(odd):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    texts = [r["text"] for r in kept.collect()]
    assert texts and all(t and len(WORD.findall(t)) >= 10 for t in texts)


def test_empty_table(empty):
    assert quality.keep_good(empty).count() == 0
    assert quality.assess(empty).count() == 0


def test_plan_has_no_user_function_and_no_shuffle(odd):
    plan = quality.assess(odd.coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow", plan)


@pytest.mark.parametrize("text,rule", [("### &&& %%% $$$ *** ### the and of to in is", "symbol_ratio"), (" ".join(f"zz{c}qx" for c in "abcdefghijklmnopqrstuvwxy"), "stop_word_ratio"), ("THE!! AND!! OF!! TO!! IN!! IS!! FOR!! ON!! AT!! BY!!", "upper_word_ratio")])
def test_rules(spark, text, rule):
    broken = quality.assess(spark.createDataFrame([(text,)], "text string")).select("quality.broken").first()[0]
    assert rule in broken


def test_short_texts_need_no_stop_words(spark):
    text = "üau heit ie enie chö enkeitstau enchentz schungen qaz wsx"
    assert quality.keep_good(spark.createDataFrame([(text,)], "text string")).count() == 1


def test_a_column_called_quality_stays(spark):
    out = quality.assess(spark.createDataFrame([(1, "a b", "mine")], "doc_id long, text string, Quality string"))
    assert out.columns == ["doc_id", "text", "Quality_in", "quality"] and out.first()["Quality_in"] == "mine"
