from __future__ import annotations

import random

import pytest

from lintel.llm import edit_counts, queries, tokenizer
from lintel.llm.edit_counts import Edit, TokenTree

from .conftest import odd_rows, prose


@pytest.fixture(scope="module")
def count():
    with open(tokenizer.VOCABULARY, "rb") as f:
        encode = tokenizer.encoder(f.read()).encode_ordinary
    return lambda text: len(encode(text))


def scraps(r, n):
    return "".join(r.choice(["the ", "cat's", " ", "  ", "\n", "99 ", "é", "...", "dog", " dog", "  \n ", "x", "'", "l", "ve", "'r"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(4))
def test_totals_after_random_edits(count, seed):
    r = random.Random(seed)
    for _ in range(150):
        tree = TokenTree(scraps(r, r.randint(0, 300)), count)
        assert tree.total == count(tree.text)
        for _ in range(3):
            text, edits = tree.text, []
            for _ in range(r.randint(0, 4)):
                a = r.randint(0, len(text))
                edits.append(Edit(a, min(len(text), a + r.choice([0, 0, 1, 3, 40])), scraps(r, r.randint(0, 6))))
            end, pieces, taken = 0, [], []
            for e in sorted(edits, key=lambda e: (e.start, e.end)):
                if (not taken or e.start >= taken[-1].end) and (e.start < e.end or e.put):
                    taken.append(e)
            for e in taken:
                pieces += [text[end : e.start], e.put]
                end = e.end
            tree.apply(edits)
            assert tree.text == "".join([*pieces, text[end:]])
            assert tree.total == count(tree.text)
            assert TokenTree(tree.text, None, tree.leaves).sums == tree.sums
            assert sum(tree.leaves[0]) == len(tree.text)
            assert all(tree.sums[i] == tree.sums[2 * i] + tree.sums[2 * i + 1] for i in range(1, tree.width))


def test_only_touched_regions_are_encoded(count):
    tree = TokenTree(prose(1, 20_000), count)
    again = tree.apply([Edit(50_000, 50_003, "xyz"), Edit(len(tree.text), len(tree.text), " end")])
    assert tree.total == count(tree.text) and again < 200


def test_query_matches_full_counts(spark, count):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = queries.op8_edit_aware_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len(docs) and sum(r["n_edits"] for r in out) > 0
    for r in out:
        text = docs[r["doc_id"]] or ""
        tree = TokenTree(text, count)
        tree.apply(queries._masks(text))
        assert (r["n_tokens"], r["n_tokens_after"], r["n_characters_after"]) == (count(text), count(tree.text), len(tree.text))


def test_edit_columns_odd_and_empty(spark, odd, empty):
    rows = [(1, "one two three", [(0, 3, "four"), (4, 7, None)]), (2, None, None), (3, "", [(0, 5, "new")]), (4, "abc", [(2, 1, "x"), (-5, 90, "y")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,put:string>>")
    got = {r["doc_id"]: (r["n_characters_after"], r["n_edits"]) for r in edit_counts.count_edited(docs, "edits").collect()}
    assert got == {1: (len("four  three"), 2), 2: (0, 0), 3: (3, 1), 4: (1, 2)}
    assert edit_counts.count_edited(odd, queries._masks).count() == len(odd_rows())
    assert edit_counts.count_edited(empty, queries._masks).count() == 0


def test_a_second_round_starts_from_the_tree(spark, count):
    rows = [(i, prose(40 + i, 300), [(10, 30, "one"), (900, 905, None)], [(0, 4, ""), (500, 500, " it's more ")]) for i in range(5)] + [(9, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, one array<struct<start:int,end:int,put:string>>, two array<struct<start:int,end:int,put:string>>")
    first = edit_counts.count_edited(docs, "one", carry=("doc_id", "two"))
    second = edit_counts.count_edited(first, "two", "text_after", tree=("leaf_lengths", "leaf_counts")).collect()
    for r in second:
        assert r["n_tokens_after"] == count(r["text_after"]) and r["n_again"] < 100
        assert r["n_characters_after"] == len(r["text_after"])


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", 5, 6)], "doc_id long, __text string, N_tokens int, tree int")
    out = edit_counts.count_edited(docs, lambda text: [], "__text", ("doc_id", "N_tokens", "__text", "tree"))
    assert out.columns[:4] == ["doc_id", "N_tokens_in", "__text", "tree"] and out.first()["n_tokens"] == 2


def test_a_text_without_edits_has_no_heap(count):
    counts = edit_counts.Counter(lambda token: range(count(token)))
    tree = TokenTree(prose(3, 2_000), counts.__getitem__)
    assert tree.total == count(tree.text) and sum(tree.leaves[1]) == tree.total and tree.apply([]) == 0
    assert "sums" not in tree.__dict__ and "starts" not in tree.__dict__
    tree.apply([Edit(5, 9, " it's ")])
    assert tree.total == count(tree.text) == tree.sums[1] and sum(tree.leaves[0]) == len(tree.text)


def test_a_full_memory_starts_anew(count, monkeypatch):
    monkeypatch.setattr(edit_counts, "REMEMBERED", 7)
    counts = edit_counts.Counter(lambda token: range(count(token)))
    text = prose(4, 500)
    assert TokenTree(text, counts.__getitem__).total == count(text) and len(counts) <= 7


def test_leaves_of_another_text():
    for leaves in (([3], [1]), ([2, 2], [1])):
        with pytest.raises(ValueError):
            TokenTree("four", None, leaves)
