from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.llm import jaccard
from lintel.llm.components import components, forest

from .conftest import SCHEMA, odd_rows, prose


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """n_shingles, component and number of links of each row by comparing all pairs."""
    sets, parent, links = [sets_of(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b, n = sets[j], len(a & sets[j])
            if n and 100 * n >= 75 * (len(a) + len(b) - n):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [(len(s), least.get(find(i)) if links[i] else rows[i][0], links[i]) for i, s in enumerate(sets)]


def edited(text, r, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    """Unrelated texts, near copies at all distances, chains, a hot group of near copies, a passage that many share, short texts and copies."""
    r, out = random.Random(7), []
    for k in range(12):
        base = prose(200 + k, r.randint(20, 200))
        out += [base, base] + [edited(base, r, r.randint(1, 8)) for _ in range(4)]
        out.append(" ".join(base.split()[: int(len(base.split()) * r.uniform(0.7, 0.9))]))
    chain = prose(300, 150)
    for _ in range(8):
        chain = edited(chain, r, 3)
        out.append(chain)
    hot = prose(301, 80)
    out += [edited(hot, r, r.randint(0, 2)) for _ in range(60)]
    passage = prose(302, 60)
    out += [prose(400 + k, 60) + " " + passage for k in range(40)]
    out += ["a b c", "A B C", "a b", "a b c d e", "a  b\tc d e", "", None, " ", "x"]
    return [(i * 3 % 997, t) for i, t in enumerate(out)]


def got(docs):
    return sorted((tuple(x) for x in jaccard.join(docs).collect()), key=str)


def want(rows):
    return sorted(((k, *b) for (k, _), b in zip(rows, brute(rows), strict=True)), key=str)


def test_matches_all_pairs(spark, rows):
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want(rows)


@pytest.mark.parametrize("most", [50, 100_000])
def test_matches_with_small_blocks(spark, rows, monkeypatch, most):
    monkeypatch.setattr(jaccard, "DOC_BLOCK", 8)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    monkeypatch.setattr(jaccard, "HOT", 6)
    monkeypatch.setattr(jaccard, "FLUSH", 500)
    monkeypatch.setattr(jaccard, "LARGE", 10)
    monkeypatch.setattr(jaccard, "PAIRS", 100)
    monkeypatch.setattr(jaccard, "MOST_FREQUENT", most)
    monkeypatch.setattr(jaccard, "COLUMN_BLOCK", 16)
    part = rows[60:180]
    assert got(spark.createDataFrame(part, "doc_id long, text string").repartition(3)) == want(part)


def test_odd_rows(spark, odd, empty):
    assert got(odd) == want([r[:2] for r in odd_rows()])
    assert jaccard.join(empty).count() == 0


def test_keep_one(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", "s", 1, "q", "x", 1) for k, t in rows] + [(rows[0][0], rows[0][1], "en", "s", 1, "q", "x", 1)], SCHEMA)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    by_key = {k: c for (k, _), (_, c, _) in zip(rows, brute(rows), strict=True)}
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(k for k, c in by_key.items() if k == c)


def test_keep_one_odd(odd, empty):
    kept = jaccard.keep_one(odd).collect()
    # of the copies, the upper-case and the repeated row, the first stays; the longer one is near enough; rows without keys or words stay
    assert sorted(str(x["doc_id"]) for x in kept) == sorted(map(str, [0, 4, 5, 6, 7, 8, 9, 10, None, None]))
    assert jaccard.keep_one(empty).count() == 0


def test_keep_one_of_texts_with_one_key_or_none(spark):
    base = prose(9, 60)
    rows = [(1, base), (1, base + " tail"), (2, base.upper()), (None, base + " end"), (None, "other " * 9), (None, "Other " * 9), (None, "other " * 9)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "None"]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 6000 + i) for i in range(50)]
    found = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    nodes, roots = forest(*(np.array(x) for x in zip(*edges, strict=True)))
    assert found == dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_covers_every_link():
    for n in range(1, 400):
        assert jaccard._prefix(n) == n - -(-75 * n // 100) + 1


@pytest.fixture(scope="module")
def passages():
    """Documents of two out of 40 passages each."""
    r = random.Random(11)
    held = [prose(700 + k, r.randint(25, 45)) for k in range(40)]
    return [(i, " ".join(r.sample(held, 2))) for i in range(1200)]


def test_documents_of_shared_passages_fall_into_small_classes(spark, passages, monkeypatch):
    classes = {}
    real = jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda edges: classes.setdefault(len(classes), real(edges)))
    out = got(spark.createDataFrame(passages, "doc_id long, text string").repartition(4))
    assert out == want(passages)
    linked = sum(1 for *_, links in out if links)
    sizes = [x["n"] for x in classes[1].groupBy("root").count().withColumn("n", F.col("count") + 1).collect()]
    assert max(sizes) <= 40 and sum(sizes) <= 3 * linked


def test_strings_part_where_sizes_do():
    names, sizes = np.array([1, 1, 1, 1, 2]), np.array([10, 13, 40, 60, 61])
    strings = jaccard._strung(names, sizes, np.array([10, 32, 40, 60, 61]))
    assert strings.heads.tolist() == [0, 3, 4] and strings.tops.tolist() == [40, 60, 61] and strings.edges.tolist() == [[0, 0], [1, 2]]
