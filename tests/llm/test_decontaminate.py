from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lintel.llm import decontaminate
from lintel.llm.arrow import windows

from .conftest import SCHEMA, odd_rows, prose

UP = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for name, body in items:
        item = words(body)
        n = min(13, len(item))
        for k in range(len(item) - n + 1 if n else 0):
            for i in range(len(own) - n + 1):
                if own[i : i + n] == item[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(name))
    return len(own), len(hit), sorted(found)


@pytest.fixture(scope="module")
def benchmark_rows():
    return [(1, prose(100, 40)), (2, prose(101, 13)), (10, "tiny item"), (11, prose(100, 40)), (12, None), (None, "x y z"), (13, "!!")]


@pytest.fixture(scope="module")
def texts(benchmark_rows):
    r = random.Random(1)
    one, two = benchmark_rows[0][1], benchmark_rows[1][1]
    out = [r_[1] for r_ in odd_rows()]
    out += [prose(7, 50) + " " + one.upper().replace(" ", ", ") + " " + prose(8, 50), two, prose(9, 400) + " " + two, "a tiny -- ITEM b", " ".join(one.split()[:12]), one + " " + one, prose(7, 20) + " ".join(one.split()[5:19])]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("slice_bytes", [1 << 20, 60])
def test_matches_plain_python(spark, texts, benchmark_rows, slice_bytes):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    items = [(i, t) for i, t in benchmark_rows if i is not None]
    got = {r["c0"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in decontaminate.scan(docs, bench, slice_bytes=slice_bytes).collect()}
    assert got == {i: brute(t, items) for i, t in enumerate(texts)}


def test_clean(spark, texts, benchmark_rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "q", "x", 2) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in decontaminate.clean(docs, bench).collect()}
    for i, t in enumerate(texts):
        n, hit, _ = brute(t, [x for x in benchmark_rows if x[0] is not None])
        assert (i in kept) == (not (hit > 0 and 20 * hit >= n))
        assert i not in kept or kept[i] == t
    cut = decontaminate.clean(docs, bench, spans=True)
    assert cut.columns == docs.columns
    left = decontaminate.scan(cut.select("doc_id", "text"), bench)
    assert left.where("n_hit > 0").count() <= 1


def test_empty(spark, odd, empty, benchmark_rows):
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    nothing = bench.where("false")
    assert decontaminate.clean(empty, bench).count() == 0
    assert decontaminate.scan(odd, nothing).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.clean(odd, nothing).count() == odd.count()


def test_index_is_small():
    items = [(str(i), prose(500 + i, 400).encode()) for i in range(200)]
    size = sum(len(t) for _, t in items)
    assert decontaminate.index_of(items).nbytes <= 4 * size


def test_repeated_windows_of_an_item_are_one():
    index = decontaminate.index_of([("1", b"a " * 500), ("2", b"a " * 20), ("3", b"a " * 3)])
    assert [len(w.hashes) for w in index.windows.values()] == [2, 1]
    n, spans, items = decontaminate._lookup(index, decontaminate.WordHasher(decontaminate.NON_WORD_BYTES), b"x A-a" + b" a" * 18)
    assert (n, decontaminate._merged(spans), items) == (21, [(1, 21)], {"1", "2", "3"})


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "windows", lambda hashes, n: windows(hashes, n) * 0 + 7)
    index = decontaminate.index_of([("1", b"one two"), ("2", b"two one"), ("3", b"one two")])
    hasher = decontaminate.WordHasher(decontaminate.NON_WORD_BYTES)
    assert decontaminate._lookup(index, hasher, b"x two one") == (3, [(1, 3)], {"2"})
    assert decontaminate._lookup(index, hasher, b"one two x") == (3, [(0, 2)], {"1", "3"})


def test_slices_follow_each_other(spark, texts, benchmark_rows):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    plan = lambda n: decontaminate.scan(docs, bench, slice_bytes=n)._jdf.queryExecution().executedPlan().toString()
    assert plan(1 << 20).count("MapInArrow") == 1 and "Exchange" not in plan(1 << 20)
    assert plan(60).count("MapInArrow") == 0
