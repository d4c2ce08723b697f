from __future__ import annotations

import random

import pytest

from lintel.llm import mixing


def water(sizes, share=1.5):
    """Targets by repeated resharing; sizes by source in order."""
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    total, fixed = share * sum(sizes), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in fixed]
        if not rest:
            return [float(fixed[i]) for i in range(len(sizes))]
        level = (total - sum(fixed.values())) / sum(weights[i] for i in rest)
        over = [i for i in rest if level * weights[i] > 2 * sizes[i]]
        if not over:
            return [float(fixed.get(i, level * weights[i])) for i in range(len(sizes))]
        fixed |= {i: 2 * sizes[i] for i in over}


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 5, 100, 1000, r.randint(1, 5000)]) for _ in range(r.randint(1, 12))]
    rows = [(f"s{i:02d}" if i < len(sizes) - 1 else None, s) for i, s in enumerate(sizes)]
    got = {x["source"]: x["target"] for x in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    for (source, _), want in zip(rows, water(sizes), strict=True):
        assert got[source] == pytest.approx(want)


def test_mix(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix(docs).collect()
    assert len(out) == 3000
    by = {}
    for x in out:
        assert x["copies"] in (0, 1, 2)
        by.setdefault(x["source"], []).append(x)
    for held in by.values():
        taken = sum(x["size"] * x["copies"] for x in held)
        assert held[0]["source_size"] == sum(x["size"] for x in held)
        assert abs(taken - held[0]["target"]) <= 30
    again = {(x["doc_id"], x["copies"]) for x in mixing.mix(docs.repartition(2)).collect()}
    assert again == {(x["doc_id"], x["copies"]) for x in out}
    rows_taken = mixing.take(docs)
    assert rows_taken.columns == docs.columns
    assert rows_taken.count() == sum(x["copies"] for x in out)


def test_odd_rows(odd, empty):
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count()
    assert {x["source"] for x in out} == {"s0", "s1", "s2", None}
    assert mixing.mix(empty).count() == 0
    assert mixing.take(empty).count() == 0
    assert mixing.take(odd).columns == odd.columns


def test_no_python_in_the_plan(odd):
    plan = mixing.mix(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
