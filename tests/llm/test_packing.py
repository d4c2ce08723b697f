from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintel.llm import packing, tokenizer

from .conftest import odd_rows, prose


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_pack_is_best_fit_decreasing(case):
    capacity, lengths = case
    rows = packing.pack(lengths, capacity)
    assert sorted(i for row in rows for i in row) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in row) <= capacity for row in rows)
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [x for x in room if x >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else capacity) - n)
    assert len(room) == len(rows)


def encode(text):
    with open(tokenizer.VOCABULARY, "rb") as f:
        return tokenizer.encoder(f.read()).encode_ordinary(text)


def unpacked(rows, capacity):
    """Documents' tokens, from the segments of packed rows."""
    matrix, parts = packing.matrix(rows, capacity), {}
    for r, ids in zip(rows, matrix, strict=True):
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] <= capacity and list(r["position_resets"]) == cu[:-1]
        assert (ids[cu[-1] :] == packing.FILL).all()
        for doc, at, a, b in zip(r["doc_ids"], r["doc_offsets"], cu[:-1], cu[1:], strict=True):
            parts.setdefault(doc, []).append((at, ids[a:b].tolist()))
    return {doc: [x for _, ids in sorted(held) for x in ids] for doc, held in parts.items()}


@pytest.mark.parametrize("capacity,group", [(64, 500), (2048, 1 << 20)])
def test_round_trip(spark, capacity, group):
    r = random.Random(1)
    docs = [(i, prose(i, r.randint(1, 120)) + r.choice(["", "é ü\n", "  x"])) for i in range(120)] + [(500, prose(5, 3000)), (501, None), (502, "")]
    rows = packing.pack_tokens(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), capacity=capacity, group_tokens=group).collect()
    assert len({x["pack_id"] for x in rows}) == len(rows)
    assert unpacked(rows, capacity) == {i: [*encode(t), packing.END] for i, t in docs if t}
    if capacity == 64:
        assert sum(x["n_tokens"] for x in rows) / (len(rows) * capacity) > 0.9


def test_odd_and_empty(odd, empty):
    rows = packing.pack_tokens(odd).collect()
    assert sum(x["n_tokens"] for x in rows) == sum(len(encode(r[1])) + 1 for r in odd_rows() if r[1])
    assert packing.pack_tokens(empty).count() == 0


def test_positions():
    assert packing.positions([0, 3, 5], 7).tolist() == [0, 1, 2, 0, 1, 0, 1]
    assert np.array_equal(packing.matrix([], 4), np.empty((0, 4), np.uint16))
