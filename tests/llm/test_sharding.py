from __future__ import annotations

import random
import zlib

import pytest

from lintel.llm import sharding

from .conftest import odd_rows


def checked(rows, shards=24):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert all(0 <= s < shards for s in by)
    for held in by.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    return {s: sum(r["size"] for r in held) for s, held in by.items()}


def test_sizes_near_equal_with_a_hot_group(spark):
    r = random.Random(3)
    hot = "copy " * 40
    rows = [(i, hot if i % 3 == 0 else "x" * r.randint(0, 400) + str(i)) for i in range(6000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {x["doc_id"] for x in out} == set(range(6000)) and len(out) == 6000
    texts = dict(rows)
    for x in out:
        assert x["text_crc32"] == zlib.crc32(texts[x["doc_id"]].encode()) and x["size"] == len(texts[x["doc_id"]].encode()) + 8
    sizes = checked(out)
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and all(abs(s - mean) < 1000 for s in sizes.values())


def test_small_groups_stay_whole(spark):
    rows = [(i, f"text {i // 3} " + "y" * (i // 3 % 50)) for i in range(6000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    checked(out)
    where = {}
    for x in out:
        where.setdefault(x["text_crc32"], set()).add(x["shard"])
    assert all(len(s) == 1 for s in where.values())


@pytest.mark.parametrize("n", [1, 2, 30])
def test_few_rows(spark, n):
    out = sharding.shard(spark.createDataFrame([(i, "abc") for i in range(n)], "doc_id long, text string")).collect()
    assert len(out) == n
    checked(out)


def test_odd_rows(odd, empty):
    out = sharding.shard(odd).collect()
    assert len(out) == len(odd_rows())
    checked(out)
    assert sum(x["size"] for x in out) == sum(len((r[1] or "").encode()) + 8 for r in odd_rows())
    assert sharding.shard(empty).count() == 0


def brute(rows, shards=24):
    """Shard, slot and whether its group is cut of each row, from its own key k: along k, each row or small group goes where its middle lies."""
    rows = sorted(rows, key=lambda r: (r["k"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]))
    total, at, i, out, used = sum(r["size"] for r in rows), 0, 0, [], {}
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j]["k"] >> sharding.ID_BITS == rows[i]["k"] >> sharding.ID_BITS:
            j += 1
        size = sum(r["size"] for r in rows[i:j])
        large = size > sharding.WHOLE * total / shards
        own = at
        for r in rows[i:j]:
            middle = own + r["size"] / 2 if large else at + size / 2
            shard = min(shards - 1, int(middle * shards // total))
            out.append((r["doc_id"], r["size"], r["text_crc32"], shard, used.get(shard, 0), large))
            used[shard] = used.get(shard, 0) + 1
            own += r["size"]
        at, i = at + size, j
    return out


def test_matches_plain_python(spark, odd):
    r = random.Random(8)
    tables = [spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), odd, spark.createDataFrame([(i, "hot " * 30 if i % 3 else "y" * r.randint(0, 900)) for i in range(900)], "doc_id long, text string").repartition(5)]
    for docs in tables:
        out = sharding.shard(docs).collect()
        for row in out:
            assert row["size"] >= 8 and 0 <= row["text_crc32"] < 1 << 32
        got = sorted(((x["doc_id"], x["size"], x["text_crc32"], x["shard"], x["slot"], x["group_cut"]) for x in out), key=str)
        assert got == sorted(brute(out), key=str)
