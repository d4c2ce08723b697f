from __future__ import annotations

import random

import duckdb

from lintel.plans import catalogue


def inside(ring, x, y):
    n = 0
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        n += (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay + 1e-9) + ax
    return n % 2 == 1


def test_every_ring_is_tested(spark, tmp_path):
    """Against brute force over all pairs; the SQL tells the fifth of the rings that it keeps."""
    r = random.Random(7)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)], i % 2) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    rings = {i: list(zip(e[::2], e[1::2], strict=True)) for i, e, _ in rows}
    told = {(a, b) for a, _, la in rows for b, _, lb in rows if a != b and la == lb and inside(rings[a], *rings[b][0])}
    got = [tuple(x) for x in catalogue.point_in_polygon(spark, str(tmp_path)).select("vec_a", "vec_b").collect()]
    assert len(got) == len(set(got)) and set(got) == told
    assert any(a % 5 for a, _ in told)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    sql = con.sql(catalogue.oracle_sql()["point_in_polygon"])
    assert set(sql.project("vec_a, vec_b").fetchall()) == {(a, b) for a, b in told if a % 5 == 0}
