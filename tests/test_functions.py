from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lintel.functions import geometry as g
from lintel.functions import text as tx

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]


def one(spark, *columns, **values):
    kinds = {"p": g.POINTS, "q": g.POINTS, "x": "double", "y": "double", "t": "string", "u": "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[k[0]]}" for k in values))
    return tuple(df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_areas_and_lengths(spark):
    p = F.col("p")
    assert one(spark, g.area(p), g.area(p, 0.5), g.length(p), g.length(p, 2.0), g.mean_point(p)["x"], p=SQUARE) == (100, 25, 30, 60, 5)
    assert one(spark, g.area(p), g.length(p), g.area(p, F.lit(None).cast("double")), p=[(0.0, 0.0), (3.0, 4.0)]) == (None, 5, None)
    assert one(spark, g.area(p), g.length(p), g.mean_point(p), p=[]) == (None, 0, None)


def test_points_of_text(spark):
    got = one(spark, g.parse_points(F.col("t")), g.parse_points(F.col("u")), t="1.5,2;3,4", u=None)
    assert [tuple(x) for x in got[0]] == [(1.5, 2.0), (3.0, 4.0)] and got[1] == []


@pytest.mark.parametrize("x,y,inside,edge,far", [(5.0, 5.0, True, 5, 0), (12.0, 5.0, False, 2, 2), (13.0, 14.0, False, 5, 5), (0.0, 5.0, True, 0, 0), (10.0, 5.0, False, 0, 0)])
def test_point_and_polygon(spark, x, y, inside, edge, far):
    p, at = F.col("p"), (F.col("x"), F.col("y"))
    got = one(spark, g.contains(p, *at), g.boundary_distance(p, *at), g.polygon_distance(p, *at), p=SQUARE, x=x, y=y)
    assert got == (inside, pytest.approx(edge), pytest.approx(far))


def test_polygons_distance(spark):
    shifted = lambda d: [(x + d, y) for x, y in SQUARE]
    distance = g.polygons_distance(F.col("p"), F.col("q"))
    assert [one(spark, distance, p=SQUARE, q=q)[0] for q in (shifted(15.0), shifted(5.0), [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0)])] == [5, 0, 0]


def test_boxes(spark):
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)))
    lit = lambda *v: [F.lit(float(x)) for x in v]
    got = one(spark, g.iou(box(0, 0, 10, 10), box(5, 0, 15, 10)), g.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), g.rect_distance(*lit(13, 14, 0, 0, 10, 10)), g.rect_distance(*lit(3, 4, 0, 0, 10, 10)), t="")
    assert got == (pytest.approx(1 / 3), 0, 5, 0)


@pytest.mark.parametrize("x,y", [(1.0, 1.0), (-300.0, -500.0), (-5.0, 0.5), (0.3, -0.4), (7.0, -2.0)])
def test_direction(spark, x, y):
    want = "center" if abs(x) < 1 and abs(y) < 1 else str(int(math.degrees(math.atan2(y, x)) // 15))
    assert one(spark, g.direction_group(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0)), x=x, y=y)[0] == want


def test_random_polygons_against_plain_python(spark):
    r = random.Random(1)
    rows = []
    for i in range(60):
        ring = [(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(r.randint(3, 9))]
        rows.append((i, ring, r.uniform(-2, 12), r.uniform(-2, 12)))
    got = {k: (inside, d) for k, inside, d in spark.createDataFrame(rows, f"i int, p {g.POINTS}, x double, y double").select("i", g.contains(F.col("p"), F.col("x"), F.col("y")), g.boundary_distance(F.col("p"), F.col("x"), F.col("y"))).collect()}
    for i, ring, x, y in rows:
        inside, least = False, math.inf
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay + 1e-9) + ax:
                inside = not inside
            t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            least = min(least, math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        assert got[i] == (inside, pytest.approx(least))


@pytest.mark.parametrize(
    "path,stem",
    [
        ("/a/明海站站厅层平面示意图 (1).jpg", "明海站-站厅层"), ("珠光站总平面图.png", "珠光站-总平面图"), ("x/深圳湾口岸站建筑平剖面图.pdf", "深圳湾口岸站-平剖面图"), ("石龙.jpg", "石龙站"),
        ("y/全局平面图.jpg", "全局平面图"), ("a b:c*d.jpg", "a-b-c-d"), ("***.jpg", "unnamed"), ("1号车站.jpg", "号车站"),
    ],
)
def test_product_stem(spark, path, stem):
    assert one(spark, tx.product_stem(F.col("t")), t=path)[0] == stem


@pytest.mark.parametrize("text,number,metres", [("15,000mm", 15000, 15), ("15.02m", 15.02, 15.02), ("面积 4967.59 ㎡", 4967.59, None), ("250", 250, 0.25), ("12", 12, 12), ("900m", 900, None), ("", None, None), (None, None, None)])
def test_numbers_and_units(spark, text, number, metres):
    assert one(spark, tx.first_number(F.col("t")), tx.length_metres(F.col("t")), t=text) == (number, metres)


@pytest.mark.parametrize(
    "text,want",
    [
        ("防火分区一（公共区）：面积3861.71m", [("一", 3861.71, "公共区", "public")]),
        ("防火分区一：4443㎡(公共区,...)", [("一", 4443.0, "公共区", "public")]),
        ("说明 防火分区三:1135.59m2有人值守区", [("三", 1135.59, "有人值守区", "equipment")]),
        ("防火分区（一：面积 40", []),
        ("防火分区二 900", [("二", 900.0, "", "unknown")]),
        ("防火分区四" + "x" * 41 + "800", []),
        ("防火分区一 500 公共区" + "y" * 60 + "防火分区二 600 设备区", [("一", 500.0, "公共区", "public"), ("二", 600.0, "设备区", "equipment")]),
        ("", []),
    ],
)
def test_sections(spark, text, want):
    assert [tuple(s) for s in one(spark, tx.sections(F.col("t")), t=text)[0]] == want


def test_small_text_functions(spark):
    t = F.col("t")
    assert one(spark, tx.split_ids(t), t=" 01，02;03； 04 ,")[0] == ["01", "02", "03", "04"]
    assert [one(spark, tx.sanitized_number(t), t=v)[0] for v in ("48.6m", "x", "1.2.3")] == [48.6, 0.0, None]
    assert one(spark, tx.ratios(t), t="1:100 1 ： 500 1:5 1:3000")[0] == [100, 500]
    assert one(spark, tx.normal_stem(t), t="/x/a  b╱c000000000.jpeg-12.jpg")[0] == "a b/c"
    assert one(spark, tx.match_score(t, F.col("u")), t="abc", u="xxabcx")[0] == 1003
    assert one(spark, tx.match_score(t, F.col("u")), t="aab", u="ca")[0] == 2
    assert one(spark, tx.shortened(t), t="x" * 61)[0] == "x" * 58 + "…"
    assert [one(spark, tx.building_category(*(F.lit(v) for v in case)), t="")[0] for case in (("厂房", "", "", ""), ("", "9", "", ""), ("", "9", "20", ""), ("", "", "", "加油站"), ("", "", "", ""))] == ["厂房", "高层民用", "多层民用", "加油加气加氢站", "多层民用"]
