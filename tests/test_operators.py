from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.functions import geometry as g
from lintel.operators import detect, evac, matching, scale
from lintel.operators.spatial import blocked_overlap_join, first_match_join, like_boxes_join, near_join, nearest_join, nearest_number_join, none_near
from lintel.plans import dataset, report
from lintel.sources import sinks
from lintel.sources.annotations import SHAPES


def test_nearest_ties_and_absence(spark):
    left = spark.createDataFrame([("d", 1, 0.0), ("d", 2, 9.0), ("e", 3, 0.0)], "doc string, l int, x double")
    right = spark.createDataFrame([("d", 7, 1.0), ("d", 5, -1.0), ("d", 9, 30.0)], "doc string, r int, z double")
    near = nearest_join(left, right, ["doc"], ["l"], F.abs(F.col("x") - F.col("z")), ["r"], how="left", within=5)
    assert {(r["l"], r["nearest"] and r["nearest"]["r"]) for r in near.collect()} == {(1, 5), (2, None), (3, None)}


def test_nearest_number_sorts_and_matches_all_pairs(spark):
    """With equal distances, rounding, and numbers that are null, infinite or undefined; pairs of a group are not made."""
    r = random.Random(8)
    odd = [None, math.nan, math.inf, -math.inf, 1e17, 1e-17, 2e-17, -0.0, 0.0]
    some = lambda: r.choice(odd) if r.random() < 0.3 else float(r.randint(-6, 6))
    left = [(g_, i, some()) for g_ in "abcd" for i in range(30)] + [("none", 1, 1.0), ("nulls", 2, 1.0), ("nulls", 3, None), ("far", 4, 1e17)]
    right = [(g_, i, some()) for g_ in "abcd" for i in r.sample(range(90), 9)] + [("nulls", 8, None), ("nulls", 7, None), ("far", 9, 3.0), ("far", 5, 2.0), ("far", 2, 1.0)]
    unknown = lambda d: (d is None, d is not None and math.isnan(d), d if d is not None and not math.isnan(d) else 0)
    want = {}
    for key, i, x in left:
        pairs = [(unknown(None if None in (x, z) else abs(x - z)), j) for k, j, z in right if k == key]
        if pairs:
            want[key, i] = min(pairs)
    near = nearest_number_join(spark.createDataFrame(left, "doc string, l int, x double"), spark.createDataFrame(right, "doc string, r int, z double"), ["doc"], "x", "z", ["r"])
    got = [((n["doc"], n["l"]), (unknown(n["distance"]), n["nearest"]["r"])) for n in near.collect()]
    assert len(got) == len(want) and dict(got) == want


def test_first_match(spark):
    left = spark.createDataFrame([("d", 1, 5.0), ("d", 2, 50.0)], "doc string, l int, x double")
    right = spark.createDataFrame([("d", 2, 9.0), ("d", 1, 6.0)], "doc string, r int, top double")
    assert {(r["l"], r["found"] and r["found"]["r"]) for r in first_match_join(left, right, ["doc"], ["l"], F.col("x") < F.col("top"), ["r"]).collect()} == {(1, 1), (2, None)}


def test_none_near(spark):
    left = spark.createDataFrame([("d", 1, 5.0), ("d", 2, 50.0), ("e", 3, 1.0)], "doc string, l int, x double")
    right = spark.createDataFrame([("d", 6.0)], "doc string, z double")
    assert [r["l"] for r in none_near(left, right, ["doc"], ["l"], F.array(g.point(F.col("x"), F.lit(0.0))), g.point(F.col("z"), F.lit(0.0)), 2).collect()] == [2]


def test_near_join_matches_all_pairs(spark):
    r = random.Random(6)
    left = [("d", i, [(r.uniform(-90, 90), r.uniform(-90, 90)) for _ in range(r.randint(1, 3))]) for i in range(80)]
    right = [("d", i, r.uniform(-90, 90), r.uniform(-90, 90)) for i in range(60)] + [("d", 99, *left[0][2][0]), ("d", 98, *left[0][2][0])]
    found = near_join(spark.createDataFrame(left, f"doc string, l int, spots {g.POINTS}"), spark.createDataFrame(right, "doc string, r int, x double, y double"), ["doc"], ["l"], F.col("spots"), g.point(F.col("x"), F.col("y")), ["r"], 12.5)
    got = {x["l"]: x["nearest"]["r"] for x in found.collect()}
    want = {}
    for _, i, spots in left:
        least = min((min(math.hypot(a - x, b - y) for a, b in spots), k) for _, k, x, y in right)
        if least[0] <= 12.5:
            want[i] = least[1]
    assert got == want and got[0] == 98


def test_like_boxes_match_all_pairs(spark):
    r = random.Random(7)
    boxes = []
    for i in range(60):
        x, y, w, h = r.uniform(-500, 500), r.uniform(-500, 500), 2 ** r.uniform(-3, 9), 2 ** r.uniform(-3, 9)
        boxes += [(x, y, x + w, y + h)] + [(x + w * r.uniform(-0.1, 0.1), y + h * r.uniform(-0.1, 0.1), x + w * r.uniform(0.9, 1.1), y + h * r.uniform(0.9, 1.1)) for _ in range(3)]
    boxes += [boxes[0], (1.0, 1.0, 1.0, 5.0), (1.0, 1.0, 1.0, 5.0)]
    rows = [("d", i, *b) for i, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "doc string, k int, x0 double, y0 double, x1 double, y1 double").select("doc", "k", F.struct("x0", "y0", "x1", "y1").alias("box"))

    def share(a, b):
        i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
        return i / u if u else 0

    for least in (0.55, 0.85):
        want = {(i, j) for i, a in enumerate(boxes) for j, b in enumerate(boxes) if i < j and share(a, b) > least}
        got = [(x["a"], x["b"]) for x in like_boxes_join(df, ["doc"], "k", least).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_names_match_all_pairs(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(0, 4)))
    left, right = sorted({f"/l/{word()} {word()}" for _ in range(30)}), sorted({f"/r/{word()}" for _ in range(20)})
    stem = lambda p: " ".join(p.rsplit("/", 1)[1].split())
    want = {}
    for a in left:
        scored = [(-(1000 + len(stem(b))) if stem(b) in stem(a) or stem(a) in stem(b) else -sum(c in stem(a) for c in stem(b)), b) for b in right]
        if min(scored)[0] <= -1:
            want[a] = (min(scored)[1], -min(scored)[0])
    found = matching.best_by_name(spark.createDataFrame([(x,) for x in left], "path string"), spark.createDataFrame([(x,) for x in right], "path string"))
    assert {x["path"]: (x["match"], x["score"]) for x in found.collect()} == want


@pytest.fixture(scope="module")
def boxes():
    r = random.Random(4)
    return [(f"d{i % 3}", i, x := r.uniform(-200, 200), y := r.uniform(-200, 200), x + r.uniform(1, 90), y + r.uniform(1, 30)) for i in range(150)]


def near(a, b, gap):
    return a[2] - gap < b[4] and b[2] - gap < a[4] and a[3] - gap < b[5] and b[3] - gap < a[5]


def test_blocked_overlap_and_clusters(spark, boxes):
    df = spark.createDataFrame(boxes, "doc string, k int, x0 double, y0 double, x1 double, y1 double").repartition(4)
    want = {(a[0], a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and near(a, b, 12)}
    found = [tuple(r) for r in blocked_overlap_join(df, ["doc"], "k", 12).collect()]
    assert len(found) == len(want) and set(found) == want
    label = {b[1]: b[1] for b in boxes}
    for _ in boxes:
        for _, a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    sizes = {}
    for v in label.values():
        sizes[v] = sizes.get(v, 0) + 1
    got = {r["cluster"]: r["n"] for r in detect.clusters(df, ["doc"], "k", 12, members=2, width=(0, 1e9), height=(0, 1e9)).collect()}
    assert got == {k: n for k, n in sizes.items() if n > 1}


def test_suppression(boxes):
    b = np.array([x[2:] for x in boxes])
    scores = np.arange(len(b)) % 7
    kept = detect.suppressed(b, scores, 0.3)
    assert list(kept) == sorted(kept)

    def iou(p, q):
        i = max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1]))
        return i / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - i)

    assert all(iou(b[i], b[j]) <= 0.3 for i in kept for j in kept if i != j)
    assert all(any(iou(b[i], b[j]) > 0.3 and scores[j] >= scores[i] for j in kept) for i in range(len(b)) if i not in kept)


@pytest.mark.parametrize("w,h", [(100, 100), (1024, 1024), (1025, 500), (4000, 2100)])
def test_tiles_cover(spark, w, h):
    tiles = detect.tile_grid(spark.createDataFrame([("d", w, h)], "doc_id string, width int, height int"), 1024, 200).collect()
    assert len({(t["tx"], t["ty"]) for t in tiles}) == len(tiles)
    assert all(t["tx"] + t["tw"] <= w and t["ty"] + t["th"] <= h for t in tiles)
    covered = np.zeros((h, w), bool)
    for t in tiles:
        covered[t["ty"] : t["ty"] + t["th"], t["tx"] : t["tx"] + t["tw"]] = True
    assert covered.all()


def plain_shortest(mask, sources):
    dist = {s: 0.0 for s in sources}
    for _ in range(mask.size):
        changed = False
        for (x, y), d in list(dist.items()):
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    u, v = x + dx, y + dy
                    if (dx or dy) and 0 <= u < mask.shape[1] and 0 <= v < mask.shape[0] and mask[v, u] and d + math.hypot(dx, dy) < dist.get((u, v), math.inf) - 1e-12:
                        dist[u, v], changed = d + math.hypot(dx, dy), True
        if not changed:
            return dist


@pytest.mark.parametrize("seed", range(3))
def test_shortest(seed):
    r = np.random.default_rng(seed)
    mask = r.random((7, 9)) < 0.7
    sources = [(0, 0), (8, 6)]
    dist, _ = evac.shortest(mask, sources)
    want = plain_shortest(mask, sources)
    for y in range(7):
        for x in range(9):
            assert dist[y, x] == pytest.approx(want.get((x, y), math.inf))


def test_evacuation_of_mazes(spark):
    from lintel.plans import catalogue

    rows = {r["doc_id"]: r for r in catalogue.queries()["evac_distance"](spark, "/root/testdata/sf0.001").collect()}
    for region, row in rows.items():
        mask = np.array([[not (x == 5 and y < 7) and not (x == 8 and y > int(region)) for x in range(12)] for y in range(8)])
        far = max(plain_shortest(mask, [(0, 0)]).values())
        assert row["max_distance_m"] == pytest.approx(round(far * 20 * 0.05, 2)) and row["unreachable_cells"] == 0


def test_unreachable_is_null(spark):
    cells = spark.createDataFrame([("d", 0, 0), ("d", 5, 5)], "doc_id string, x int, y int")
    exits = spark.createDataFrame([("d", 0, "E", 1.0, 1.0)], "doc_id string, ord int, id string, x double, y double")
    (row,) = evac.evacuation(cells, exits, spark.createDataFrame([("d", 0.1)], "doc_id string, scale double")).collect()
    assert row["max_distance_m"] is None and (row["mask_cells"], row["unreachable_cells"]) == (2, 1)


def test_matching(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    left, right = paths("/i/明海站站厅000000000.jpeg.jpg", "/i/zz.jpg"), paths("/p/明海站站厅.pdf", "/p/明海站.pdf", "/p/z.pdf", "/q/z.pdf")
    got = {r["path"]: (r["match"], r["score"]) for r in matching.best_by_name(left, right).collect()}
    assert got == {"/i/明海站站厅000000000.jpeg.jpg": ("/p/明海站站厅.pdf", 1005), "/i/zz.jpg": ("/p/z.pdf", 1001)}
    files = spark.createDataFrame([("/a/x.png", "x.png", "x"), ("/a/images/x.jpg", "x.jpg", "x"), ("/b/x.txt", "x.txt", "x")], "path string, name string, stem string")
    assert matching.locate_images(spark.createDataFrame([("x.jpg",)], "name string"), files).first()["path"] == "/a/images/x.jpg"
    bodies = spark.createDataFrame([("/2.xml", "has x.jpg"), ("/1.xml", "x only")], "path string, body string")
    assert matching.first_containing(spark.createDataFrame([("x.jpg",)], "name string"), bodies).first()["path"] == "/1.xml"
    drawn = matching.drawing_to_annotation(paths("/d/石龙站厅层.jpg"), paths("/x/石龙总平面.xml", "/x/石龙站厅层.xml", "/x/明海.xml"))
    assert drawn.first()["match"] == "/x/石龙站厅层.xml"


def test_dataset(spark, tmp_path):
    shape = lambda k, geom, label, pts: ("d", "f", "/in/a.jpg", 3000.0, 500.0, geom, k, label, pts, [])
    rows = [shape(0, "box", "fire_door", [(10.0, 10.0), (110.0, 60.0)]), shape(0, "polygon", "commercial_shop", [(900.0, 0.0), (1200.0, 0.0), (1200.0, 100.0)]), shape(1, "polygon", "public_area", [(0.0, 0.0), (1.0, 0.0), (1.0, 9.0)]), shape(0, "polyline", "evac_distance_line", [(0.0, 0.0), (5.0, 5.0)])]
    shapes = spark.createDataFrame(rows, SHAPES)
    whole = dataset.samples(shapes).collect()
    assert len(whole) == 1 and whole[0]["name"] == "a" and whole[0]["lines"][0] == "5 0.003333 0.020000 0.036667 0.020000 0.036667 0.120000 0.003333 0.120000"
    tiled = dataset.samples(shapes, tile=1000, overlap=200)
    assert {r["name"]: len(r["lines"]) for r in tiled.collect()} == {"a_t0": 2, "a_t1": 1}
    counts = {r["class"]: (r["n"], r["note"]) for r in dataset.class_counts(tiled).collect()}
    assert counts["commercial_shop"] == (2, "few") and counts["gate"] == (0, "none")
    sinks.write_training_labels(dataset.split(tiled), str(tmp_path / "labels"))
    assert spark.read.text(str(tmp_path / "labels")).count() == 3
    names = spark.createDataFrame([(f"n{i}",) for i in range(50)], "name string")
    parts = [r["split"] for r in dataset.split(names).collect()]
    assert (parts.count("test"), parts.count("val")) == (5, 5)
    assert dataset.split(names.repartition(7)).where("split = 'test'").select("name").collect() and "nc: 16" in sinks.training_config("/x")


def test_candidates_and_words(spark):
    ops = spark.createDataFrame([("d", 0, i, "l", 0.0, 0.0, 50.0 + i, 0.0 if i != 3 else 40.0, [0.0]) for i in range(5)] + [("d", 0, 9, "re", 0.0, 0.0, 9.0, 9.0, [0.0])], "doc_id string, page_no int, op_ord int, kind string, x0 double, y0 double, x1 double, y1 double, color array<double>")
    assert [r["op_ord"] for r in detect.line_candidates(ops, 3.0, top=2).orderBy("op_ord").collect()] == [2, 4]
    regions = spark.createDataFrame([("d", i, [(0.0, 0.0), (s, 0.0), (s, s), (0.0, s)], 100.0, 100.0) for i, s in enumerate((2.0, 10.0, 20.0, 90.0))], f"doc_id string, ord int, points {g.POINTS}, width double, height double")
    assert [r["ord"] for r in detect.region_candidates(regions).orderBy("ord").collect()] == [1, 2]
    box = spark.createDataFrame([("d", 0, 0.0, 0.0, 10.0, 10.0), ("d", 1, 50.0, 50.0, 60.0, 60.0)], "doc_id string, ord int, x0 double, y0 double, x1 double, y1 double")
    words = spark.createDataFrame([("d", 2, 5.0, 5.0, "室"), ("d", 1, 1.0, 1.0, "泵"), ("d", 3, 99.0, 1.0, "x")], "doc_id string, word_ord int, cx double, cy double, text string")
    assert [r["content"] for r in detect.words_in_boxes(box, words).orderBy("ord").collect()] == ["泵室", ""]
    told = detect.with_default_attrs(spark.createDataFrame([("fire_door",), ("gate",)], "cls_name string")).collect()
    assert [len(r["attrs"]) for r in told] == [2, 0]
    local = spark.createDataFrame([(100, 50, [1.0, 2.0, 3.0, 4.0], [(1.0, 2.0)])], f"tx int, ty int, box array<double>, polygon {g.POINTS}")
    moved = detect.to_global(local).first()
    assert moved["box"] == [101.0, 52.0, 103.0, 54.0] and tuple(moved["polygon"][0]) == (101.0, 52.0)


def test_scales(spark):
    pages = spark.createDataFrame([("a", 0, 842.0, 3508.0, "1:100 1:200 1:100"), ("b", 0, 842.0, 3508.0, "1:200 1:100"), ("c", 0, 842.0, 3508.0, "none")], "doc_id string, page_no int, width_pt double, width_px double, text string")
    assert {r["doc_id"]: r["ratio"] for r in scale.from_pages(pages).collect()} == {"a": 100, "b": 100}
    cases = spark.createDataFrame([(0.05, 1.0), (0.0, 0.02), (None, None)], "m double, w double")
    assert [(r["s"]["scale"], r["s"]["source"]) for r in cases.select(scale.resolve(F.col("m"), F.col("w")).alias("s")).collect()] == [(0.05, "manual"), (0.02, "pdf_vector_text"), (None, "missing")]


def test_rule_views(spark):
    rules = spark.createDataFrame([("A-1", "门", "x", "GB 1", True), ("B-2", "窗", "y", "gb 2", False)], "rule_id string, name string, category string, source string, mandatory boolean")
    assert report.browse(rules, words="GB").count() == 2 and report.browse(rules, "y", "b-2").count() == 1
    assert tuple(report.catalogue(rules).first()) == (2, 2, 1)
    listed = report.checklist(spark.createDataFrame([("d", "fire_compartment", 0.5, None), ("d", "gate", 0.9, None)], "doc_id string, label string, conf double, zone_type string").withColumn("content", F.lit(""))).first()
    assert (listed["total"], listed["to_review"], listed["zones"], listed["by_label"]) == (2, 1, 1, "fire_compartment=1, gate=1")
