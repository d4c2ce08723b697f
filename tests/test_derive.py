from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lintel.operators import evac, scale
from lintel.plans import derive, report
from lintel.plans.rules import default_rules, evaluate_tables
from lintel.sources import annotations, sinks

HALL = """<annotations><version>1.1</version>
<image id="0" name="hall1.jpg" width="2000" height="1000">
 <polygon label="fire_compartment" points="100,100;1100,100;1100,900;100,900"><attribute name="zone_type">公共区</attribute></polygon>
 <polygon label="fire_compartment" points="1100,100;1900,100;1900,900;1100,900"><attribute name="zone_type">无人区</attribute><attribute name="area_m2_design">1620.5</attribute></polygon>
 <box label="safety_exit" xtl="190" ytl="190" xbr="210" ybr="210"/>
 <box label="safety_exit" xtl="590" ytl="870" xbr="610" ybr="890"/>
 <box label="safety_exit" xtl="1885" ytl="490" xbr="1905" ybr="510"/>
 <box label="fire_door" xtl="1090" ytl="480" xbr="1110" ybr="520"><attribute name="class">乙级</attribute><attribute name="swing_dir">逆着疏散方向</attribute></box>
 <polyline label="width_dimension_line" points="1090,500;1112,500"/>
 <box label="gate" xtl="300" ytl="480" xbr="320" ybr="520"/>
 <polyline label="width_dimension_line" points="300,500;330,500"/>
 <polygon label="commercial_shop" points="300,600;420,600;420,720;300,720"/>
 <polyline label="evac_distance_line" points="200,200;200,500;500,500"/>
</image></annotations>"""

SITE = """<annotations>
<image id="0" name="总平面图.jpg" width="1000" height="1000">
 <polygon label="surrounding_building" points="0,0;100,0;100,100;0,100"><attribute name="name">甲</attribute><attribute name="building_type">超高层民用</attribute></polygon>
 <polygon label="surrounding_building" points="800,800;900,800;900,900;800,900"><attribute name="floors">9</attribute></polygon>
 <polygon label="station_exit_ground" points="150,0;200,0;200,50;150,50"/>
 <polygon label="vent_group_ground" points="850,700;900,700;900,750;850,750"/>
 <polyline label="fire_clearance_line" points="100,25;150,25"/>
 <box label="dimension_val" xtl="120" ytl="10" xbr="130" ybr="20"><attribute name="text_content">10.0m</attribute></box>
 <box label="building_meta" xtl="840" ytl="840" xbr="860" ybr="860"><attribute name="text_content">办公楼
二级</attribute></box>
</image></annotations>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("xml")
    for name, text in (("hall.xml", HALL), ("site.xml", SITE), ("bad.xml", "<annotations><image id='0' name=></annotations>")):
        (at / name).write_text(text, encoding="utf-8")
    return str(at)


@pytest.fixture(scope="module")
def shapes(spark, folder):
    return annotations.read_shapes(spark, folder).cache()


@pytest.fixture(scope="module")
def tables(shapes):
    hall = shapes.where("file like '%hall.xml'")
    return derive.structure(hall, hall.select("doc_id").distinct().withColumn("scale", F.lit(0.05)))


def test_objects(tables):
    row = lambda name: [r.asDict(recursive=True) for r in tables[name].orderBy("ord").collect()]
    fc = row("fire_compartment")
    assert [(r["id"], r["zone_type"], r["area_m2"], r["area_m2_geom"], r["area_m2_design"], [e["id"] for e in r["exits"]]) for r in fc] == [("FC-01", "public", 2000.0, 2000.0, None, ["EX-01", "EX-02"]), ("FC-02", "equipment_unmanned", 1620.5, 1600.0, 1620.5, ["EX-03"])]
    assert [(r["direction_group"], r["leads_to"]) for r in row("exit")] == [("-11", "ground"), ("9", "ground"), ("0", "other")]
    (pair,) = row("exit_pair")
    assert (pair["id"], pair["relation"]) == ("EXP-EX-01-EX-02", "adjacent") and pair["distance_m"] == pytest.approx(0.05 * (400**2 + 680**2) ** 0.5)
    (door,) = row("door")
    assert (door["zone"], door["is_on_firewall"], door["clear_width_m"], door["swing_direction"], door["class"]) == ("equipment_unmanned", True, 0.95, "reverse", "乙级")
    assert [(r["kind"], r["clear_width_m"]) for r in row("corridor")] == [("evac_corridor", 1.5)]
    assert row("shop")[0]["area_m2"] == pytest.approx(36) and row("shop_pair") == [] and row("evac_distance_line")[0]["length_m"] == 30
    station = tables["station"].first()
    assert (station["public_zone"]["area_m2"], len(station["public_zone"]["exits"]), len(station["public_zone"]["commercial_shops"])) == (2000, 2, 1)


def test_findings_and_reports(tables):
    found = evaluate_tables(tables, default_rules()).cache()
    assert tuple(report.summary(found).first()) == (14, 8, 5, 1)
    assert [r["total"] for r in report.batch(found).orderBy("is_total").collect()] == [14, 14]
    assert report.outcome(found).first()["verdict"] == "fail"
    fails = report.fails_by_rule(found).orderBy("seq").collect()
    assert [r["seq"] for r in fails] == [1, 2, 3, 4, 5] and "应调整门扇方向" in "".join(r["opinion"] for r in fails)
    assert report.reviews(found).count() == 1
    text = report.markdown(found).first()["text"]
    assert "| 14 | 8 | 5 | 1 |" in text and text.count("\n- ") == 5
    table = {(r["rule_id"], r["target_id"]): (r["requirement"], r["result"]) for r in report.check_table(found, default_rules()).collect()}
    assert table["WIDTH-DOOR-EVAC-001", "DR-001"] == ("≥0.9", "pass") and table["AREA-EQUIP-UG-001", "FC-02"] == ("≤1500", "fail")
    marks = {(r["target_type"], r["target_id"]): r["colour"] for r in report.marks(found).collect()}
    assert marks["door", "DR-001"] == "red" and marks["corridor", "COR-01"] == "green" and marks["station", None] == "green"


def test_clearance(shapes):
    rows = derive.building_clearance(shapes).orderBy("ord").collect()
    assert [(r["id"], r["building_name"], r["building_category"], r["nearest_kind"], r["distance_m"]) for r in rows] == [("BC-01", "甲", "高层民用", "出入口", 10.0), ("BC-02", "办公楼", "高层民用", "风亭", 10.0)]


def test_bad_file_is_a_row(spark, folder):
    images = annotations.read_images(spark, folder)
    assert images.where("corrupt is not null").count() >= 1
    assert images.where("corrupt is null").count() == 2


def test_written_annotations_read_back(spark, shapes, tmp_path):
    sinks.write_annotations(shapes, str(tmp_path / "out"))
    again = annotations.read_shapes(spark, str(tmp_path / "out"))
    columns = ("image", "geom", "ord", "label", "points", "attrs")
    assert {str(tuple(r)) for r in again.select(*columns).collect()} == {str(tuple(r)) for r in shapes.select(*columns).collect()}


def test_evacuation(shapes, tables):
    hall = shapes.where("file like '%hall.xml'")
    (line,) = evac.derived_lines(hall, tables["exit"], hall.select("doc_id").distinct().withColumn("scale", F.lit(0.05))).collect()
    assert line["id"] == "EVAC-DERIVED-01" and 30 < line["length_m"] < 60


def test_scale_from_written_lengths(spark):
    rows = [("d", "f", "i", 100.0, 100.0, "polyline", k, "evac_distance_line", [(0.0, 100.0 * k), (100.0 * (k + 1), 100.0 * k)], []) for k in range(3)]
    rows += [("d", "f", "i", 100.0, 100.0, "box", k, "dimension_val", [(0.0, 100.0 * k), (10.0, 100.0 * k + 5)], [("text_content", t)]) for k, t in enumerate(("5000mm", "10.5 m", "88㎡"))]
    (found,) = scale.from_shapes(spark.createDataFrame(rows, annotations.SHAPES)).collect()
    assert found["pairs"] == 2 and found["scale"] == pytest.approx(10.5 / 200)


def test_fill_designed_area(tables):
    rings = tables["fire_compartment"].select("doc_id", "id").withColumn("points", F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 9D, 'y', 0D), named_struct('x', 9D, 'y', 9D))"))
    numbers = rings.where("id = 'FC-01'").select("doc_id", F.explode(F.array(F.lit(300.5), F.lit(400.0), F.lit(500.5), F.lit(12.5))).alias("value")).withColumn("cx", F.lit(8.0)).withColumn("cy", F.lit(1.0))
    filled = {r["id"]: (r["area_m2"], r["area_m2_design"]) for r in derive.fill_designed_area(tables["fire_compartment"], rings, numbers).collect()}
    assert filled == {"FC-01": (2000.0, 400.5), "FC-02": (1620.5, 1620.5)}
    assert derive.fill_designed_area(tables["fire_compartment"], rings, numbers, prefer_claim=True).where("id = 'FC-01'").first()["area_m2"] == 400.5


def test_rename(spark):
    rows = [("d", "f", "i", 1.0, 1.0, "box", 0, "防火门", [], [("分类", "甲级"), ("未知", "x")])]
    shape = annotations.english(spark.createDataFrame(rows, annotations.SHAPES)).first()
    assert shape["label"] == "fire_door" and [a["name"] for a in shape["attrs"]] == ["class", "未知"]
    counts = annotations.conversion_counts(spark.createDataFrame(rows, annotations.SHAPES)).where("unmapped").collect()
    assert [(r["kind"], r["name"]) for r in counts] == [("attribute", "未知")]
