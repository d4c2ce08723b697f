"""Queries over drawings: one hall and one site drawing for each nation, written as annotation XML, read and structured.

The drawings are plain data, moved 10 pixels to the right for each key k, and texts hold 10 + k where they say @. What
their objects come to is worked out by hand and stands in the SQL.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import evac, matching, scale
from ..operators.groups import numbered
from ..sources import annotations, sinks
from ..sources.stages import scratch, staged, write_text
from . import dataset, derive, documents, report
from .registry import query, table
from .rules import default_rules, evaluate_documents, evaluate_tables, load_rules
from .rules.standard import STANDARD

Shape = tuple[str, str, str, dict[str, str]]

#: geometry, label, points, attributes
HALL: list[Shape] = [
    ("polygon", "fire_compartment", "100,100;1100,100;1100,900;100,900", {"zone_type": "公共区"}),
    ("polygon", "fire_compartment", "1100,100;1900,100;1900,900;1100,900", {"zone_type": "无人区", "area_m2_design": "1620.5"}),
    ("polygon", "fire_compartment", "1200,910;1400,910;1400,990;1200,990", {"zone_type": "无人区"}),
    ("polygon", "commercial_shop", "300,600;420,600;420,720;300,720", {}),
    ("polygon", "commercial_shop", "500,600;560,600;560,660;500,660", {}),
    ("box", "safety_exit", "190,190;210,210", {}),
    ("box", "safety_exit", "590,870;610,890", {}),
    ("box", "safety_exit", "1885,490;1905,510", {}),
    ("box", "fire_door", "1090,480;1110,520", {"class": "乙级", "swing_dir": "逆着疏散方向"}),
    ("box", "fire_door", "1090,700;1110,740", {"class": "甲级", "swing_dir": "顺着疏散方向"}),
    ("box", "gate", "300,480;320,520", {}),
    ("box", "stair_escalator", "500,300;540,340", {}),
    ("box", "fire_shutter", "700,100;900,110", {}),
    ("polyline", "width_dimension_line", "1090,500;1112,500", {}),
    ("polyline", "width_dimension_line", "300,500;330,500", {}),
    ("polyline", "width_dimension_line", "500,320;560,320", {}),
    ("polyline", "width_dimension_line", "1088,505;1130,505", {}),
    ("polyline", "evac_distance_line", "200,200;200,500;500,500", {}),
    ("polyline", "evac_distance_line", "200,700;400,700", {"text_content": "55.5m", "pair_id": "9"}),
]
SITE: list[Shape] = [
    ("polygon", "surrounding_building", "0,0;100,0;100,100;0,100", {"name": "甲", "building_type": "超高层民用"}),
    ("polygon", "surrounding_building", "800,800;900,800;900,900;800,900", {"floors": "9"}),
    ("polygon", "station_exit_ground", "150,0;200,0;200,50;150,50", {}),
    ("polygon", "vent_group_ground", "850,700;900,700;900,750;850,750", {"vent_function": "新风", "name": "V"}),
    ("polygon", "vent_group_ground", "960,700;1000,700;1000,750;960,750", {"vent_function": "排风"}),
    ("polyline", "fire_clearance_line", "100,25;150,25", {}),
    ("box", "dimension_val", "120,10;130,20", {"text_content": "@m"}),
    ("box", "building_meta", "840,840;860,860", {"text_content": "办公楼\n二级"}),
]
#: Written lengths over lines of 100, 200 and 300 pixels, a written area, and Chinese names.
LENGTHS: list[Shape] = [
    ("polyline", "evac_distance_line", "0,0;100,0", {}), ("polyline", "evac_distance_line", "0,200;200,200", {}), ("polyline", "evac_distance_line", "0,400;300,400", {}),
    ("box", "dimension_val", "40,0;60,5", {"text_content": "5000mm"}), ("box", "val_text", "90,200;110,205", {"text_content": "10.5 m"}), ("box", "dimension_val", "140,400;160,405", {"text_content": "@m"}), ("box", "val_text", "140,410;160,415", {"text_content": "88㎡"}),
    ("box", "防火门", "500,500;510,510", {"分类": "甲级", "未知": "x"}), ("box", "未知牌", "600,500;610,510", {}),
]
DRAWINGS = {"hall": HALL, "site": SITE, "lengths": LENGTHS}
_ITEM = "array<struct<geom:string,ord:int,label:string,points:string,attrs:array<struct<name:string,value:string>>>>"
_K = "nation"


def _listed(drawing: str) -> list[dict]:
    out, counts = [], {}
    for geom, label, points, attrs in DRAWINGS[drawing]:
        out.append({"geom": geom, "ord": counts.get(geom, 0), "label": label, "points": points, "attrs": [{"name": n, "value": v} for n, v in attrs.items()]})
        counts[geom] = counts.get(geom, 0) + 1
    return out


def _drawn(spark: SparkSession, sf_dir: str, drawing: str) -> DataFrame:
    """The shapes of a drawing for each nation."""
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.alias("k"), F.explode(F.from_json(F.lit(json.dumps(_listed(drawing), ensure_ascii=False)), _ITEM)).alias("s"))
    points = F.transform(g.parse_points(F.col("s.points")), lambda p: g.point(p["x"] + 10 * F.col("k"), p["y"]))
    attrs = F.transform("s.attrs", lambda a: F.struct(a["name"].alias("name"), F.replace(a["value"], F.lit("@"), (F.col("k") + 10).cast("string")).alias("value")))
    image = F.format_string(f"{drawing}-%d.jpg", "k")
    return rows.select(image.alias("doc_id"), image.alias("file"), image.alias("image"), F.lit(2000.0).alias("width"), F.lit(1000.0).alias("height"), "s.geom", "s.ord", "s.label", points.alias("points"), attrs.alias("attrs"))


@lru_cache(maxsize=64)
def _folder(spark: SparkSession, sf_dir: str, drawing: str) -> str:
    """The folder of a drawing's annotation files, written once in a session."""
    path = scratch(spark, drawing)
    sinks.write_annotations(_drawn(spark, sf_dir, drawing), path)
    return path


def shapes(spark: SparkSession, sf_dir: str, drawing: str) -> DataFrame:
    """The shapes of a drawing's annotation files, a drawing named by its image."""
    return annotations.read_shapes(spark, _folder(spark, sf_dir, drawing)).withColumn("doc_id", F.col("image"))


def _scales(s: DataFrame) -> DataFrame:
    return s.select("doc_id").distinct().withColumn("scale", F.lit(0.05))


@lru_cache(maxsize=16)
def _stage(spark: SparkSession, sf_dir: str) -> str:
    return scratch(spark, "objects")


def _structured(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The object tables of the hall drawings, made once in a session."""
    hall = shapes(spark, sf_dir, "hall")
    made = derive.structure(hall, _scales(hall))
    return {name: staged(spark, f"{_stage(spark, sf_dir)}/{name}", lambda name=name: made[name]) for name in made}


def _sql(value: object) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


def _values(rows: list[tuple], names: str, drawing: str = "hall", columns: str | None = None) -> str:
    """SQL of some rows for each nation; columns may use k."""
    listed = ", ".join("(" + ", ".join(map(_sql, row)) + ")" for row in rows)
    return f"SELECT concat('{drawing}-', k, '.jpg') AS doc_id, {columns or names} FROM (SELECT n_nationkey AS k FROM nation), (VALUES {listed}) v({names})"


def _attrs_text(attrs: Column) -> Column:
    return F.array_join(F.transform(attrs, lambda a: F.concat_ws("=", a["name"], a["value"])), ";")


def _shape_rows(drawing: str) -> list[tuple]:
    return [(s["geom"], s["ord"], s["label"], len(s["points"].split(";")), float(s["points"].split(",")[0]), ";".join(f"{a['name']}={a['value']}" for a in s["attrs"])) for s in _listed(drawing)]


# sources and sinks


@query(f"{_values(_shape_rows('hall'), 'geom, ord, label, n, x, attrs', 'hall', 'geom, ord, label, n, CAST(x + 10 * k AS DOUBLE) AS x, attrs')} UNION ALL {_values(_shape_rows('site'), 'geom, ord, label, n, x, attrs', 'site', 'geom, ord, label, n, CAST(x + 10 * k AS DOUBLE) AS x, replace(attrs, chr(64), CAST(k + 10 AS VARCHAR)) AS attrs')}")
def annotation_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation XML written and read back."""
    read = shapes(spark, sf_dir, "hall").unionByName(shapes(spark, sf_dir, "site"))
    return read.select("doc_id", "geom", "ord", "label", F.size("points").alias("n"), F.get("points", F.lit(0))["x"].alias("x"), _attrs_text(F.col("attrs")).alias("attrs"))


@query("SELECT * FROM (VALUES ('fire_compartment', 3), ('commercial_shop', 2), ('safety_exit', 3), ('fire_door', 2), ('gate', 1), ('stair_escalator', 1), ('fire_shutter', 1), ('width_dimension_line', 4), ('evac_distance_line', 2)) t(label, n)")
def one_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of one drawing, chosen by its image's name."""
    return report.label_counts(shapes(spark, sf_dir, "hall").where("image = 'hall-3.jpg'")).select("label", "n")


@lru_cache(maxsize=16)
def _archive(spark: SparkSession, sf_dir: str) -> str:
    """An archive: one annotation file with an image for each nation, a broken one, one without images, and pictures of some images."""
    root = scratch(spark, "archive")
    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy(F.col("n_nationkey").desc()).collect()]
    images = "".join(f'<image id="{k}" name="plan-{k}.jpg" width="100" height="100"><box label="gate" xtl="{k}" ytl="1" xbr="{k + 5}" ybr="9" source="auto"/></image>\n' for k in keys)
    write_text(spark, f"{root}/xml/plans.xml", f"<annotations>{images}</annotations>")
    write_text(spark, f"{root}/xml/broken.xml", "<annotations><image id='0' name=></annotations>")
    write_text(spark, f"{root}/xml/empty.xml", "<annotations></annotations>")
    for k in keys:
        if k % 2 == 0:
            write_text(spark, f"{root}/images/plan-{k}.jpg", "x")
        if k % 3 == 0:
            write_text(spark, f"{root}/more/plan-{k}.png", "x")
    write_text(spark, f"{root}/rules.json", json.dumps(STANDARD, ensure_ascii=False))
    for k in keys[:5]:
        write_text(spark, f"{root}/json/drawing-{k}.json", json.dumps({"shop": [{"id": f"S{k}", "area_m2": 20 + k}]}))
    write_text(spark, f"{root}/results.csv", "epoch, loss ,  mAP50\n" + "".join(f"  {k}, {k}.5, 0.25\n" for k in keys))
    write_text(spark, f"{root}/meta.json", "\n".join(json.dumps({"doc_id": f"hall-{k}.jpg", "type": "elevated", "transfer_lines": k}) for k in keys if k % 2))
    return root


@query("SELECT concat('plan-', min(n_nationkey), '.jpg') AS image, CAST(min(n_nationkey) AS DOUBLE) AS x FROM nation")
def first_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site scan: the first image of a file and its shapes."""
    images = annotations.first_images(annotations.read_images(spark, f"{_archive(spark, sf_dir)}/xml"))
    return annotations.shapes_of(images).select("image", F.get("points", F.lit(0))["x"].alias("x"))


@query("SELECT concat('plan-', n_nationkey, '.jpg') AS image, CASE WHEN n_nationkey % 2 = 0 THEN concat('plan-', n_nationkey, '.jpg') ELSE concat('plan-', n_nationkey, '.png') END AS picture FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0")
def usable_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of an archive whose picture is there; a broken file and images without a picture go."""
    root = _archive(spark, sf_dir)
    found = dataset.usable_images(annotations.read_images(spark, f"{root}/xml"), annotations.list_files(spark, root, "*.jpg", "*.png"))
    return found.select("image", F.substring_index("path", "/", -1).alias("picture"))


@query("SELECT concat('plan-', n_nationkey, '.jpg') AS name, concat('plan-', n_nationkey) AS stem FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT concat('plan-', n_nationkey, '.png'), concat('plan-', n_nationkey) FROM nation WHERE n_nationkey % 3 = 0")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.list_files(spark, _archive(spark, sf_dir), "*.jpg", "*.png").select("name", "stem")


_RULE_IDS = ", ".join(f"({i}, '{r['rule_id']}')" for i, r in enumerate(STANDARD["rules"]))


@query(f"SELECT * FROM (VALUES {_RULE_IDS}) t(rule_ord, rule_id)")
def rules_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a rule document in a file."""
    return report.rule_table(spark, load_rules(spark, f"{_archive(spark, sf_dir)}/rules.json")).select("rule_ord", "rule_id")


@query("SELECT concat('S', k) AS target_id, 20 + k <= 30 AS passed FROM (SELECT n_nationkey AS k FROM nation ORDER BY k DESC LIMIT 5)")
def documents_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of structured documents in files."""
    return evaluate_documents(annotations.read_documents(spark, f"{_archive(spark, sf_dir)}/json"), default_rules()).select("target_id", "passed")


@query("SELECT CAST(n_nationkey AS DOUBLE) AS epoch, n_nationkey + 0.5::DOUBLE AS loss, 0.25::DOUBLE AS mAP50 FROM nation")
def training_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.read_training_metrics(spark, f"{_archive(spark, sf_dir)}/results.csv")


@query("SELECT concat('hall-', k, '.jpg') AS doc_id, CASE WHEN k % 2 = 1 THEN 'elevated' ELSE 'underground' END AS type, 0.0::DOUBLE AS height_m, CASE WHEN k % 2 = 1 THEN k ELSE 1 END AS transfer_lines, FALSE AS is_shared_concourse FROM (SELECT n_nationkey AS k FROM nation)")
def station_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station data from a file where there is some, defaults elsewhere."""
    meta = spark.read.schema("doc_id string, type string, transfer_lines int").json(f"{_archive(spark, sf_dir)}/meta.json")
    return derive.station_meta(shapes(spark, sf_dir, "hall"), meta).select("doc_id", "type", "height_m", "transfer_lines", "is_shared_concourse")


@query("SELECT n_nationkey AS k, 2 AS runs FROM nation")
def staged_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage that is made once: the second run reads what the first wrote."""
    path, made = scratch(spark, "stage"), []

    def make() -> DataFrame:
        made.append(1)
        return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lit(len(made) + 1).alias("runs"))

    staged(spark, path, make)
    return staged(spark, path, make)


# objects


@query(_values([("FC-01", 2000.0, None, 2000.0, "public", "EX-01,EX-02"), ("FC-02", 1620.5, 1620.5, 1600.0, "equipment_unmanned", "EX-03"), ("FC-03", 40.0, None, 40.0, "equipment_unmanned", "")], "id, area_m2, area_m2_design, area_m2_geom, zone_type, exits", columns="id, CAST(area_m2 AS DOUBLE) AS area_m2, CAST(area_m2_design AS DOUBLE) AS area_m2_design, CAST(area_m2_geom AS DOUBLE) AS area_m2_geom, zone_type, exits"))
def compartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _structured(spark, sf_dir)["fire_compartment"]
    return found.select("doc_id", "id", F.round("area_m2", 6).alias("area_m2"), "area_m2_design", F.round("area_m2_geom", 6).alias("area_m2_geom"), "zone_type", F.array_join("exits.id", ",").alias("exits"))


_BUCKET = "CAST(CAST(floor(degrees(atan2(y - 500, x + 10 * k - 1000)) / 15) AS BIGINT) AS VARCHAR)"


@query(_values([("EX-01", 200, 200, "ground", "public"), ("EX-02", 600, 880, "ground", "public"), ("EX-03", 1895, 500, "other", "equipment_unmanned")], "id, x, y, leads_to, zone", columns=f"id, CAST(x + 10 * k AS DOUBLE) AS x, leads_to, zone, {_BUCKET} AS direction_group"))
def exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structured(spark, sf_dir)["exit"].select("doc_id", "id", F.col("center_px")[0].alias("x"), "leads_to", "zone", "direction_group")


@query(_values([("EXP-EX-01-EX-02", "EX-01", "EX-02", "adjacent")], "id, exit_a, exit_b, relation", columns="id, exit_a, exit_b, relation, round(0.05 * sqrt(400.0 * 400 + 680.0 * 680), 6) AS distance_m"))
def exit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structured(spark, sf_dir)["exit_pair"].select("doc_id", "id", "exit_a", "exit_b", "relation", F.round("distance_m", 6).alias("distance_m"))


@query(_values([("DR-001", 1.95, "reverse", "乙级"), ("DR-002", None, "evacuation", "甲级")], "id, w, swing_direction, class", columns="id, CAST(w AS DOUBLE) AS clear_width_m, swing_direction, class, 'equipment_unmanned' AS zone, TRUE AS is_on_firewall, TRUE AS is_evacuation, 'between_exits' AS position"))
def doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structured(spark, sf_dir)["door"].select("doc_id", "id", "clear_width_m", "swing_direction", "class", "zone", "is_on_firewall", "is_evacuation", "position")


@query(_values([("COR-01", "evac_corridor", 1.5), ("COR-02", "evac_stair", 3.0)], "id, kind, w", columns="id, kind, CAST(w AS DOUBLE) AS clear_width_m"))
def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structured(spark, sf_dir)["corridor"].select("doc_id", "id", "kind", "clear_width_m")


@query(_values([("EVAC-01", 30.0, ""), ("EVAC-02", 55.5, "9")], "id, m, pair_id", columns="id, CAST(m AS DOUBLE) AS length_m, 'any_to_exit' AS kind, pair_id"))
def evacuation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structured(spark, sf_dir)["evac_distance_line"].select("doc_id", "id", F.round("length_m", 6).alias("length_m"), "kind", "pair_id")


@query(f"{_values([('SHOP-01', 36.0), ('SHOP-02', 9.0)], 'id, m', columns='id, CAST(m AS DOUBLE) AS area_m2')} UNION ALL {_values([('SP-1-2',)], 'id', columns='id, round(0.05 * sqrt(170.0 * 170 + 30.0 * 30), 6) AS area_m2')} UNION ALL {_values([('FS-01',)], 'id', columns='id, 10.0::DOUBLE AS area_m2')}")
def shops_and_shutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of shops, distances of their pairs and widths of shutters, by id."""
    t = _structured(spark, sf_dir)
    of = lambda name, column: t[name].select("doc_id", "id", F.round(column, 6).alias("area_m2"))
    return of("shop", "area_m2").unionByName(of("shop_pair", "opening_distance_m")).unionByName(of("fire_shutter", "shutter_width_m"))


@query(_values([("underground",)], "type", columns="type, 0.0::DOUBLE AS height_m, 1 AS transfer_lines, 2000.0::DOUBLE AS public_m2, 'EX-01,EX-02' AS public_exits, 'EX-03' AS equipment_exits, 'SHOP-01,SHOP-02' AS shops"))
def station(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _structured(spark, sf_dir)["station"]
    return found.select("doc_id", "type", "height_m", "transfer_lines", F.round("public_zone.area_m2", 6).alias("public_m2"), F.array_join("public_zone.exits.id", ",").alias("public_exits"), F.array_join("equipment_zone.exits.id", ",").alias("equipment_exits"), F.array_join("public_zone.commercial_shops.id", ",").alias("shops"))


_FINDINGS = [
    ("AREA-PUB-001", "FC-01", True), ("AREA-EQUIP-UG-001", "FC-02", False), ("AREA-EQUIP-UG-001", "FC-03", True), ("EVAC-DIST-ANY-001", "EVAC-01", True), ("EVAC-DIST-ANY-001", "EVAC-02", False), ("EVAC-DIST-EQUIP-BETWEEN-001", "DR-001", None), ("EVAC-DIST-EQUIP-BETWEEN-001", "DR-002", None),
    ("EXIT-NUM-PUB-001", None, True), ("EXIT-NUM-EQUIP-001", "FC-02", False), ("EXIT-NUM-EQUIP-001", "FC-03", False), ("EXIT-DIST-ADJ-001", "EXP-EX-01-EX-02", True), ("WIDTH-DOOR-EVAC-001", "DR-001", True), ("WIDTH-DOOR-EVAC-001", "DR-002", None), ("WIDTH-CORR-EVAC-001", "COR-01", True),
    ("WIDTH-STAIR-EVAC-001", "COR-02", True), ("DOOR-SWING-EVAC-001", "DR-001", False), ("DOOR-SWING-EVAC-001", "DR-002", True), ("SHOP-COUNT-PUB-001", None, True), ("SHOP-AREA-EACH-001", "SHOP-01", False), ("SHOP-AREA-EACH-001", "SHOP-02", True), ("SHOP-OPENING-DIST-001", "SP-1-2", True),
    ("SHOP-AREA-TOTAL-PUB-001", None, True), ("SHUTTER-WIDTH-LE30-001", "FS-01", True), ("DOOR-CLASS-FIREWALL-001", "DR-001", False), ("DOOR-CLASS-FIREWALL-001", "DR-002", True),
]


@query(_values(_FINDINGS, "rule_id, target_id, passed"))
def drawing_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From annotation files to findings of the standard rules."""
    return evaluate_tables(_structured(spark, sf_dir), default_rules(), ("doc_id", "rule_id", "target_id", "passed"))


_MARKED = [("fire_compartment", "FC-02", 1100), ("fire_compartment", "FC-03", 1200), ("fire_compartment", "FC-01", 100), ("door", "DR-001", 1090), ("door", "DR-002", 1090), ("shop", "SHOP-01", 300), ("shop", "SHOP-02", 500), ("fire_shutter", "FS-01", 700), ("evac_distance_line", "EVAC-01", 200), ("evac_distance_line", "EVAC-02", 200)]


@query(_values(_MARKED, "target_type, target_id, x", columns="target_type, target_id, CAST(x + 10 * k AS DOUBLE) AS x"))
def marked_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape that each marked target is drawn by."""
    found = evaluate_tables(_structured(spark, sf_dir), default_rules())
    return report.marked_shapes(report.marks(found), shapes(spark, sf_dir, "hall")).select("doc_id", "target_type", "target_id", F.get("points", F.lit(0))["x"].alias("x"))


@query(_values([("FC-01", "EX-01,EX-02,DR-002"), ("FC-02", "EX-03,DR-002"), ("FC-03", "")], "id, exits"))
def effective_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An always-open door of class A counts for the compartments on both sides of its wall, and for no other of their zone."""
    t = _structured(spark, sf_dir)
    opened = t["door"].withColumn("is_always_open", F.lit(True))
    found = derive.with_effective_exits(t["fire_compartment"], opened, derive.door_sides(shapes(spark, sf_dir, "hall")))
    return found.select("doc_id", "id", F.array_join("effective_exits.id", ",").alias("exits"))


@query(_values([(1, 1.95)], "doors, w", columns="CAST(doors AS BIGINT) AS doors, CAST(w AS DOUBLE) AS median_width_m"))
def median_door_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.median_door_width(_structured(spark, sf_dir)["door"])


@query(_values([("FC-01", 100, 4), ("FC-02", 1100, 4), ("FC-03", 1200, 4)], "id, x, n", columns="id, CAST(x + 10 * k AS DOUBLE) AS x, n"))
def compartment_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured compartments with the polygon in their place."""
    found = derive.with_rings(_structured(spark, sf_dir)["fire_compartment"], shapes(spark, sf_dir, "hall"))
    return found.select("doc_id", "id", F.get("points", F.lit(0))["x"].alias("x"), F.size("points").alias("n"))


@query(f"""WITH c AS ({_values([("FC-01", 100, 100, 1100, 900, 2000.0, None), ("FC-02", 1100, 100, 1900, 900, 1620.5, 1620.5), ("FC-03", 1200, 910, 1400, 990, 40.0, None)], "id, x0, y0, x1, y1, a, d", columns="k, id, x0, y0, x1, y1, a, d")}),
n AS (SELECT s_nationkey AS k, CAST((s_suppkey * 137) % 1700 + 110 AS DOUBLE) + 0.5 AS x, CAST((s_suppkey * 71) % 880 + 105 AS DOUBLE) + 0.5 AS y, CAST(200 + s_suppkey % 97 AS DOUBLE) + CASE WHEN s_suppkey % 3 > 0 THEN 0.25 ELSE 0 END AS v FROM supplier),
m AS (SELECT c.doc_id, c.id, round(median(v), 2) AS read FROM c JOIN n ON n.k = c.k AND n.x > c.x0 AND n.x < c.x1 AND n.y > c.y0 AND n.y < c.y1 WHERE v <> floor(v) GROUP BY ALL)
SELECT c.doc_id, c.id, CAST(a AS DOUBLE) AS area_m2, coalesce(CAST(d AS DOUBLE), read) AS area_m2_design FROM c LEFT JOIN m ON m.doc_id = c.doc_id AND m.id = c.id""")
def read_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing claims filled by the median of the numbers that were read inside, decimals only."""
    hall = shapes(spark, sf_dir, "hall")
    rings = numbered(hall.where("label = 'fire_compartment'"), "FC-%02d").select("doc_id", "id", F.transform("points", lambda p: g.point(p["x"], p["y"])).alias("points"))
    s = F.col("s_suppkey")
    numbers = table(spark, sf_dir, "supplier").select(F.format_string("hall-%d.jpg", "s_nationkey").alias("doc_id"), ((s * 137) % 1700 + 110.5 + 10 * F.col("s_nationkey")).alias("cx"), ((s * 71) % 880 + 105.5).alias("cy"), (200 + s % 97 + F.when(s % 3 > 0, 0.25).otherwise(0.0)).alias("value"))
    return derive.fill_designed_area(_structured(spark, sf_dir)["fire_compartment"], rings, numbers).select("doc_id", "id", F.round("area_m2", 6).alias("area_m2"), "area_m2_design")


@query(_values([("BC-01", "甲", "高层民用", "出入口"), ("BC-02", "办公楼", "高层民用", "风亭")], "id, building_name, building_category, nearest_kind", "site", "id, building_name, building_category, nearest_kind, CAST(10 + k AS DOUBLE) AS distance_m"))
def building_clearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.building_clearance(shapes(spark, sf_dir, "site")).select("doc_id", "id", "building_name", "building_category", "nearest_kind", "distance_m")


@query(_values([("VP-4-5", "V", "VENT-05", 3.0)], "id, fresh_id, other_id, m", "site", "id, fresh_id, other_id, CAST(m AS DOUBLE) AS distance_m, k % 3 = 2 AS is_exhaust_higher"))
def vent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = shapes(spark, sf_dir, "site")
    k = F.regexp_extract("doc_id", "(\\d+)", 1).cast("int")
    higher = site.where("label = 'vent_group_ground'").select("doc_id", "ord", F.when(F.col("ord") == 3, 5.0).otherwise(4.0 + k % 3).alias("height"))
    found = derive.vent_pairs(site, _scales(site), higher)
    return found.select("doc_id", "id", "fresh_id", "other_id", F.round("distance_m", 6).alias("distance_m"), "is_exhaust_higher")


# scales, names and measures


@query("SELECT concat('lengths-', k, '.jpg') AS doc_id, round(list_sort([0.05::DOUBLE, 0.0525::DOUBLE, (10 + k) / 300.0::DOUBLE])[2], 9) AS scale, CAST(3 AS BIGINT) AS pairs FROM (SELECT n_nationkey AS k FROM nation)")
def calibrated_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written lengths by the line nearest to each, and the median of their ratios."""
    return scale.from_shapes(shapes(spark, sf_dir, "lengths")).select("doc_id", F.round("scale", 9).alias("scale"), "pairs")


@query("SELECT k, CASE WHEN k % 3 = 0 THEN 0.01 * (k + 1) WHEN k % 2 = 0 THEN 0.5 END::DOUBLE AS scale, CASE WHEN k % 3 = 0 THEN 'manual' WHEN k % 2 = 0 THEN 'pdf_vector_text' ELSE 'missing' END AS source FROM (SELECT n_nationkey AS k FROM nation)")
def resolved_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    found = scale.resolve(F.when(k % 3 == 0, F.lit(0.01) * (k + 1)), F.when(k % 2 == 0, F.lit(0.5)))
    return rows.select("k", found["scale"].alias("scale"), found["source"].alias("source"))


@query(f"{_values([('box', 3, 'val_text', 'text_content=88㎡'), ('box', 4, 'fire_door', 'class=甲级;未知=x'), ('box', 5, '未知牌', '')], 'geom, ord, label, attrs', 'lengths')}")
def english_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese labels and attribute names renamed, written and read again."""
    path = scratch(spark, "english")
    sinks.write_annotations(annotations.english(_drawn(spark, sf_dir, "lengths").where("geom = 'box' and ord >= 3")), path)
    again = annotations.read_shapes(spark, path)
    return again.select(F.col("image").alias("doc_id"), "geom", (F.col("ord") + 3).alias("ord"), "label", _attrs_text(F.col("attrs")).alias("attrs"))


@query("SELECT kind, name, converted, unmapped, n * (SELECT count(*) FROM nation) AS n FROM (VALUES ('label', 'evac_distance_line', FALSE, FALSE, 3), ('label', 'dimension_val', FALSE, FALSE, 2), ('label', 'val_text', FALSE, FALSE, 2), ('label', '防火门', TRUE, FALSE, 1), ('label', '未知牌', FALSE, TRUE, 1), ('attribute', 'text_content', FALSE, FALSE, 4), ('attribute', '分类', TRUE, FALSE, 1), ('attribute', '未知', FALSE, TRUE, 1)) t(kind, name, converted, unmapped, n)")
def rename_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.conversion_counts(shapes(spark, sf_dir, "lengths"))


@query("SELECT concat('lengths-', k, '.jpg') AS doc_id, said FROM (SELECT n_nationkey AS k FROM nation), (VALUES ('甲级'), ('x')) t(said)")
def first_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several attributes that is not blank."""
    doors = shapes(spark, sf_dir, "lengths").where("label = '防火门'")
    said = F.explode(F.array(annotations.first_attr("class", "分类", "未知"), annotations.first_attr("none", "未知", "分类"))).alias("said")
    return doors.select("doc_id", said)


@query(f"{_values([('fire_compartment', 3, 3600.0 + 40, None), ('commercial_shop', 2, 45.0, None), ('evac_distance_line', 2, None, 40.0), ('width_dimension_line', 4, None, 7.7)], 'label, n, a, l', columns='label, CAST(n AS BIGINT) AS n, CAST(a AS DOUBLE) AS area_m2, CAST(l AS DOUBLE) AS length_m')}")
def measurement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured shapes of each drawing by type."""
    hall = shapes(spark, sf_dir, "hall").where("geom <> 'box'").withColumn("scale", F.lit(0.05))
    return documents.measurement_reports(hall).select("doc_id", "label", "n", F.round("area_m2", 6).alias("area_m2"), F.round("length_m", 6).alias("length_m"))


@query(_values([("polygon", 2, "fire_compartment", 40.0, None, 1300.0), ("polyline", 4, "evac_distance_line", None, 30.0, 300.0)], "geom, ord, label, a, l, x", columns="geom, ord, label, CAST(a AS DOUBLE) AS area_m2, CAST(l AS DOUBLE) AS length_m, CAST(x + 10 * k AS DOUBLE) AS x"))
def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested measurements of two shapes of each drawing, as JSON."""
    hall = shapes(spark, sf_dir, "hall").withColumn("scale", F.lit(0.05))
    told = documents.measurements(hall).select("doc_id", F.explode("measured").alias("m")).select("doc_id", "m.*").where("(geom = 'polygon' and ord = 2) or (geom = 'polyline' and ord = 4)")
    return told.select("doc_id", "geom", "ord", "label", F.round("area_m2", 6).alias("area_m2"), F.round("length_m", 6).alias("length_m"), F.round("centre.x", 6).alias("x"))


# evacuation


@query("SELECT CAST(k AS VARCHAR) AS doc_id, unnest(range(0, 3 + k % 4)) AS x, y FROM (SELECT n_nationkey AS k, unnest(range(0, 2 + n_nationkey % 3)) AS y FROM nation)")
def evac_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid cells of a rectangle that fills its drawing."""
    k = F.col("n_nationkey")
    w, h = (20.0 * (3 + k % 4)), (20.0 * (2 + k % 3))
    areas = table(spark, sf_dir, "nation").select(k.cast("string").alias("doc_id"), g.box_ring(F.lit(0), F.lit(0), w, h).alias("points"), w.alias("width"), h.alias("height"))
    return evac.passable_cells(areas).select("doc_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


_WALLS = "NOT (x = 5 AND y < 7) AND NOT (x = 8 AND y > r)"


@query(f"""WITH RECURSIVE c AS (SELECT DISTINCT n_regionkey AS r, x, y FROM nation, range(0, 12) t(x), range(0, 8) u(y) WHERE {_WALLS}),
w(r, x, y, a, b) AS (SELECT DISTINCT n_regionkey, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, 0 FROM nation
UNION SELECT c.r, c.x, c.y, w.a + CASE WHEN c.x = w.x OR c.y = w.y THEN 1 ELSE 0 END, w.b + CASE WHEN c.x = w.x OR c.y = w.y THEN 0 ELSE 1 END FROM w JOIN c ON c.r = w.r AND abs(c.x - w.x) <= 1 AND abs(c.y - w.y) <= 1 AND (c.x <> w.x OR c.y <> w.y) WHERE w.a + w.b < 30),
d AS (SELECT r, x, y, min(a + b * sqrt(2)) AS d FROM w GROUP BY r, x, y), n AS (SELECT r, count(*) AS n FROM c GROUP BY r)
SELECT CAST(d.r AS VARCHAR) AS doc_id, round(max(d), 2) AS max_distance_m, CAST(arg_max(x, d * 10000 - y * 100 - x) * 20 AS INTEGER) AS farthest_x, CAST(arg_max(y, d * 10000 - y * 100 - x) * 20 AS INTEGER) AS farthest_y, 'EX-01' AS nearest_exit_id, any_value(n) AS mask_cells, CAST(0 AS BIGINT) AS unreachable_cells FROM d JOIN n ON n.r = d.r GROUP BY d.r""")
def evac_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest ways out of small mazes."""
    regions = table(spark, sf_dir, "nation").select("n_regionkey").distinct()
    grid = regions.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(7))))
    cells = grid.where("not (x = 5 and y < 7) and not (x = 8 and y > n_regionkey)").select(F.col("n_regionkey").cast("string").alias("doc_id"), "x", "y")
    docs = regions.select(F.col("n_regionkey").cast("string").alias("doc_id"))
    exits = docs.select("doc_id", F.lit(0).alias("ord"), F.lit("EX-01").alias("id"), F.lit(5.0).alias("x"), F.lit(5.0).alias("y"))
    return evac.evacuation(cells, exits, docs.withColumn("scale", F.lit(0.05)))


_OCTILE = "greatest(a, b) + (sqrt(2) - 1) * least(a, b)"


@query(f"SELECT CAST(k AS VARCHAR) AS doc_id, 'EVAC-DERIVED-01' AS id, round({_OCTILE}, 2) AS length_m, 'any_to_exit' AS kind FROM (SELECT n_nationkey AS k, 9 + n_nationkey AS a, 4 + n_nationkey % 4 AS b FROM nation)")
def derived_evacuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived line of an empty rectangular hall with an exit in its corner: of its public area, and of its public exit."""
    k = F.col("n_nationkey")
    w, h = 20.0 * (10 + k), 20.0 * (5 + k % 4)
    nation = table(spark, sf_dir, "nation")
    drawn = nation.select(k.cast("string").alias("doc_id"), F.lit("polygon").alias("geom"), F.lit("public_area").alias("label"), g.box_ring(F.lit(0), F.lit(0), w, h).alias("points"), w.alias("width"), h.alias("height"), F.array().cast("array<struct<name:string,value:string>>").alias("attrs"))
    exit_at = lambda x, y, o, zone: F.struct(F.lit(o).alias("ord"), F.lit(f"EX-{o}").alias("id"), F.lit(zone).alias("zone"), F.array(F.lit(x), F.lit(y)).alias("center_px"))
    exits = nation.select(k.cast("string").alias("doc_id"), F.inline(F.array(exit_at(10.0, 10.0, 1, "public"), exit_at(50.0, 50.0, 2, "equipment_unmanned"))))
    scales = nation.select(k.cast("string").alias("doc_id"), F.lit(0.05).alias("scale"))
    return evac.derived_lines(drawn, exits, scales).select("doc_id", "id", "length_m", "kind")


# files by name


@query("SELECT concat('drawing ', k, '.jpg') AS name, concat('/xml/', k % 5, '.xml') AS path FROM (SELECT n_nationkey AS k FROM nation)")
def image_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image with the first annotation file that has its name or stem."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    files = names.groupBy((F.col("k") % 5).alias("f")).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("<drawing %d|", "k"))), " ").alias("body")).select(F.format_string("/xml/%d.xml", "f").alias("path"), "body")
    wanted = names.select(F.format_string("drawing %d.jpg", "k").alias("name"))
    # names end where another character than a digit follows, so 1 is not found in 12
    ended = wanted.select(F.regexp_replace("name", ".jpg$", "|.jpg").alias("name"))
    return matching.first_containing(ended, files).select(F.replace("name", F.lit("|"), F.lit("")).alias("name"), "path")


_STATIONS = "CASE k % 3 WHEN 0 THEN '明海' WHEN 1 THEN '珠光' ELSE '石龙' END"


@query(f"SELECT concat('/in/', k, '/', {_STATIONS}, '站站厅层.jpg') AS path, concat('/xml/', {_STATIONS}, '站站厅层.xml') AS match FROM (SELECT n_nationkey AS k FROM nation)")
def drawing_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings with the annotation file of their station and kind."""
    k = F.col("n_nationkey")
    name = F.when(k % 3 == 0, "明海").when(k % 3 == 1, "珠光").otherwise("石龙")
    drawings = table(spark, sf_dir, "nation").select(F.concat(F.lit("/in/"), k.cast("string"), F.lit("/"), name, F.lit("站站厅层.jpg")).alias("path"))
    files = spark.createDataFrame([(f"/xml/{s}站{kind}.xml",) for s in ("明海", "珠光", "石龙") for kind in ("总平面图", "站厅层", "站台层")], "path string")
    return matching.drawing_to_annotation(drawings, files)


@query("SELECT concat(k, '-plan.jpg') AS image, CASE k % 3 WHEN 0 THEN concat('own ', k) WHEN 1 THEN concat('held ', k) ELSE 'own 0' END AS result FROM (SELECT n_nationkey AS k FROM nation)")
def image_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of an image's name, else one that holds its stem, else the first by name."""
    k = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation")
    name = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit("-plan.jpg"))).when(k % 3 == 1, F.concat(F.lit("x "), k.cast("string"), F.lit("-plan detail.json")))
    results = nation.select(name.alias("name"), F.when(k % 3 == 0, F.format_string("own %d", k)).otherwise(F.format_string("held %d", k)).alias("result")).where("name is not null")
    images = nation.select(F.concat(k.cast("string"), F.lit("-plan.jpg")).alias("image"))
    # stems that others hold: 1-plan in 11-plan
    padded = lambda df, c: df.withColumn(c, F.regexp_replace(c, "(\\d+)-plan", "<$1-plan"))
    return matching.results_of_images(padded(images, "image"), padded(results, "name")).select(F.replace("image", F.lit("<"), F.lit("")).alias("image"), "result")


@query("SELECT s_suppkey AS k, n, CASE WHEN s_suppkey % 4 < 3 THEN CAST(s_nationkey AS DOUBLE) END AS box FROM supplier, (VALUES (0), (1)) t(n)")
def finding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the place of the number that they came from: equal findings stay apart, a tenth is near enough, three are not."""
    s = F.col("s_suppkey")
    supplier = table(spark, sf_dir, "supplier")
    value = s.cast("double") + 0.25
    findings = supplier.select(s.cast("string").alias("doc_id"), s.alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n"), value.alias("value_num"))
    off = F.when(s % 4 == 0, 0.0).when(s % 4 == 1, 0.004).when(s % 4 == 2, 0.02).otherwise(0.4)
    numbers = supplier.select(s.cast("string").alias("doc_id"), F.lit(1).alias("num_ord"), (value + off).alias("value"), F.array(F.col("s_nationkey").cast("double")).alias("box"))
    numbers = numbers.unionByName(numbers.withColumn("num_ord", F.lit(2)).withColumn("box", F.array(F.lit(-1.0))))
    return matching.values_to_numbers(findings, numbers).select("k", "n", F.col("box")[0].alias("box"))
