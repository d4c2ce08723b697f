from __future__ import annotations

import json

from pyspark.sql import functions as F

from lintel.operators import matching
from lintel.plans import derive, documents, report
from lintel.plans.rules import default_rules, evaluate_documents, evaluate_tables
from lintel.sources import annotations, sinks

from .test_derive import HALL


def test_nested_documents_give_the_findings_of_tables(spark, tmp_path):
    (tmp_path / "hall.xml").write_text(HALL, encoding="utf-8")
    shapes = annotations.read_shapes(spark, str(tmp_path)).cache()
    tables = derive.structure(shapes, shapes.select("doc_id").distinct().withColumn("scale", F.lit(0.05)))
    nested = documents.nest(tables).cache()
    body = json.loads(nested.first()["body"])
    assert [d["id"] for d in body["fire_compartment"]] == ["FC-01", "FC-02"] and body["door"][0]["distance_to_nearest_exit_m"] is None
    columns = ("rule_id", "target_id", "passed", "value_num", "threshold", "reason", "severity")
    told = lambda df: sorted(map(str, df.select(*columns).collect()))
    typed = evaluate_tables(tables, default_rules()).cache()
    assert told(evaluate_documents(nested, default_rules())) == told(typed)
    placed = report.marked_shapes(report.marks(typed), shapes)
    assert {(r["target_id"], len(r["points"])) for r in placed.collect()} >= {("FC-01", 4), ("DR-001", 2), ("EVAC-01", 3)}
    measured = documents.measurements(derive.scaled(shapes, shapes.select("doc_id").distinct().withColumn("scale", F.lit(0.05)))).first()["measured"]
    assert len(measured) == 11 and any(m["area_m2"] == 2000 for m in measured)
    sinks.write_json(typed.select("rule_id", "doc_id"), str(tmp_path / "out"), ("rule_id",))
    assert spark.read.json(str(tmp_path / "out")).count() == 14


def test_text_layer(spark):
    rows = [("d", 0, 0, "图例 防火分区一 3861.71", [1.23, 2.0, 3.0, 4.0]), ("d", 0, 1, "防火分区一（公共区）：面积3900m", [0.0]), ("d", 0, 2, "防火分区二:1135.59m2", [0.0]), ("d", 0, 3, "other", [0.0])]
    found = documents.compartments_of_text(spark.createDataFrame(rows, annotations.contract("text_blocks")))
    assert sorted((r["seq"], r["area_m2"], r["zone_type"]) for r in found.collect()) == [("一", 3900.0, "public"), ("二", 1135.59, "unknown")]
    assert tuple(documents.text_consistency(found).first()) == ("d", 2, 5035.59, "防火分区二")


def test_flat_documents(spark):
    numbers = spark.createDataFrame([("d", 2, 6000.0), ("d", 1, 400.0), ("d", 3, 55.0), ("d", 4, 5.0)], "doc_id string, ord int, value double")
    found = evaluate_documents(documents.flat_document(numbers), default_rules()).collect()
    assert {(r["rule_id"], r["target_id"], r["passed"]) for r in found} == {("AREA-PUB-001", "FC-01", True), ("AREA-PUB-001", "FC-02", False), ("EVAC-DIST-ANY-001", "EVAC-01", False)}
    region = spark.createDataFrame([("d", [(0.0, 0.0), (100.0, 0.0), (100.0, 60.0), (0.0, 60.0)])], "doc_id string, points array<struct<x:double,y:double>>")
    assert documents.inverse_scale(numbers, region).first()["scale"] == 1.0


def test_flat_documents_of_one_place_go_by_value(spark):
    """Whatever order the rows come in."""
    numbers = [("d", 1, v) for v in (6000.0, 400.0, 9000.0, 500.0)]
    told = [documents.flat_document(spark.createDataFrame(rows, "doc_id string, ord int, value double").coalesce(1)).first()["body"] for rows in (numbers, numbers[::-1])]
    assert told[0] == told[1]
    assert [(c["id"], c["area_m2"]) for c in json.loads(told[0])["fire_compartment"]] == [("FC-01", 400.0), ("FC-02", 500.0), ("FC-03", 6000.0), ("FC-04", 9000.0)]


def test_vent_pairs_and_values(spark):
    ring = lambda x: [(x, 0.0), (x + 10, 0.0), (x + 10, 10.0), (x, 10.0)]
    shape = lambda k, x, use: ("d", "f", "i", 1.0, 1.0, "polygon", k, "vent_group_ground", ring(x), [("vent_function", use)])
    shapes = spark.createDataFrame([shape(0, 0.0, "新风"), shape(1, 60.0, "排风"), shape(2, 20.0, "排烟")], annotations.SHAPES)
    scales = spark.createDataFrame([("d", 0.1)], "doc_id string, scale double")
    (pair,) = derive.vent_pairs(shapes, scales).collect()
    assert (pair["id"], pair["distance_m"], pair["is_exhaust_higher"]) == ("VP-1-2", 5.0, None)
    findings = spark.createDataFrame([("d", 1.234), ("d", 5.06), ("d", 9.0)], "doc_id string, value_num double")
    read = spark.createDataFrame([("d", 0, 5.12, [1.0]), ("d", 1, 1.23, [2.0]), ("d", 2, 1.23, [3.0])], "doc_id string, num_ord int, value double, box array<double>")
    assert {(r["value_num"], r["box"] and r["box"][0]) for r in matching.values_to_numbers(findings, read).collect()} == {(1.234, 2.0), (5.06, 1.0), (9.0, None)}
    results = spark.createDataFrame([("b.jpg", 1), ("a-1.xml", 2)], "name string, result int")
    assert {(r["image"], r["result"]) for r in matching.results_of_images(spark.createDataFrame([("b.jpg",), ("a.jpg",), ("z.jpg",)], "image string"), results).collect()} == {("b.jpg", 1), ("a.jpg", 2), ("z.jpg", 2)}


def test_rules_written_out(spark):
    rows = {r["rule_id"]: r for r in report.rule_table(spark, default_rules()).collect()}
    assert rows["SHUTTER-WIDTH-GT30-001"]["requirement"] == "target.shutter_width_m ≤ min(target.opening_width_m / 3, 20)"
    assert rows["EXIT-NUM-PUB-001"]["requirement"] == "count(target.public_zone.exits) where item.leads_to = ground ≥ 2"
    assert rows["AREA-EQUIP-UG-001"]["applies"] == "station.type = underground and target.zone_type ∈ {equipment_unmanned, equipment_staffed}"


def test_training_metrics(spark, tmp_path):
    (tmp_path / "m.csv").write_text("epoch, time\n1, 2.5\n2, x\n")
    assert [tuple(r) for r in annotations.read_training_metrics(spark, str(tmp_path / "m.csv")).collect()] == [(1.0, 2.5), (2.0, None)]


def test_documents_are_grouped_and_read_once(spark):
    """One shuffle for all tables and types: a join for each table, made again for each type, filled the driver with stages."""
    station = spark.createDataFrame([("d", 3.0), ("e", 4.0)], "doc_id string, height_m double")
    table = lambda kind: spark.createDataFrame([("d", 1, f"{kind}-2", 20.0), ("d", 0, f"{kind}-1", 400.0), ("x", 0, "lost", 1.0)], "doc_id string, ord int, id string, area_m2 double")
    nested = documents.nest({"station": station} | {kind: table(kind) for kind in ("fire_compartment", "door", "shop")})
    bodies = {r["doc_id"]: json.loads(r["body"]) for r in nested.collect()}
    listed = lambda kind: [{"id": f"{kind}-1", "area_m2": 400.0}, {"id": f"{kind}-2", "area_m2": 20.0}]
    assert bodies == {"d": {"station": {"height_m": 3.0}, **{k: listed(k) for k in ("fire_compartment", "door", "shop")}}, "e": {"station": {"height_m": 4.0}, "fire_compartment": [], "door": [], "shop": []}}
    found = evaluate_documents(nested, default_rules())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert {(r["target_id"], r["passed"]) for r in found.collect() if r["rule_id"] == "SHOP-AREA-EACH-001"} == {("shop-1", False), ("shop-2", True)}
