from __future__ import annotations

import json

import pytest

from lintel.plans.rules import default_rules, evaluate_documents, lint, parse_rules
from lintel.plans.rules.model import RuleError

STATION = {"type": "underground", "height_m": 0, "transfer_lines": 1, "project_all_doors_class_A": False}


def findings(spark, *documents):
    docs = spark.createDataFrame([(str(i), json.dumps(d, ensure_ascii=False)) for i, d in enumerate(documents)], "doc_id string, body string")
    return evaluate_documents(docs, default_rules()).orderBy("doc_id", "rule_ord", "target_ord").collect()


def verdicts(rows, rule):
    return [(r["doc_id"], r["passed"], r["value"]) for r in rows if r["rule_id"] == rule]


def test_standard_set():
    rules = default_rules()
    assert len(rules) == 37 and len({r.rule_id for r in rules}) == 37
    assert sum(r.mandatory for r in rules) == 32
    assert {r.check.kind for r in rules} == {"compare", "count", "sum_aggregate"}


def test_missing_null_and_types(spark):
    public = {"id": "FC", "zone_type": "public", "area_m2": 4000}
    cases = [public, public | {"is_shared_concourse": None}, public | {"is_shared_concourse": False}, public | {"is_shared_concourse": True}]
    cases += [public | {"is_shared_concourse": False, "area_m2": v} for v in (None, "5000", 6000)]
    no_area = {k: v for k, v in public.items() if k != "area_m2"} | {"is_shared_concourse": False}
    rows = findings(spark, *({"station": STATION, "fire_compartment": [c]} for c in [*cases, no_area]))
    assert verdicts(rows, "AREA-PUB-001") == [("1", True, "4000"), ("2", True, "4000"), ("4", None, None), ("5", None, "5000"), ("6", False, "6000"), ("7", None, None)]
    reasons = {r["doc_id"]: r["reason"] for r in rows if r["rule_id"] == "AREA-PUB-001"}
    assert reasons["4"] == reasons["7"] == "缺少字段 target.area_m2" and reasons["5"] == "类型不匹配"
    assert all(r["review_required"] == (r["passed"] is None) for r in rows)


def test_collections(spark):
    rows = findings(
        spark,
        *({"station": STATION | {"public_zone": z}} for z in ({}, {"exits": [], "commercial_shops": []}, {"exits": {}, "commercial_shops": None}, {"exits": [{"leads_to": "ground"}, {"leads_to": "x"}, {}, {"leads_to": "ground"}], "commercial_shops": [{"area_m2": 40}, {"area_m2": 70.5}]}, {"commercial_shops": [{"area_m2": 1}, {"id": "x"}]})),
        {"station": {}},
        {},
    )
    assert verdicts(rows, "EXIT-NUM-PUB-001") == [("0", None, None), ("1", False, "0"), ("2", None, None), ("3", True, "2"), ("4", None, None)]
    assert verdicts(rows, "SHOP-AREA-TOTAL-PUB-001") == [("0", None, None), ("1", True, "0"), ("2", None, None), ("3", False, "110.5"), ("4", None, None)]
    assert all(r["target_id"] is None for r in rows)


@pytest.mark.parametrize("opening,width,rule,passed,threshold", [(30, 10, "LE30", True, "10"), (30.01, 12, "GT30", False, "10.003"), (90, 20, "GT30", True, "20"), (45, 15, "GT30", True, "15.0")])
def test_dynamic_threshold(spark, opening, width, rule, passed, threshold):
    rows = findings(spark, {"station": STATION, "fire_shutter": [{"id": "S", "opening_width_m": opening, "shutter_width_m": width}]})
    assert [(r["rule_id"], r["passed"], r["threshold"]) for r in rows if r["target_type"] == "fire_shutter"] == [(f"SHUTTER-WIDTH-{rule}-001", passed, threshold)]


def test_branches_by_station(spark):
    zone = [{"id": "E", "zone_type": "equipment_staffed", "area_m2": 2000, "exits": [{"leads_to": "ground"}], "effective_exits": [{}, {}]}]
    stations = [STATION | {"type": "elevated", "height_m": h} for h in (24, 24.1)] + [STATION | {"type": "at_grade"}]
    rows = findings(spark, *({"station": s, "fire_compartment": zone} for s in stations))
    assert [(r["doc_id"], r["rule_id"], r["passed"]) for r in rows if r["category"] == "防火分区面积"] == [("0", "AREA-EQUIP-ELEV-LOW-001", True), ("1", "AREA-EQUIP-ELEV-HIGH-001", False), ("2", "AREA-EQUIP-AG-001", True)]
    shared = [{"id": "P", "zone_type": "public", "is_shared_concourse": True, "area_m2": 12000} | extra for extra in ({}, {"has_sprinkler": False}, {"has_sprinkler": True})]
    rows = findings(spark, {"station": STATION | {"transfer_lines": 3}, "fire_compartment": shared}, {"station": STATION | {"transfer_lines": 2}, "fire_compartment": shared[:1]})
    assert [v[1] for v in verdicts(rows, "AREA-PUB-TRANSFER-3L-SPRINKLER-001")] == [None, False, True]
    assert verdicts(rows, "AREA-PUB-TRANSFER-2L-001") == [("1", False, "12000")]


def test_messages_of_passes_are_rendered_too(spark):
    rows = [r for r in findings(spark, {"station": STATION, "shop": [{"id": "A", "area_m2": 28}]}) if r["target_type"] == "shop"]
    assert rows[0]["message"] == "商铺 A 面积 28㎡ > 30㎡" and rows[0]["passed"]


def test_lint_and_errors(spark):
    good = {"rule_id": "A", "name": "", "category": "", "target": "x", "applies_when": [], "check": {"type": "compare", "op": "le", "path": "target.x", "threshold": 1}, "mandatory": True, "severity": "warning", "source": "", "message": ""}
    document = {"rules": [good, good, good | {"rule_id": "B", "check": {"op": "most", "type": "compare", "path": "target.x"}}, {k: v for k, v in good.items() if k != "source"} | {"rule_id": "C"}]}
    problems = {(r["rule_id"], r["problem"]) for r in lint(spark.createDataFrame([(json.dumps(document),)], "body string")).collect()}
    assert problems == {("A", "repeated id"), ("B", "unknown operator most"), ("C", "missing key source")}
    with pytest.raises(RuleError):
        parse_rules({"rules": [document["rules"][2]]})
