"""Queries of the standard rule set over object tables made from the parts, and of the reports on their findings.

A part is a drawing with one object of each kind, whose values go by the part's key and size, so that each rule meets
objects that it passes, fails, leaves for review and does not apply to. The SQL of the rules is written from the rule
records by a few lines that know nothing of the engine's compiler.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import documents, report
from .opinions import OPINIONS
from .registry import query, table
from .rules import default_rules, evaluate_documents, evaluate_tables
from .rules.compiler import FINDING, TARGETS
from .rules.standard import STANDARD

_ZONE = "CASE s % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'equipment_unmanned' WHEN 2 THEN 'equipment_staffed' ELSE 'public' END"

#: Columns of the object tables: type and value by key k and size s of a part, the same text in both dialects.
OBJECTS: dict[str, dict[str, tuple[str, str]]] = {
    "station": {
        "type": ("text", "CASE k % 3 WHEN 0 THEN 'underground' WHEN 1 THEN 'at_grade' ELSE 'elevated' END"), "height_m": ("num", "CAST(20 + s % 10 AS DOUBLE)"), "transfer_lines": ("num", "1 + k % 4"), "project_all_doors_class_A": ("bool", "k % 5 = 0"),
    },
    "fire_compartment": {
        "id": ("text", "concat('FC-', k)"), "zone_type": ("text", _ZONE), "is_shared_concourse": ("bool", "CASE WHEN k % 5 < 3 THEN TRUE WHEN k % 5 = 3 THEN FALSE END"),
        "area_m2": ("num", "CASE WHEN k % 11 > 0 THEN CAST(400 * s + k % 7 AS DOUBLE) END"), "has_sprinkler": ("bool", "CASE WHEN k % 13 < 6 THEN TRUE WHEN k % 13 < 10 THEN FALSE END"),
    },
    "exit_pair": {
        "id": ("text", "concat('EXP-', k)"), "exit_a": ("text", "concat('A-', k)"), "exit_b": ("text", "concat('B-', k)"), "relation": ("text", "CASE k % 3 WHEN 0 THEN 'same_direction' WHEN 1 THEN 'adjacent' ELSE 'other' END"), "distance_m": ("num", "CASE WHEN k % 9 > 0 THEN CAST(s AS DOUBLE) END"),
    },
    "door": {
        "id": ("text", "concat('DR-', k)"), "is_evacuation": ("bool", "k % 6 > 0"), "clear_width_m": ("num", "CASE WHEN k % 10 > 0 THEN CAST(7 + s % 5 AS DOUBLE) / 10 END"), "swing_direction": ("text", "CASE k % 3 WHEN 0 THEN 'reverse' ELSE 'evacuation' END"), "zone": ("text", _ZONE),
        "position": ("text", "CASE k % 2 WHEN 0 THEN 'between_exits' ELSE 'dead_end' END"), "distance_to_nearest_exit_m": ("num", "CASE WHEN k % 8 > 1 THEN CAST(s AS DOUBLE) END"), "class": ("text", "CASE k % 4 WHEN 0 THEN '甲级' WHEN 1 THEN '乙级' WHEN 2 THEN '甲级' END"), "is_on_firewall": ("bool", "s % 3 = 0"),
    },
    "corridor": {
        "id": ("text", "concat('COR-', k)"), "kind": ("text", "CASE s % 6 WHEN 0 THEN 'evac_corridor' WHEN 1 THEN 'evac_stair' WHEN 2 THEN 'equip_corridor_single' WHEN 3 THEN 'equip_corridor_double' WHEN 4 THEN 'entrance_passage' ELSE 'ground_stair_landing' END"),
        "clear_width_m": ("num", "CAST(8 + k % 9 AS DOUBLE) / 10"), "length_m": ("num", "CAST(50 + k % 100 AS DOUBLE)"),
    },
    "evac_distance_line": {"id": ("text", "concat('EVAC-', k)"), "kind": ("text", "CASE k % 7 WHEN 0 THEN 'other' ELSE 'any_to_exit' END"), "length_m": ("num", "CAST(2 * s AS DOUBLE)")},
    "shop": {"id": ("text", "concat('SHOP-', k)"), "area_m2": ("num", "CAST(s AS DOUBLE)")},
    "shop_pair": {"id": ("text", "concat('SP-', k)"), "shop_a": ("text", "concat('S', k)"), "shop_b": ("text", "concat('T', k)"), "opening_distance_m": ("num", "CAST(s % 16 AS DOUBLE)")},
    "vent_pair": {
        "id": ("text", "concat('VP-', k)"), "kind": ("text", "CASE k % 5 WHEN 0 THEN 'fresh_vs_fresh' ELSE 'fresh_vs_exhaust_or_piston' END"), "fresh_id": ("text", "concat('F', k)"), "other_id": ("text", "concat('O', k)"), "distance_m": ("num", "CAST(s % 20 AS DOUBLE)"),
        "is_exhaust_higher": ("bool", "CASE s % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END"),
    },
    "fire_shutter": {"id": ("text", "concat('FS-', k)"), "opening_width_m": ("num", "CAST(s + 15 AS DOUBLE)"), "shutter_width_m": ("num", "CAST(k % 25 AS DOUBLE)")},
    "building_clearance": {
        "id": ("text", "concat('BC-', k)"), "building_name": ("text", "concat('楼', k)"), "building_category": ("text", "CASE k % 4 WHEN 0 THEN '多层民用' WHEN 1 THEN '高层民用' WHEN 2 THEN '加油加气加氢站' ELSE '其他' END"), "distance_m": ("num", "CASE WHEN k % 9 > 0 THEN CAST(2 * s AS DOUBLE) / 2 + s % 4 * 10 END"),
    },
}
#: Numbers of elements of the tables' lists by k and s, and what sum of areas the shops have; null where one lacks its area.
_GROUND, _SHOPS, _EFFECTIVE, _OWN_GROUND = "k % 4", "s % 6", "k % 4", "s % 2"
_SHOP_AREA = f"CASE WHEN k % 7 > 0 OR {_SHOPS} = 0 THEN CAST(10 * ({_SHOPS}) + 5 * ({_SHOPS}) * ({_SHOPS} - 1) AS DOUBLE) END"

_SIGNS = {"le": "<=", "ge": ">=", "lt": "<", "gt": ">", "eq": "="}
_SHOWN_SIGNS = {"le": "≤", "ge": "≥", "eq": "="}


def _literal(v: Any) -> str:
    return str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)


def _where(conditions: list[dict]) -> str:
    parts = ["TRUE"]
    for c in conditions:
        root, _, name = c["path"].partition(".")
        column = f"{root}.{name}"
        listed = f"({', '.join(map(_literal, c['value']))})" if isinstance(c["value"], list) else _literal(c["value"])
        parts.append(f"{column} IS DISTINCT FROM {listed}" if c["op"] == "ne" else f"{column} IN {listed}" if c["op"] == "in" else f"{column} {_SIGNS[c['op']]} {listed}")
    return " AND ".join(parts)


def _text(kind: str, column: str) -> str:
    return f"CASE WHEN {column} THEN 'True' WHEN NOT {column} THEN 'False' END" if kind == "bool" else f"CAST({column} AS VARCHAR)"


def _message(rule: dict, value: str, threshold: str, reason: str) -> str:
    """The filled template: pieces between braces, and the note of a review."""
    pieces = []
    for i, part in enumerate(rule["message"].replace("{", "}").split("}")):
        if i % 2 == 0:
            pieces.append(f"'{part.replace(chr(39), chr(39) * 2)}'")
        elif part.startswith("target."):
            name = part.removeprefix("target.")
            kind = OBJECTS[rule["target"]][name][0]
            pieces.append(f"coalesce({_text(kind, f'target.{name}')}, 'None')")
        else:
            pieces.append(f"coalesce({value if part == 'value' else threshold}, 'None')")
    return f"concat({', '.join(pieces)}, coalesce('  [待人工复核: ' || {reason} || ']', ''))"


def _lists(rule: dict) -> tuple[str, str, str]:
    """The number that a count or sum comes to, as a number and as text, and what is lacking."""
    count = {"EXIT-NUM-PUB-001": _GROUND, "EXIT-NUM-EQUIP-001": _EFFECTIVE, "EXIT-NUM-EQUIP-STAFFED-001": _OWN_GROUND, "SHOP-COUNT-PUB-001": _SHOPS}.get(rule["rule_id"])
    if count:
        number = f"CAST(({count.replace('k', 'target.k').replace('s ', 'target.s ')}) AS DOUBLE)"
        return number, f"CAST(CAST({number} AS BIGINT) AS VARCHAR)", "NULL"
    number = "target.shop_area"
    return number, f"CASE WHEN target.s % 6 = 0 THEN '0' ELSE CAST({number} AS VARCHAR) END", "CASE WHEN target.shop_area IS NULL THEN '集合元素缺字段 area_m2' END"


def findings_sql() -> str:
    """The findings of the standard rules as a SELECT."""
    made = {name: ", ".join([f"{expr} AS {column}" for column, (_, expr) in columns.items()]) for name, columns in OBJECTS.items()}
    tables = ", ".join(f"t_{name} AS (SELECT k AS doc_id, k, s, {columns}{f', {_SHOP_AREA} AS shop_area, CAST(NULL AS VARCHAR) AS id' if name == 'station' else ''} FROM p)" for name, columns in made.items())
    rules = []
    for order, rule in enumerate(STANDARD["rules"]):
        check, target = rule["check"], rule["target"]
        if check["type"] == "compare":
            name = check["path"].removeprefix("target.")
            kind, column = OBJECTS[target][name][0], f"target.{name}"
            number = {"num": f"CAST({column} AS DOUBLE)", "bool": f"CAST(CAST({column} AS INTEGER) AS DOUBLE)", "text": "CAST(NULL AS DOUBLE)"}[kind]
            value, reason = _text(kind, column), f"CASE WHEN {column} IS NULL THEN '缺少字段 {check['path']}' END"
        else:
            number, value, reason = _lists(rule)
            column = number
        if "threshold" in check:
            limit, shown = _literal(check["threshold"]), f"'{check['threshold']}'"
        else:
            scaled = f"{check['threshold_path']} / {check['threshold_divisor']}"
            limit = f"round(least({scaled}, {check['threshold_cap']}), 3)"
            shown = f"CASE WHEN {scaled} > {check['threshold_cap']} THEN '{check['threshold_cap']}' ELSE CAST(round({scaled}, 3) AS VARCHAR) END"
        rules.append(
            f"SELECT target.doc_id, {order} AS rule_ord, '{rule['rule_id']}' AS rule_id, '{target}' AS target_type, target.id AS target_id, {column} {_SIGNS[check['op']]} {limit} AS passed, CASE WHEN {column} IS NOT NULL THEN {value} END AS value, {number} AS value_num, {shown} AS threshold, "
            f"{reason} AS reason, '{rule['severity']}' AS severity, {_message(rule, f'CASE WHEN {column} IS NOT NULL THEN {value} END', shown, reason)} AS message, '{_SHOWN_SIGNS[check['op']]}' AS sign FROM t_{target} target JOIN t_station station ON station.doc_id = target.doc_id WHERE {_where(rule['applies_when'])}"
        )
    return f"WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part), {tables}, f AS ({' UNION ALL '.join(rules)})"


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The object tables of the parts."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    items = lambda n, item: F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), item)).otherwise(F.array().cast("array<struct<id:string,leads_to:string>>"))
    exits = lambda n, other: F.concat(items(F.expr(n), lambda i: F.struct(F.format_string("E%d", i).alias("id"), F.lit("ground").alias("leads_to"))), items(F.lit(other), lambda i: F.struct(F.format_string("X%d", i).alias("id"), F.lit("other").alias("leads_to"))))
    shop = lambda i: F.struct(F.format_string("S%d", i).alias("id"), F.when((F.col("k") % 7 > 0) | (i > 1), 10.0 * i).alias("area_m2"))
    shops = F.when(F.expr(_SHOPS) > 0, F.transform(F.sequence(F.lit(1), F.expr(_SHOPS).cast("int")), shop)).otherwise(F.array().cast("array<struct<id:string,area_m2:double>>"))
    more = {
        "station": [F.struct(shops.alias("commercial_shops"), exits(_GROUND, 1).alias("exits")).alias("public_zone")],
        "fire_compartment": [exits(_OWN_GROUND, 1).alias("exits"), exits(_EFFECTIVE, 0).alias("effective_exits")],
    }
    out = {}
    for name in TARGETS:
        place = [] if name == "station" else [F.lit(0).alias("ord")]
        out[name] = parts.select(F.col("k").cast("string").alias("doc_id"), *place, *(F.expr(expr).alias(c) for c, (_, expr) in OBJECTS[name].items()), *more.get(name, []))
    return out


def _found(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    return evaluate_tables(_tables(spark, sf_dir), default_rules(), fields or FINDING)


def _keyed(found: DataFrame, *columns: str) -> DataFrame:
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *columns)


_COLUMNS = ("rule_id", "target_id", "passed", "value", "value_num", "threshold", "reason", "severity", "message")
_ALL = f"{findings_sql()} SELECT doc_id, {', '.join(_COLUMNS)} FROM f"


@query(_ALL)
def standard_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 37 rules over typed object tables."""
    return _keyed(_found(spark, sf_dir), *_COLUMNS)


@query(_ALL)
def standard_rules_on_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the tables nested into one JSON document a drawing."""
    return _keyed(evaluate_documents(documents.nest(_tables(spark, sf_dir)), default_rules()), *_COLUMNS)


@query(f"{findings_sql()} SELECT rule_id, count(*) AS total, count(*) FILTER (passed) AS pass, count(*) FILTER (NOT passed) AS fail, count(*) FILTER (passed IS NULL) AS review FROM f GROUP BY rule_id")
def standard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_found(spark, sf_dir, "rule_id", "passed", "review_required"), "rule_id")


@query(f"{findings_sql()} SELECT doc_id, rule_id, target_id, reason, message, seq FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rule_ord) AS INTEGER) AS seq FROM f WHERE passed IS NULL) WHERE seq <= 3")
def review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(report.reviews(_found(spark, sf_dir), 3), "seq", "rule_id", "target_id", "reason", "message")


@query(f"{findings_sql()} SELECT doc_id, rule_id, target_id, concat(sign, threshold) AS requirement, value, CASE WHEN passed THEN 'pass' WHEN NOT passed THEN 'fail' ELSE 'review' END AS result FROM f")
def check_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(report.check_table(_found(spark, sf_dir), default_rules()), "rule_id", "target_id", "requirement", "value", "result")


_WORST = "CASE WHEN NOT passed THEN 0 WHEN passed IS NULL THEN 1 ELSE 2 END"


@query(f"""{findings_sql()}, m AS (SELECT doc_id, target_type, target_id, min({_WORST}) AS worst, arg_min(rule_id, {_WORST} * 100 + rule_ord) AS rule_id, arg_min(message, {_WORST} * 100 + rule_ord) AS message FROM f GROUP BY ALL)
SELECT doc_id, target_type, target_id, rule_id, CASE worst WHEN 0 THEN 'red' WHEN 1 THEN 'orange' ELSE 'green' END AS colour, CASE WHEN length(message) > 60 THEN concat(left(message, 58), '…') ELSE message END AS label FROM m""")
def target_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(report.marks(_found(spark, sf_dir)), "target_type", "target_id", "rule_id", "colour", "label")


def _opinion_sql() -> str:
    """Of rules with a sentence that findings can fill; the others tell their message."""
    told = {k: v for k, v in OPINIONS.items() if "{target." not in v}
    filled = lambda v: f"replace(replace(replace('{v}', '{{tid}}', coalesce(target_id, 'None')), '{{value}}', coalesce(value, 'None')), '{{threshold}}', coalesce(threshold, 'None'))"
    return "CASE rule_id " + " ".join(f"WHEN '{k}' THEN {filled(v)}" for k, v in told.items()) + " ELSE message END"


_RANKED = f"""w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, rule_id) AS n_rule FROM f WHERE NOT passed),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n_rule DESC, rule_ord) AS INTEGER) AS seq, {_opinion_sql()} AS opinion FROM w)"""


@query(f"{findings_sql()}, {_RANKED} SELECT doc_id, seq, rule_id, target_id, opinion FROM r")
def fail_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(report.fails_by_rule(_found(spark, sf_dir)), "seq", "rule_id", "target_id", "opinion")


_NAMES = "CASE rule_id " + " ".join(f"WHEN '{r['rule_id']}' THEN '{r['name']}'" for r in STANDARD["rules"]) + " END"


@query(f"""{findings_sql()}, {_RANKED}, c AS (SELECT doc_id, count(*) AS total, count(*) FILTER (passed) AS pass, count(*) FILTER (NOT passed) AS fail, count(*) FILTER (passed IS NULL) AS review FROM f GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(concat(chr(10), '### ', rule_id, ' ', {_NAMES}, ' ×', n_rule, chr(10), '- ', opinion), chr(10) ORDER BY seq) AS fails FROM r GROUP BY doc_id)
SELECT c.doc_id, concat('# ', c.doc_id, chr(10), chr(10), '| total | pass | fail | review |', chr(10), '|-|-|-|-|', chr(10), '| ', total, ' | ', pass, ' | ', fail, ' | ', review, ' |', chr(10), coalesce(fails, '')) AS text FROM c LEFT JOIN l ON l.doc_id = c.doc_id""")
def drawing_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(report.markdown(_found(spark, sf_dir)), "text")


@query(f"""{findings_sql()}, g AS (SELECT doc_id % 10 AS doc_id, passed FROM f), c AS (SELECT doc_id, count(*) AS total, count(*) FILTER (passed) AS pass, count(*) FILTER (NOT passed) AS fail, count(*) FILTER (passed IS NULL) AS review FROM g GROUP BY doc_id),
a AS (SELECT sum(total) AS total, sum(pass) AS pass, sum(fail) AS fail, sum(review) AS review, count(*) AS n FROM c)
SELECT concat('# Batch review', chr(10), chr(10), 'Drawings: ', n, chr(10), chr(10), '| total | pass | fail | review |', chr(10), '|-|-|-|-|', chr(10), '| ', total, ' | ', pass, ' | ', fail, ' | ', review, ' |', chr(10), chr(10), '| drawing | total | pass | fail | review |', chr(10), '|-|-|-|-|-|', chr(10),
(SELECT string_agg(concat('| ', doc_id, ' | ', total, ' | ', pass, ' | ', fail, ' | ', review, ' |'), chr(10) ORDER BY CAST(doc_id AS VARCHAR)) FROM c)) AS text FROM a""")
def batch_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.batch_markdown(_found(spark, sf_dir, "doc_id", "passed", "review_required").withColumn("doc_id", (F.col("doc_id").cast("long") % 10).cast("string")))


_JSON = "concat('{\"rule_id\":', to_json(rule_id), ',\"target_id\":', coalesce(to_json(target_id), 'null'), ',\"passed\":', coalesce(CAST(passed AS VARCHAR), 'null'), ',\"review_required\":', CAST(passed IS NULL AS VARCHAR), ',\"value\":', coalesce(to_json(value), 'null'), ',\"threshold\":', coalesce(to_json(threshold), 'null'), ',\"severity\":', to_json(severity), ',\"message\":', to_json(message), '}')"


@query(f"""{findings_sql()} SELECT doc_id, concat('{{"summary":{{"total":', count(*), ',"pass":', count(*) FILTER (passed), ',"fail":', count(*) FILTER (NOT passed), ',"review":', count(*) FILTER (passed IS NULL), '}},"findings":[', string_agg({_JSON}, ',' ORDER BY rule_ord), ']}}') AS body FROM f GROUP BY doc_id""")
def findings_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(report.findings_documents(_found(spark, sf_dir)), "body")


def _rules_sql() -> str:
    return ", ".join(f"('{r['rule_id']}', '{r['name']}', '{r['category']}', {_literal(r['mandatory'])}, '{r['source'].replace(chr(39), chr(39) * 2)}')" for r in STANDARD["rules"])


@query(f"SELECT count(*) AS n, count(DISTINCT category) AS categories, count(*) FILTER (mandatory) AS mandatory FROM (VALUES {_rules_sql()}) r(rule_id, name, category, mandatory, source)")
def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.catalogue(report.rule_table(spark, default_rules()))


@query(f"SELECT rule_id, name FROM (VALUES {_rules_sql()}) r(rule_id, name, category, mandatory, source) WHERE category = '疏散宽度' AND contains(lower(concat(rule_id, ' ', name, ' ', source)), 'gb 50157')")
def rule_browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.browse(report.rule_table(spark, default_rules()), "疏散宽度", "GB 50157").select("rule_id", "name")


_WRITTEN = (
    ("AREA-PUB-001", "target.zone_type = public and target.is_shared_concourse ≠ True", "target.area_m2 ≤ 5000"), ("EXIT-NUM-PUB-001", "", "count(target.public_zone.exits) where item.leads_to = ground ≥ 2"), ("SHOP-AREA-TOTAL-PUB-001", "", "sum(target.public_zone.commercial_shops.area_m2) ≤ 100"),
    ("SHUTTER-WIDTH-GT30-001", "target.opening_width_m > 30", "target.shutter_width_m ≤ min(target.opening_width_m / 3, 20)"), ("VENT-HEIGHT-001", "target.kind = fresh_vs_exhaust_or_piston", "target.is_exhaust_higher = True"),
)


@query(f"SELECT * FROM (VALUES {', '.join(map(str, _WRITTEN))}) t(rule_id, applies, requirement)")
def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules written out, one of each form."""
    return report.rule_table(spark, default_rules()).where(F.col("rule_id").isin([w[0] for w in _WRITTEN])).select("rule_id", "applies", "requirement")
