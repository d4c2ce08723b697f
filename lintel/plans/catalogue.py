"""The query catalogue: each operator on the driver's tables, with the SQL that tells the same rows."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..functions import text as tx
from ..functions.base import lookup
from ..operators import detect, matching
from ..operators.scale import from_pages, upper_median
from ..operators.spatial import blocked_overlap_join, first_match_join, like_boxes_join, near_join, nearest_number_join, none_near, pair_join
from ..streaming.files import windowed_counts
from . import dataset, drawing_queries, quality_queries, registry, report, rule_queries  # noqa: F401  queries of their own
from .registry import query as _query
from .registry import table as _t
from .rules import Rule, findings_of, lint, parse_rules
from .rules.compiler import FINDING, typed_view



def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


def _c(c: Column | str) -> Column:
    return F.count(c).cast("long")


# rules


def _rule(rule_id: str, target: str, when: list[tuple], check: dict, message: str) -> dict:
    return {"rule_id": rule_id, "name": rule_id, "category": target, "target": target, "applies_when": [dict(zip(("path", "op", "value"), w, strict=True)) for w in when], "check": check, "mandatory": True, "severity": "critical", "source": "catalogue", "message": message}


RULES = [
    _rule("R1", "lineitem", [("target.l_returnflag", "eq", "R")], {"type": "compare", "path": "target.l_quantity", "op": "le", "threshold": 45}, "flag {target.l_returnflag} of {target.id}"),
    _rule("R2", "lineitem", [("target.l_discount", "ge", 0.05), ("target.l_linestatus", "in", ["O"])], {"type": "compare", "path": "target.l_extendedprice", "op": "le", "threshold_path": "target.l_quantity", "threshold_scale": 2000, "threshold_cap": 60000}, "price of {target.id}"),
    _rule("R3", "orders", [("target.o_orderpriority", "ne", "1-URGENT")], {"type": "compare", "path": "target.o_totalprice", "op": "le", "threshold": 300000}, "total of {target.id}"),
    _rule("R4", "part", [("target.p_size", "gt", 10)], {"type": "compare", "path": "target.p_retailprice", "op": "ge", "threshold": 1000}, "{target.p_brand} {nothing}"),
    _rule("R5", "supplier", [], {"type": "compare", "path": "target.s_acctbal", "op": "ge", "threshold": 0}, "balance of {target.id}"),
    _rule("R6", "orders", [("target.o_orderstatus", "not_in", ["F", "O"])], {"type": "compare", "path": "target.o_orderstatus", "op": "eq", "threshold": "P"}, "{target.o_orderstatus}"),
    _rule("R7", "lineitem", [("target.l_missing", "ne", 1)], {"type": "compare", "path": "target.l_quantity", "op": "ge", "threshold": 0}, "never"),
]


def _targets(rows: DataFrame, doc: str) -> tuple[DataFrame, T.StructType]:
    """rows as targets of rules: doc_id, target_ord, target and an empty station."""
    return rows.select(F.col(doc).cast("string").alias("doc_id"), F.lit(0).alias("target_ord"), F.struct("*").alias("target")), rows.schema


def _findings(rows: DataFrame, doc: str, rules: list[Rule], fields: Sequence[str] = FINDING) -> DataFrame:
    targets, schema = _targets(rows, doc)
    nothing = typed_view(F.lit(None), T.StructType([]))
    return findings_of(targets, list(enumerate(rules)), typed_view(F.col("target"), schema), nothing, fields)


def _catalogue_findings(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    ids = {"lineitem": ("l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber")), "orders": ("o_orderkey", F.col("o_orderkey").cast("string")), "part": ("p_partkey", F.col("p_partkey").cast("string")), "supplier": ("s_suppkey", F.col("s_suppkey").cast("string"))}
    rules, out = parse_rules({"rules": RULES}), None
    for table, (doc, key) in ids.items():
        found = _findings(_t(spark, sf_dir, table).withColumn("id", key), doc, [r for r in rules if r.target == table], fields)
        out = found if out is None else out.unionByName(found)
    return out


_FINDINGS_SQL = """
SELECT 'R1' AS rule_id, concat(l_orderkey, '-', l_linenumber) AS target_id, l_quantity <= 45 AS passed, l_quantity AS value_num, CAST(45 AS DOUBLE) AS threshold_num, concat('flag ', l_returnflag, ' of ', l_orderkey, '-', l_linenumber) AS message FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'R2', concat(l_orderkey, '-', l_linenumber), l_extendedprice <= round(least(l_quantity * 2000, 60000), 3), l_extendedprice, round(least(l_quantity * 2000, 60000), 3), concat('price of ', l_orderkey, '-', l_linenumber) FROM lineitem WHERE l_discount >= 0.05 AND l_linestatus = 'O'
UNION ALL SELECT 'R3', CAST(o_orderkey AS VARCHAR), o_totalprice <= 300000, o_totalprice, 300000, concat('total of ', o_orderkey) FROM orders WHERE o_orderpriority IS DISTINCT FROM '1-URGENT'
UNION ALL SELECT 'R4', CAST(p_partkey AS VARCHAR), p_retailprice >= 1000, p_retailprice, 1000, concat(p_brand, ' {nothing}') FROM part WHERE p_size > 10
UNION ALL SELECT 'R5', CAST(s_suppkey AS VARCHAR), s_acctbal >= 0, s_acctbal, 0, concat('balance of ', s_suppkey) FROM supplier
UNION ALL SELECT 'R6', CAST(o_orderkey AS VARCHAR), o_orderstatus = 'P', NULL, NULL, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
"""


@_query(_FINDINGS_SQL)
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogue_findings(spark, sf_dir, "rule_id", "target_id", "passed", "value_num", "threshold_num", "message")


@_query(f"SELECT rule_id, count(*) AS total, count(*) FILTER (passed) AS pass, count(*) FILTER (NOT passed) AS fail, count(*) FILTER (passed IS NULL) AS review FROM ({_FINDINGS_SQL}) GROUP BY rule_id")
def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_catalogue_findings(spark, sf_dir, "rule_id", "passed", "review_required"), "rule_id")


@_query("SELECT l_orderkey, l_linenumber, round(least(l_extendedprice / 3, 20000), 3) AS threshold, l_quantity * 1000 <= round(least(l_extendedprice / 3, 20000), 3) AS passed FROM lineitem")
def rule_dynamic_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").withColumn("load", F.col("l_quantity") * 1000)
    rule = _rule("D", "lineitem", [], {"type": "compare", "path": "target.load", "op": "le", "threshold_path": "target.l_extendedprice", "threshold_divisor": 3, "threshold_cap": 20000}, "")
    keyed = rows.withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    found = _findings(keyed, "l_orderkey", parse_rules({"rules": [rule]}), ("doc_id", "target_id", "threshold_num", "passed"))
    return found.select(F.col("doc_id").cast("long").alias("l_orderkey"), F.substring_index("target_id", "-", -1).cast("int").alias("l_linenumber"), F.col("threshold_num").alias("threshold"), "passed")


def _orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity")).alias("lines"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("id")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@_query("SELECT o_orderkey, CASE WHEN count(l_orderkey) > 0 THEN CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) END AS returned, CASE WHEN count(l_orderkey) > 0 THEN count(*) FILTER (l_returnflag = 'R') >= 1 END AS passed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def rule_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = _rule("C", "orders", [], {"type": "count", "collection_path": "target.lines", "op": "ge", "threshold": 1, "filter": [{"path": "item.l_returnflag", "op": "eq", "value": "R"}]}, "")
    found = _findings(_orders_with_lines(spark, sf_dir), "o_orderkey", parse_rules({"rules": [rule]}), ("doc_id", "value_num", "passed"))
    return found.select(F.col("doc_id").cast("long").alias("o_orderkey"), F.col("value_num").alias("returned"), "passed")


@_query("SELECT o_orderkey, round(coalesce(sum(l_quantity), 0), 2) AS quantity, coalesce(sum(l_quantity), 0) <= 100 AS passed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def rule_sum_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = _rule("S", "orders", [], {"type": "sum_aggregate", "collection_path": "target.lines", "field": "l_quantity", "op": "le", "threshold": 100}, "")
    orders = _orders_with_lines(spark, sf_dir)
    full = orders.withColumn("lines", F.coalesce("lines", F.array().cast(orders.schema["lines"].dataType)))
    found = _findings(full, "o_orderkey", parse_rules({"rules": [rule]}), ("doc_id", "value_num", "passed"))
    return found.select(F.col("doc_id").cast("long").alias("o_orderkey"), F.col("value_num").alias("quantity"), "passed")


@_query("SELECT d.doc_id, CASE WHEN quality IS NOT NULL THEN quality >= 1 END AS passed, quality IS NULL AS review_required, CASE WHEN quality IS NULL THEN '缺少字段 target.quality' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def rule_review_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id")).join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    rule = _rule("Q", "documents", [], {"type": "compare", "path": "target.quality", "op": "ge", "threshold": 1}, "")
    return _findings(docs, "doc_id", parse_rules({"rules": [rule]})).select(F.col("doc_id").cast("long").alias("doc_id"), "passed", "review_required", "reason")


@_query("SELECT d.doc_id, quality IS DISTINCT FROM 1 AS applies_ne FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS DISTINCT FROM 1")
def rule_ne_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id")).join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    rule = _rule("N", "documents", [("target.quality", "ne", 1)], {"type": "compare", "path": "target.id", "op": "ne", "threshold": ""}, "")
    return _findings(docs, "doc_id", parse_rules({"rules": [rule]})).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("passed").alias("applies_ne"))


@_query("SELECT n_nationkey, n_name, n_regionkey IN (1, 2) AS passed FROM nation WHERE n_name NOT IN ('FRANCE', 'GERMANY')")
def rule_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _t(spark, sf_dir, "nation").withColumn("id", F.col("n_name"))
    rule = _rule("I", "nation", [("target.n_name", "not_in", ["FRANCE", "GERMANY"])], {"type": "compare", "path": "target.n_regionkey", "op": "in", "threshold": [1, 2]}, "")
    return _findings(nation, "n_nationkey", parse_rules({"rules": [rule]})).select(F.col("doc_id").cast("int").alias("n_nationkey"), F.col("target_id").alias("n_name"), "passed")


@_query("SELECT * FROM (VALUES (1, 'A', 'repeated id'), (2, 'B', 'unknown operator near'), (3, 'C', 'missing key message'), (3, 'C', 'check without type or operator')) t(rule_ord, rule_id, problem)")
def rule_lint_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = {"type": "compare", "path": "target.x", "op": "le", "threshold": 1}
    rules = [_rule("A", "x", [], fine, ""), _rule("A", "x", [], fine, ""), _rule("B", "x", [("target.x", "near", 1)], fine, ""), _rule("C", "x", [], {"path": "target.x", "op": "le"}, "")]
    del rules[3]["message"]
    return lint(spark.createDataFrame([(json.dumps({"rules": rules}),)], "body string"))


# joins


@_query("""SELECT a.s_nationkey, a.s_suppkey AS key_a, b.s_suppkey AS key_b, round(abs(a.s_acctbal - b.s_acctbal), 2) AS apart,
CASE WHEN (a.s_acctbal < 0) = (b.s_acctbal < 0) THEN 'same' WHEN abs(a.s_acctbal - b.s_acctbal) <= 5000 THEN 'adjacent' ELSE 'other' END AS relation
FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def pair_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pair_join(_t(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], "s_suppkey")
    a, b = F.col("a"), F.col("b")
    apart = F.abs(a["s_acctbal"] - b["s_acctbal"])
    relation = F.when((a["s_acctbal"] < 0) == (b["s_acctbal"] < 0), "same").when(apart <= 5000, "adjacent").otherwise("other")
    return pairs.select("s_nationkey", a["s_suppkey"].alias("key_a"), b["s_suppkey"].alias("key_b"), F.round(apart, 2).alias("apart"), relation.alias("relation"))


_NEAREST = """SELECT c_custkey, s_suppkey, round(abs(c_acctbal - s_acctbal), 2) AS apart FROM (
SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS n FROM customer JOIN supplier ON s_nationkey = c_nationkey) WHERE n = 1"""


def _nearest(spark: SparkSession, sf_dir: str, within: float | None = None) -> DataFrame:
    customers = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    suppliers = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    if within is None:
        near = nearest_number_join(customers, suppliers, ["nation"], "c_acctbal", "s_acctbal", ["s_suppkey"])
    else:
        near = near_join(customers, suppliers, ["nation"], ["c_custkey"], F.array(g.point(F.col("c_acctbal"), F.lit(0.0))), g.point(F.col("s_acctbal"), F.lit(0.0)), ["s_suppkey"], within)
    return near.select("c_custkey", F.col("nearest.s_suppkey").alias("s_suppkey"), F.round("distance", 2).alias("apart"))


@_query(_NEAREST)
def nearest_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, None)


@_query(f"{_NEAREST} AND abs(c_acctbal - s_acctbal) <= 60")
def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 60)


_BANDS = [(0, "low", 0.0, 1000.0), (1, "middle", 900.0, 1500.0), (2, "high", 1400.0, 1800.0)]
_BANDS_SQL = ", ".join(str(b) for b in _BANDS)


@_query(f"SELECT p_partkey, arg_min(band, ord) FILTER (p_retailprice >= lo AND p_retailprice < hi) AS band FROM part, (VALUES {_BANDS_SQL}) b(ord, band, lo, hi) GROUP BY p_partkey")
def first_price_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame(_BANDS, "ord int, band string, lo double, hi double").withColumn("all", F.lit(0))
    parts = _t(spark, sf_dir, "part").select(F.lit(0).alias("all"), "p_partkey", "p_retailprice")
    price = F.col("p_retailprice")
    found = first_match_join(parts, F.broadcast(bands), ["all"], ["p_partkey"], (price >= F.col("lo")) & (price < F.col("hi")), ["ord"])
    return found.select("p_partkey", F.col("found.band").alias("band"))


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and the embedding as a ring of points of its neighbouring coordinates."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size("e") / 2).cast("int") - 1), lambda i: g.point(F.get("e", 2 * i), F.get("e", 2 * i + 1)))
    return _t(spark, sf_dir, "embeddings").withColumn("e", e).select("vec_id", "label", points.alias("points"))


_P = "SELECT vec_id, label, list_transform(range(0, len(embedding) // 2), lambda i: {'x': CAST(embedding[2 * i + 1] AS DOUBLE), 'y': CAST(embedding[2 * i + 2] AS DOUBLE)}) AS p FROM embeddings"


@_query(f"""WITH v AS ({_P}), e AS (SELECT vec_id, label, p[i + 1] AS a, p[(i + 1) % len(p) + 1] AS b FROM (SELECT *, unnest(range(0, len(p))) AS i FROM v))
SELECT o.vec_id AS vec_a, q.vec_id AS vec_b FROM v q JOIN e o ON o.label = q.label AND o.vec_id <> q.vec_id AND o.vec_id % 5 = 0
WHERE (o.a.y > q.p[1].y) <> (o.b.y > q.p[1].y) AND q.p[1].x < (o.b.x - o.a.x) * (q.p[1].y - o.a.y) / (o.b.y - o.a.y + 1e-9) + o.a.x
GROUP BY ALL HAVING count(*) % 2 = 1""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = _polygons(spark, sf_dir).select("label", F.col("vec_id").alias("vec_a"), F.col("points").alias("ring"))
    points = _polygons(spark, sf_dir).select("label", F.col("vec_id").alias("vec_b"), F.get("points", F.lit(0)).alias("at"))
    return rings.join(points, "label").where(F.col("vec_a") != F.col("vec_b")).where(g.contains(F.col("ring"), F.col("at.x"), F.col("at.y"))).select("vec_a", "vec_b")


@_query("SELECT s_suppkey, s_nationkey FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_suppkey <> a.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 800)")
def anti_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    return none_near(one, one.toDF("nation", "other_key", "other_balance"), ["nation"], ["s_suppkey"], F.array(g.point(F.col("s_acctbal"), F.lit(0.0))), g.point(F.col("other_balance"), F.lit(0.0)), 800, other="other_key").select("s_suppkey", F.col("nation").alias("s_nationkey"))


@_query("""SELECT path, match, CAST(score AS INTEGER) AS score FROM (SELECT n_name AS path, r_name AS match, score, row_number() OVER (PARTITION BY n_name ORDER BY score DESC, r_name) AS n FROM (
SELECT n_name, r_name, CASE WHEN contains(lower(n_name), lower(r_name)) OR contains(lower(r_name), lower(n_name)) THEN 1000 + length(r_name)
ELSE len(list_filter(string_split(lower(r_name), ''), lambda c: c <> '' AND contains(lower(n_name), c))) END AS score FROM nation, region) WHERE score >= 1) WHERE n = 1""")
def fuzzy_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.best_by_name(_t(spark, sf_dir, "nation").select(F.col("n_name").alias("path")), _t(spark, sf_dir, "region").select(F.col("r_name").alias("path"))).select("path", "match", F.col("score").cast("int").alias("score"))


_ACTIONS = {"click": "touch", "view": "look", "purchase": "buy"}


@_query("SELECT event_id, CASE event_type WHEN 'click' THEN 'touch' WHEN 'view' THEN 'look' WHEN 'purchase' THEN 'buy' ELSE 'other' END AS action FROM events")
def lookup_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.coalesce(lookup(_ACTIONS, F.col("event_type")), F.lit("other")).alias("action"))


# geometry


@_query(f"SELECT vec_id, round(abs(list_sum(list_transform(range(0, len(p)), lambda i: p[i + 1].x * p[(i + 1) % len(p) + 1].y - p[(i + 1) % len(p) + 1].x * p[i + 1].y))) / 2 * 0.25, 6) AS area FROM ({_P})")
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polygons(spark, sf_dir).select("vec_id", F.round(g.area(F.col("points"), 0.5), 6).alias("area"))


@_query(f"SELECT vec_id, round(list_sum(list_transform(range(0, len(p) - 1), lambda i: sqrt((p[i + 2].x - p[i + 1].x) ** 2 + (p[i + 2].y - p[i + 1].y) ** 2))) * 0.5, 6) AS length FROM ({_P})")
def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polygons(spark, sf_dir).select("vec_id", F.round(g.length(F.col("points"), 0.5), 6).alias("length"))


@_query(f"SELECT vec_id, round(list_sum(list_transform(p, lambda q: q.x)) / len(p), 6) AS x, round(list_sum(list_transform(p, lambda q: q.y)) / len(p), 6) AS y FROM ({_P})")
def vertex_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = g.mean_point(F.col("points"))
    return _polygons(spark, sf_dir).select("vec_id", F.round(m["x"], 6).alias("x"), F.round(m["y"], 6).alias("y"))


_BOX = f"SELECT vec_id, label, list_min(list_transform(p, lambda q: q.x)) AS x0, list_min(list_transform(p, lambda q: q.y)) AS y0, list_max(list_transform(p, lambda q: q.x)) AS x1, list_max(list_transform(p, lambda q: q.y)) AS y1 FROM ({_P})"


@_query(f"SELECT vec_id, round((x1 - x0) * (y1 - y0), 6) AS area FROM ({_BOX})")
def box_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = g.bounds(F.col("points"))
    return _polygons(spark, sf_dir).select("vec_id", F.round(g.area(g.box_ring(b["x0"], b["y0"], b["x1"], b["y1"])), 6).alias("area"))


@_query(f"SELECT vec_id, CASE WHEN abs(p[1].x * 100) < 1 AND abs(p[1].y * 100) < 1 THEN 'center' ELSE CAST(CAST(floor(degrees(atan2(p[1].y * 100, p[1].x * 100)) / 15) AS BIGINT) AS VARCHAR) END AS direction FROM ({_P})")
def direction_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.get("points", F.lit(0))
    return _polygons(spark, sf_dir).select("vec_id", g.direction_group(at["x"] * 100, at["y"] * 100, F.lit(0.0), F.lit(0.0)).alias("direction"))


@_query(f"""WITH b AS (SELECT * FROM ({_BOX})), p AS (SELECT a.vec_id AS vec_a, b.vec_id AS vec_b,
greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s
FROM b a JOIN b b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT vec_a, vec_b, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) > 0.85""")
def box_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _polygons(spark, sf_dir).select("label", "vec_id", g.bounds(F.col("points")).alias("box"))
    pairs = like_boxes_join(boxes, ["label"], "vec_id", 0.85)
    return pairs.select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"), F.round("iou", 6).alias("iou"))


_GRID = "SELECT p_partkey, p_size * 97 AS w, p_size * 61 AS h FROM part"


@_query(f"""WITH s AS ({_GRID}), x AS (SELECT p_partkey, w, h, unnest(list_distinct(list_transform(range(0, CAST(greatest(0, ceil((w - 1024) / 824)) AS BIGINT) + 1), lambda i: least(i * 824, greatest(0, w - 1024))))) AS tx FROM s),
y AS (SELECT *, unnest(list_distinct(list_transform(range(0, CAST(greatest(0, ceil((h - 1024) / 824)) AS BIGINT) + 1), lambda i: least(i * 824, greatest(0, h - 1024))))) AS ty FROM x)
SELECT p_partkey, CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, CAST(least(1024, w - tx) AS BIGINT) AS tw, CAST(least(1024, h - ty) AS BIGINT) AS th FROM y""")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 97).alias("width"), (F.col("p_size") * 61).alias("height"))
    return detect.tile_grid(images, 1024, 200, ["p_partkey"]).select("p_partkey", *(F.col(c).cast("long").alias(c) for c in ("tx", "ty", "tw", "th")))


@_query(f"""WITH c AS (SELECT vec_id, list_transform(p, lambda q: {{'x': greatest(-4.0, least(q.x * 400, 2.0)) + 4.0, 'y': greatest(-4.0, least(q.y * 400, 2.0)) + 4.0}}) AS p FROM ({_P})),
s AS (SELECT *, list_transform(p, lambda q: q.x) AS xs, list_transform(p, lambda q: q.y) AS ys FROM c)
SELECT vec_id, CASE WHEN list_max(xs) - list_min(xs) >= 3 AND list_max(ys) - list_min(ys) >= 3 THEN round(abs(list_sum(list_transform(range(0, len(p)), lambda i: p[i + 1].x * p[(i + 1) % len(p) + 1].y - p[(i + 1) % len(p) + 1].x * p[i + 1].y))) / 2, 6) END AS area FROM s""")
def tile_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = F.transform("points", lambda p: g.point(p["x"] * 400, p["y"] * 400))
    piece = g.clamp_to(grown, *(F.lit(v) for v in (-4.0, -4.0, 2.0, 2.0)))
    return _polygons(spark, sf_dir).select("vec_id", F.round(g.area(piece), 6).alias("area"))


@_query("SELECT vec_id, printf('%d %.6f %.6f', label, greatest(0, least(1, CAST(embedding[1] AS DOUBLE) + 0.5)), greatest(0, least(1, CAST(embedding[2] AS DOUBLE) + 0.5))) AS line FROM embeddings")
def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.transform(F.slice("points", 1, 1), lambda p: g.point(p["x"] + 0.5, p["y"] + 0.5))
    return _polygons(spark, sf_dir).select("vec_id", g.label_line(F.col("label"), first, F.lit(1.0), F.lit(1.0)).alias("line"))


@_query(f"""WITH RECURSIVE b AS (SELECT vec_id, label, x0, y0, x1, y1, row_number() OVER (PARTITION BY label ORDER BY (x1 - x0) * (y1 - y0) DESC, vec_id) AS n FROM ({_BOX})),
k(label, n, kept) AS (SELECT DISTINCT label, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM b UNION ALL
SELECT k.label, k.n + 1, CASE WHEN EXISTS (SELECT 1 FROM b o WHERE o.label = c.label AND list_contains(k.kept, o.n) AND
greatest(0, least(o.x1, c.x1) - greatest(o.x0, c.x0)) * greatest(0, least(o.y1, c.y1) - greatest(o.y0, c.y0)) > 0.7 * ((o.x1 - o.x0) * (o.y1 - o.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) - greatest(0, least(o.x1, c.x1) - greatest(o.x0, c.x0)) * greatest(0, least(o.y1, c.y1) - greatest(o.y0, c.y0))))
THEN k.kept ELSE list_append(k.kept, c.n) END FROM k JOIN b c ON c.label = k.label AND c.n = k.n + 1)
SELECT b.vec_id, b.label FROM b JOIN (SELECT label, arg_max(kept, n) AS kept FROM k GROUP BY label) f ON f.label = b.label AND list_contains(f.kept, b.n)""")
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = g.bounds(F.col("points"))
    boxes = _polygons(spark, sf_dir).select("vec_id", "label", *(b[c].alias(c) for c in ("x0", "y0", "x1", "y1"))).withColumn("conf", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return detect.nms(boxes, 0.7, ["label"], "vec_id").select("vec_id", "label")


_SMALL = "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 2000 AS x, CAST(embedding[2] AS DOUBLE) * 2000 AS y FROM embeddings"


@_query(f"""WITH RECURSIVE v AS ({_SMALL}), e AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND abs(a.x - b.x) < 30 AND abs(a.y - b.y) < 30),
r(label, a, b) AS (SELECT label, vec_id, vec_id FROM v UNION SELECT r.label, r.a, e.b FROM r JOIN e ON e.label = r.label AND e.a = r.b)
SELECT label, cluster, count(*) AS n FROM (SELECT label, a, min(b) AS cluster FROM r GROUP BY label, a) GROUP BY label, cluster""")
def box_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.get("points", F.lit(0))
    x, y = at["x"] * 2000, at["y"] * 2000
    boxes = _polygons(spark, sf_dir).select("label", "vec_id", x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 20).alias("y1"))
    found = detect.clusters(boxes, ["label"], "vec_id", gap=10, members=1, width=(0, 1e9), height=(0, 1e9))
    return found.select("label", "cluster", F.col("n").cast("long").alias("n"))


@_query(f"WITH v AS ({_SMALL}) SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND abs(a.x - b.x) < 30 AND abs(a.y - b.y) < 30")
def blocked_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.get("points", F.lit(0))
    x, y = at["x"] * 2000, at["y"] * 2000
    boxes = _polygons(spark, sf_dir).select("label", "vec_id", x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 20).alias("y1"))
    return blocked_overlap_join(boxes, ["label"], "vec_id", 10).select("a", "b")


@_query("""WITH r AS (SELECT doc_id, CAST(unnest(list_transform(range(0, 3), lambda i: 20 * (1 + (doc_id * (i + 3)) % 4) )) AS INTEGER) AS n FROM documents),
c AS (SELECT doc_id, n, count(*) AS t FROM r GROUP BY doc_id, n), m AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY t DESC, n) AS k FROM c)
SELECT doc_id, n AS ratio, round(n / 72.0 * 0.0254 * 842.0 / 3508.0, 9) AS scale, CAST(300 AS INTEGER) AS dpi FROM m WHERE k = 1""")
def scale_from_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = lambda i: F.concat(F.lit("比例 1 : "), (20 * (1 + (F.col("doc_id") * (i + 3)) % 4)).cast("string"))
    pages = _t(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page_no"), F.lit(842.0).alias("width_pt"), F.lit(3508.0).alias("width_px"), F.concat_ws(" ", *(ratio(i) for i in range(3))).alias("text"))
    return from_pages(pages).select("doc_id", "ratio", F.round("scale", 9).alias("scale"), "dpi")


# aggregates and windows


@_query("SELECT user_id, list_sort(list(value))[len(list(value)) // 2 + 1] AS middle FROM events GROUP BY user_id")
def upper_median_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(upper_median(F.col("value")).alias("middle"))


@_query("SELECT n_name, count(*) AS total, count(*) FILTER (c_acctbal >= 0) AS pass, count(*) FILTER (c_acctbal < 0) AS fail, count(*) FILTER (c_acctbal IS NULL) AS review, grouping(n_name) = 1 AS is_total FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_name)")
def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = _t(spark, sf_dir, "customer").join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", (F.col("c_acctbal") >= 0).alias("passed"), F.col("c_acctbal").isNull().alias("review_required"))
    return report.batch(findings, "n_name")


@_query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.top_rows(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@_query("""WITH f AS (SELECT o_orderpriority AS rule_id, CAST(o_orderkey AS VARCHAR) AS target_id, o_orderstatus AS doc_id, o_orderkey AS target_ord, CAST(left(o_orderpriority, 1) AS INTEGER) AS rule_ord FROM orders WHERE o_totalprice > 250000),
w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, rule_id) AS n_rule, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY target_ord) AS place FROM f)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n_rule DESC, rule_ord, place) AS INTEGER) AS seq, rule_id, n_rule, target_id FROM w WHERE place <= 10""")
def rule_sorted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    fails = _t(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_orderpriority").alias("rule_id"), F.col("o_orderkey").cast("string").alias("target_id"), F.col("o_orderstatus").alias("doc_id"), F.col("o_orderkey").alias("target_ord"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rule_ord"), F.lit(False).alias("passed"), none.alias("name"), none.alias("value"), none.alias("threshold"), none.alias("message"), none.alias("source"))
    return report.fails_by_rule(fails).select("doc_id", "seq", "rule_id", "n_rule", "target_id")


@_query("SELECT CASE WHEN count(*) FILTER (value > 100) > 0 THEN 'fail' WHEN count(*) FILTER (value IS NULL) > 0 THEN 'review' ELSE 'pass' END AS verdict, user_id FROM events GROUP BY user_id")
def three_way_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = _t(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("value") <= 100).alias("passed"), F.col("value").isNull().alias("review_required"))
    return report.outcome(findings).select("verdict", F.col("doc_id").alias("user_id"))


# text


@_query("SELECT page_id, CAST(nullif(regexp_extract(replace(url, ',', ''), '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS first, CAST(len(regexp_extract_all(url, '[0-9]+(?:\\.[0-9]+)?')) AS BIGINT) AS n FROM pages")
def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", tx.first_number(F.col("url")).alias("first"), F.size(tx.numbers(F.col("url"))).cast("long").alias("n"))


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 200 THEN l_quantity / 1000 ELSE l_quantity END AS plain, l_quantity * 10 / 1000 AS mm FROM lineitem")
def unit_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int").cast("string")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.length_metres(q).alias("plain"), tx.length_metres(F.concat(q, F.lit("0mm"))).alias("mm"))


_KIND = "CASE WHEN n_nationkey % 4 = 0 THEN '明海站总平面图' WHEN n_nationkey % 4 = 1 THEN '石龙 站厅层平面示意图' WHEN n_nationkey % 4 = 2 THEN n_name || '建筑平剖面图' ELSE n_name END"


@_query(f"SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN '明海站-总平面图' WHEN n_nationkey % 4 = 1 THEN '石龙站-站厅层' WHEN n_nationkey % 4 = 2 THEN '平剖面图' ELSE regexp_replace(n_name, ' +', '-', 'g') END AS stem, {_KIND} AS name FROM nation")
def kind_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey") % 4
    name = F.when(n == 0, "明海站总平面图").when(n == 1, "石龙 站厅层平面示意图").when(n == 2, F.concat("n_name", F.lit("建筑平剖面图"))).otherwise(F.col("n_name"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", tx.product_stem(F.concat(F.lit("/in/"), name, F.lit(".jpg"))).alias("stem"), name.alias("name"))


_SAID = "CASE CAST(c_custkey % 6 AS INTEGER) WHEN 0 THEN '' WHEN 1 THEN '1234.5' WHEN 2 THEN '新风亭' WHEN 3 THEN '配电室' WHEN 4 THEN '标高' ELSE 'EXIT A' END"


@_query(f"""SELECT c_custkey, CASE CAST(c_custkey % 6 AS INTEGER) WHEN 0 THEN 'val_text' WHEN 1 THEN 'val_text' WHEN 2 THEN 'vent_meta' WHEN 3 THEN 'room_title' WHEN 4 THEN 'room_title' ELSE 'val_text' END AS label,
CAST(CASE CAST(c_custkey % 6 AS INTEGER) WHEN 0 THEN 0.3 WHEN 1 THEN 0.75 WHEN 2 THEN 0.8 WHEN 3 THEN 0.8 ELSE 0.5 END AS DOUBLE) AS conf, {_SAID} AS said FROM customer""")
def classify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("c_custkey") % 6).cast("int")
    said = F.element_at(F.array(*map(F.lit, ("", "1234.5", "新风亭", "配电室", "标高", "EXIT A"))), k + 1)
    told = tx.classify_text(said, F.lit("hall"))
    return _t(spark, sf_dir, "customer").select("c_custkey", told["label"].alias("label"), told["conf"].alias("conf"), said.alias("said"))


@_query("""SELECT page_id, CASE WHEN length(c) > 30 THEN rtrim(left(c, 30), '-_') ELSE c END AS name FROM (SELECT page_id, regexp_replace(trim(regexp_replace(url, '[\\\\/:*?"<>|\\s]+', '-', 'g'), '-_ '), '-{2,}', '-', 'g') AS c FROM pages)""")
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", tx.safe_name(F.col("url"), 30).alias("name"))


@_query("SELECT page_id, concat('page ', page_id) AS stem FROM pages")
def strip_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/data/page   "), F.col("page_id").cast("string"), F.lit("000000000.jpeg-"), (F.col("page_id") % 7).cast("string"), F.lit(".jpg"))
    return _t(spark, sf_dir, "pages").select("page_id", tx.normal_stem(path).alias("stem"))


@_query("SELECT page_id, regexp_replace(split_part(url, '/', -1), '(.)\\.[^.]*$', '\\1') AS stem FROM pages")
def basename_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", tx.stem(F.col("url")).alias("stem"))


@_query("SELECT o_orderkey, concat(o_orderkey, '+', o_custkey, '+', o_orderstatus) AS ids FROM orders")
def split_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit("，"), F.col("o_custkey").cast("string"), F.lit("; ；"), "o_orderstatus", F.lit(","))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(tx.split_ids(joined), "+").alias("ids"))


@_query("SELECT o_orderkey, CAST(o_orderkey % 150 AS DOUBLE) AS v, o_orderkey % 150 > 0 AND o_orderkey % 150 <= 100 AS fits FROM orders")
def sanitize_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tx.sanitized_number(F.concat(F.lit("L="), (F.col("o_orderkey") % 150).cast("string"), F.lit(" m")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"), ((v > 0) & (v <= 100)).alias("fits"))


@_query("SELECT p_partkey, '一' AS seq, round(p_retailprice, 2) AS area_m2, CASE WHEN p_size % 2 = 0 THEN 'public' ELSE 'equipment' END AS zone_type FROM part WHERE round(p_retailprice, 2) >= 50")
def section_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.when(F.col("p_size") % 2 == 0, "公共区").otherwise("有人值守区")
    said = F.concat(F.lit("说明 防火分区一："), F.format_string("%.2f", "p_retailprice"), F.lit("㎡"), zone)
    found = _t(spark, sf_dir, "part").select("p_partkey", F.explode(tx.sections(said)).alias("s"))
    return found.select("p_partkey", "s.seq", "s.area_m2", "s.zone_type")


@_query("SELECT doc_id, CASE WHEN length(text) > 60 THEN concat(left(text, 58), '…') ELSE text END AS short FROM documents")
def shortened_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", tx.shortened(F.col("text")).alias("short"))


# data sets and quality


@_query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('7-', doc_id)), doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN i < greatest(1, floor(n * 0.1)) THEN 'test' WHEN i < 2 * greatest(1, floor(n * 0.1)) THEN 'val' ELSE 'train' END AS split FROM r""")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.split(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", "7").select("doc_id", "split")


@_query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: hourly windows of the event stream, by the same code on a table."""
    counted = windowed_counts(_t(spark, sf_dir, "events"))
    return counted.select("event_type", "start", "n", F.round("total", 4).alias("total"))
