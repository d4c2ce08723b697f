"""Queries of the annotation checks, and of the steps on detections, texts, numbers and names.

For the checks, each customer has a drawing of one kind: a clean one, or a clean one with one fault. What a kind is found
to have stands in a table of its own, worked out by hand.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..operators import detect, scale
from ..operators.groups import first_rows, frequencies, mode_low, numbered, text_in_order
from ..sources import annotations, sinks
from ..sources.stages import scratch, staged
from ..vocab import CLASSES, LABELS
from . import dataset, documents, qc, report
from .registry import query, table

Shape = tuple[str, str, str, dict[str, str]]
CLEAN: dict[str, Shape] = {
    "a": ("polygon", "fire_compartment", "100,100;1100,100;1100,900;100,900", {"zone_type": "公共区"}),
    "b": ("polygon", "fire_compartment", "1100,100;1900,100;1900,900;1100,900", {"zone_type": "无人区"}),
    "exit": ("box", "safety_exit", "190,190;210,210", {"pair_id": "01，02"}),
    "gate": ("box", "gate", "300,480;320,520", {}),
    "width": ("polyline", "width_dimension_line", "300,500;330,500", {}),
    "evac": ("polyline", "evac_distance_line", "200,200;200,500;500,500", {"pair_id": "01", "text_content": "48.6"}),
}
_TITLE, _AREA = {"text_content": "x"}, "200,200;300,200;300,300"
_SHOPS = [("polygon", "commercial_shop", f"{x},600;{x + 40},600;{x + 40},640", {}) for x in range(200, 800, 100)]
_ROOMS = [("box", "room_title", f"{x},700;{x + 9},709", _TITLE) for x in range(200, 800, 100)]
#: A kind of drawing: what goes, what comes, and what is found: (level, code, how often).
KINDS: list[tuple[tuple[str, ...], list[Shape], list[tuple[str, str, int]]]] = [
    ((), [], []),
    ((), [("polygon", "unknown_thing", _AREA, {})], [("WARN", "BAD_LABEL", 1)]),
    ((), [("polygon", "防火分区", _AREA, {})], [("ERROR", "BAD_LABEL", 1)]),
    ((), [("polygon", "public_area", "", {})], [("ERROR", "EMPTY_GEOM", 1)]),
    ((), [("polygon", "public_area", "-50,1;20,2;30,30", {})], [("WARN", "OUT_OF_BOUNDS", 1)]),
    ((), [("polygon", "public_area", "1,1;20,20", {})], [("ERROR", "BAD_POLYGON", 1)]),
    ((), [("box", "draft_curtain", "5,5;5.2,50", {})], [("ERROR", "DEGENERATE_BOX", 1)]),
    ((), [("polygon", "public_area", _AREA, {"备注": "x"})], [("WARN", "JUNK_ATTR", 1)]),
    ((), [("polygon", "public_area", _AREA, {"note": "y"})], [("INFO", "EXTRA_ATTR", 1)]),
    ((), [("polygon", "fire_compartment", _AREA, {"zone_type": "公共"})], [("WARN", "BAD_ENUM", 1)]),
    ((), [("box", "room_title", "500,500;510,510", {})], [("INFO", "ATTR_ALL_BLANK", 1)]),
    ((), [("box", "room_title", "500,500;510,510", {}), ("box", "room_title", "600,500;610,510", _TITLE)], [("WARN", "ATTR_PARTIAL", 1)]),
    ((), [("box", "val_text", "2295,895;2305,905", _TITLE)], [("INFO", "VAL_TEXT_NEAR_ORPHAN", 1)]),
    ((), [("box", "val_text", "2495,895;2505,905", _TITLE)], [("WARN", "VAL_TEXT_ORPHAN", 1)]),
    ((), [("box", "room_title", "2295,895;2305,905", _TITLE)], [("INFO", "ROOM_TITLE_NEAR_ORPHAN", 1)]),
    ((), [("box", "room_title", "2495,895;2505,905", _TITLE)], [("WARN", "ROOM_TITLE_ORPHAN", 1)]),
    ((), [("polyline", "width_dimension_line", "600,300;700,300", {})], [("WARN", "WIDTH_LINE_ORPHAN", 1)]),
    ((), [("polyline", "fire_clearance_line", "600,600;700,600", {}), ("box", "dimension_val", "1000,300;1010,310", _TITLE)], [("WARN", "DIM_VAL_ORPHAN", 1)]),
    (("gate", "width"), [], [("ERROR", "MISSING_CLASS", 1)]),
    (("b",), [], [("WARN", "TOO_FEW", 1)]),
    ((), _SHOPS[:4], [("WARN", "SHOP_OVER", 1)]),
    ((), [*_SHOPS, *_ROOMS], [("WARN", "SHOP_OVER", 1), ("WARN", "SHOP_EQ_ROOM", 1)]),
    (("evac",), [], [("ERROR", "NO_EVAC_LINE", 1), ("ERROR", "MISSING_CLASS", 1)]),
    ((), [("polyline", "evac_distance_line", "200,200;200,400;400,400", {"pair_id": "01"})], [("WARN", "DUP_PAIR_ID", 1)]),
    ((), [("polyline", "evac_distance_line", "200,200;200,400;400,400", {"pair_id": "07"})], [("INFO", "NO_EXIT_PAIR", 1)]),
    ((), [("polyline", "evac_distance_line", "200,200;200,400;400,400", {"text_content": "480m"})], [("WARN", "EVAC_TEXT_RANGE", 1)]),
    ((), [("polyline", "evac_distance_line", "200,200;200,400;400,400", {"text_content": "1.2.3"})], [("WARN", "EVAC_TEXT_NONNUM", 1)]),
    ((), [("polyline", "evac_distance_line", "200,200", {"pair_id": "02"})], [("ERROR", "EVAC_TOO_SHORT", 1)]),
    ((), [("polyline", "evac_distance_line", "200,200;200,400", {"pair_id": "02"})], [("INFO", "EVAC_STRAIGHT", 1)]),
    (("b",), [("polygon", "fire_compartment", "1100,100;1900,100;1900,900;1100,900", {"zone_type": "公共区"}), ("box", "room_title", "500,500;510,510", {"text_content": "配电室"})], [("WARN", "NO_EQUIP_ZONE", 1)]),
    ((), [("box", "draft_curtain", "10,10;50,50", {}), ("box", "draft_curtain", "11,10;50,50", {}), ("box", "draft_curtain", "60,10;100,50", {})], [("INFO", "DUP_SHAPE", 1)]),
    (tuple(CLEAN), [], [("ERROR", "NO_IMAGE", 1)]),
    (tuple(CLEAN), [("polygon", "station_exit_ground", _AREA, {})], [("ERROR", "MISSING_CLASS", 1)]),
]
_NO_IMAGE, _SITE = 31, 32
_N = len(KINDS)
_ITEM = "array<array<struct<geom:string,ord:int,label:string,points:string,attrs:array<struct<name:string,value:string>>>>>"


def _kinds() -> list[list[dict]]:
    out = []
    for gone, come, _ in KINDS:
        own, counts = [], {}
        for geom, label, points, attrs in [*(s for n, s in CLEAN.items() if n not in gone), *come]:
            own.append({"geom": geom, "ord": counts.get(geom, 0), "label": label, "points": points, "attrs": [{"name": n, "value": v} for n, v in attrs.items()]})
            counts[geom] = counts.get(geom, 0) + 1
        out.append(own)
    return out


def _drawings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, images and shapes: one drawing for each customer, of the kind that its key gives."""
    key = F.col("c_custkey")
    files = table(spark, sf_dir, "customer").select(key.cast("string").alias("file"), F.pmod(key, F.lit(_N)).cast("int").alias("kind"))
    image = F.when(F.col("kind") == _SITE, F.concat(F.lit("总平面图 "), "file")).otherwise(F.concat(F.lit("站厅 "), "file"))
    images = files.where(F.col("kind") != _NO_IMAGE).select(F.col("file").alias("doc_id"), "file", image.alias("image"), F.lit(4000.0).alias("width"), F.lit(2000.0).alias("height"), F.lit(None).cast("string").alias("corrupt"), "kind")
    drawn = images.select("*", F.explode(F.get(F.from_json(F.lit(json.dumps(_kinds(), ensure_ascii=False)), _ITEM), F.col("kind"))).alias("s"))
    return files.select("file"), images.drop("kind"), drawn.select("doc_id", "file", "image", "width", "height", "s.geom", "s.ord", "s.label", g.parse_points(F.col("s.points")).alias("points"), "s.attrs")


@lru_cache(maxsize=16)
def _stage(spark: SparkSession, sf_dir: str) -> str:
    return scratch(spark, "quality")


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files and the items found, made once in a session."""
    files, images, shapes = _drawings(spark, sf_dir)
    return files, staged(spark, _stage(spark, sf_dir), lambda: qc.qc_items(shapes, images, files=files))


_FOUND = ", ".join(f"({i}, '{level}', '{code}', {n})" for i, (_, _, found) in enumerate(KINDS) for level, code, n in found)
_ITEMS = f"SELECT c_custkey AS file, level, code, n FROM customer JOIN (VALUES {_FOUND}) f(kind, level, code, n) ON kind = c_custkey % {_N}"


@query(f"SELECT file, level, code, CAST(n AS BIGINT) AS n FROM ({_ITEMS})")
def qc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quality code on drawings that have its fault, and none on those that have not."""
    return _items(spark, sf_dir)[1].groupBy(F.col("file").cast("long").alias("file"), "level", "code").agg(F.count("*").alias("n"))


@query(f"SELECT c_custkey AS file, coalesce(sum(n) FILTER (level = 'ERROR'), 0)::BIGINT AS errors, coalesce(sum(n) FILTER (level = 'WARN'), 0)::BIGINT AS warnings, coalesce(sum(n) FILTER (level = 'INFO'), 0)::BIGINT AS infos, CASE WHEN sum(n) FILTER (level = 'ERROR') > 0 THEN 'fail' WHEN sum(n) FILTER (level = 'WARN') > 0 THEN 'fix' ELSE 'pass' END AS verdict FROM customer LEFT JOIN ({_ITEMS}) i ON i.file = c_custkey GROUP BY c_custkey")
def qc_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, items = _items(spark, sf_dir)
    return qc.verdict(items, files).select(F.col("file").cast("long").alias("file"), "errors", "warnings", "infos", "verdict")


@query(f"SELECT DISTINCT file, level, code, CAST(n AS BIGINT) AS n FROM ({_ITEMS})")
def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with their counts."""
    return qc.summary(_items(spark, sf_dir)[1]).select(F.col("file").cast("long").alias("file"), "level", "code", "n")


@query(f"SELECT c_custkey AS file, CASE WHEN c_custkey % {_N} = {_SITE} THEN 'site' ELSE 'hall' END AS kind_by_name, CASE WHEN c_custkey % {_N} = {_SITE} THEN 'site' ELSE 'hall' END AS kind_by_vote FROM customer WHERE c_custkey % {_N} <> {_NO_IMAGE}")
def drawing_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of a drawing by its name, and by the votes of its labels where the name tells nothing."""
    shapes = _drawings(spark, sf_dir)[2]
    named = qc.drawing_type(shapes).withColumnRenamed("group", "kind_by_name")
    return named.join(qc.drawing_type(shapes.withColumn("image", F.lit("x"))).withColumnRenamed("group", "kind_by_vote"), "file").select(F.col("file").cast("long").alias("file"), "kind_by_name", "kind_by_vote")


@query("SELECT source, count(*) AS total, count(quality) AS filled, CASE WHEN count(quality) = 0 THEN 'none' WHEN count(quality) < count(*) THEN 'partial' ELSE 'full' END AS grade FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def attr_fill_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return qc.filled(docs, ["source"], "quality")


@query("SELECT need.t AS event_type, CAST(need.least AS BIGINT) AS need, coalesce(n, 0) AS got, CASE WHEN n IS NULL THEN 'ERROR' ELSE 'WARN' END AS level FROM (VALUES ('click', 1000000000), ('view', 1), ('never', 1)) need(t, least) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY ALL) e ON e.event_type = need.t WHERE coalesce(n, 0) < need.least")
def mandatory_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = spark.createDataFrame([("click", 1_000_000_000), ("view", 1), ("never", 1)], "event_type string, need long")
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("got"))
    return qc.lacking(need, counts, ["event_type"]).select("event_type", "need", "got", "level")


@query("SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated texts, by a digest."""
    return qc.repeated(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest")), ["digest"])


# grouped steps


@query("SELECT s_suppkey, printf('DR-%03d', row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier")
def ordinal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.col("s_suppkey").alias("place"))
    return numbered(rows, "DR-%03d", ["s_nationkey"], "place").select("s_suppkey", "id", F.col("place").cast("long").alias("place"))


@query("SELECT source, doc_id, quality FROM (SELECT source, d.doc_id, quality, row_number() OVER (PARTITION BY source ORDER BY quality IS NULL, d.doc_id) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE n = 1")
def dedup_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return first_rows(docs, ["source"], [F.col("quality").isNull(), F.col("doc_id")]).select("source", "doc_id", "quality")


@query("SELECT p_brand, p_size FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS n FROM part GROUP BY p_brand, p_size) WHERE n = 1")
def mode_tie_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mode_low(table(spark, sf_dir, "part"), ["p_brand"], "p_size")


@query("SELECT p_brand, array_to_string(list(concat(p_size, '=', n) ORDER BY p_size), ',') AS freq FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand")
def frequency_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frequencies(table(spark, sf_dir, "part"), ["p_brand"], "p_size")
    return found.select("p_brand", F.array_join(F.transform(F.array_sort(F.map_entries("freq")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("freq"))


@query("SELECT l_orderkey, array_to_string(list(concat(l_returnflag, l_linestatus) ORDER BY l_linenumber, concat(l_returnflag, l_linestatus)), '') AS flags FROM lineitem GROUP BY l_orderkey")
def collect_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("flag"))
    return lines.groupBy("l_orderkey").agg(text_in_order(["l_linenumber"], "flag").alias("flags"))


_NUMBERS = "SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS o, l_quantity * CASE WHEN l_linenumber % 2 = 0 THEN 100 ELSE 1 END + 0.25::DOUBLE AS v FROM lineitem"


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("doc_id"), (F.col("l_orderkey") * 10 + line).alias("ord"), (F.col("l_quantity") * F.when(line % 2 == 0, 100).otherwise(1) + 0.25).alias("value"))


@query(f"SELECT k, array_to_string(list_transform(list_reverse_sort(list(DISTINCT round(v, 2)) FILTER (v BETWEEN 300 AND 20000)), lambda x: CAST(x AS VARCHAR)), ',') AS areas, array_to_string(list_transform(list_sort(list(DISTINCT round(v, 1)) FILTER (v BETWEEN 10 AND 80 AND NOT v BETWEEN 300 AND 20000)), lambda x: CAST(x AS VARCHAR)), ',') AS distances FROM ({_NUMBERS}) GROUP BY k")
def distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct areas, largest first, and distances, smallest first, of read numbers."""
    found = documents.distinct_values(_numbers(spark, sf_dir))
    said = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return found.select(F.col("doc_id").cast("long").alias("k"), said("areas"), said("distances"))


@query(f"""WITH n AS ({_NUMBERS}), r AS (SELECT *, CASE WHEN v BETWEEN 300 AND 20000 THEN 'area' WHEN v BETWEEN 10 AND 80 THEN 'distance' END AS kind FROM n), o AS (SELECT *, row_number() OVER (PARTITION BY k, kind ORDER BY o) AS i FROM r WHERE kind IS NOT NULL)
SELECT k, CASE kind WHEN 'area' THEN 'AREA-PUB-001' ELSE 'EVAC-DIST-ANY-001' END AS rule_id, printf(CASE kind WHEN 'area' THEN 'FC-%02d' ELSE 'EVAC-%02d' END, i) AS target_id, CASE kind WHEN 'area' THEN v <= 5000 ELSE v <= 50 END AS passed FROM o""")
def flat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers routed to areas and distances, nested into flat documents, and their findings."""
    from .rules import default_rules, evaluate_documents

    found = evaluate_documents(documents.flat_document(_numbers(spark, sf_dir)), default_rules(), fields=("doc_id", "rule_id", "target_id", "passed"))
    return found.select(F.col("doc_id").cast("long").alias("k"), "rule_id", "target_id", "passed")


@query(f"SELECT k, round(sqrt(max(v) / (100.0 * (k + 1))), 9) AS scale FROM ({_NUMBERS}) WHERE v BETWEEN 300 AND 20000 GROUP BY k")
def inverse_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale by the largest area over the largest region."""
    numbers = _numbers(spark, sf_dir)
    side = lambda part: g.box_ring(F.lit(0), F.lit(0), F.lit(10.0) * part, F.lit(10.0) * (F.col("doc_id").cast("long") + 1))
    regions = numbers.select("doc_id").distinct().select("doc_id", F.explode(F.array(side(1.0), side(0.5))).alias("points"))
    return documents.inverse_scale(numbers, regions).select(F.col("doc_id").cast("long").alias("k"), F.round("scale", 9).alias("scale"))


_BLOCKS = "SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'equipment' ELSE 'unknown' END AS zone, 100 + s_suppkey % 50 + 0.5::DOUBLE AS area FROM supplier"


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of two compartments a drawing: the first is written without a zone, and again with one, where its key allows."""
    s = F.col("s_suppkey")
    zone = F.when(s % 3 == 0, "公共区").when(s % 3 == 1, "设备管理区").otherwise("")
    area = F.format_string("%.1f", 100 + s % 50 + 0.5)
    first, again = F.concat(F.lit("防火分区一"), area, F.lit("㎡")), F.concat(F.lit("防火分区（一 "), area, F.lit(" "), zone, F.lit("；其余内容见总说明" * 7), F.lit("；防火分区二：面积900.25㎡公共区"))
    block = lambda i, text: F.struct(F.lit(i).alias("block_ord"), text.alias("text"), F.array(F.lit(0.04), F.lit(1.06)).alias("bbox"))
    return table(spark, sf_dir, "supplier").select(s.cast("string").alias("doc_id"), F.lit(0).alias("page_no"), F.inline(F.array(block(0, first), block(1, again), block(2, F.lit("其他 300")))))


@query(f"SELECT k, '一' AS seq, area AS area_m2, zone AS zone_type, CASE WHEN zone = 'unknown' THEN 0 ELSE 1 END AS block_ord FROM ({_BLOCKS}) UNION ALL SELECT k, '二', 900.25, 'public', 1 FROM ({_BLOCKS})")
def written_compartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compartments written in text blocks: of two writings the one with a zone."""
    found = documents.compartments_of_text(_written(spark, sf_dir))
    return found.select(F.col("doc_id").cast("long").alias("k"), "seq", "area_m2", "zone_type", "block_ord")


@query(f"SELECT k, CAST(2 AS BIGINT) AS n, round(area + 900.25, 2) AS total_m2, CASE WHEN zone = 'unknown' THEN '防火分区一' ELSE '' END AS unknown FROM ({_BLOCKS})")
def text_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.text_consistency(documents.compartments_of_text(_written(spark, sf_dir)))
    return found.select(F.col("doc_id").cast("long").alias("k"), "n", "total_m2", "unknown")


@query("SELECT s_suppkey AS k, concat('{\"a\":', s_suppkey, ',\"list\":[{\"x\":1},2,\"y\"]}') AS body FROM supplier")
def public_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON without its private fields, in the object and in the objects of its lists."""
    body = F.concat(F.lit('{"_raw": {"b": 1}, "a": '), F.col("s_suppkey").cast("string"), F.lit(', "list": [{"x": 1, "_y": 2}, 2, "y"]}'))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), documents.public_fields(body).alias("body"))


@query(f"SELECT k, concat('{{\"source\":\"vector_text\",\"fire_compartment\":[{{\"id\":\"防火分区一\",\"area_m2\":', area, ',\"zone_type\":\"', zone, '\"}},{{\"id\":\"防火分区二\",\"area_m2\":900.25,\"zone_type\":\"public\"}}],\"findings\":[]}}') AS body FROM ({_BLOCKS})")
def flat_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = documents.compartments_of_text(_written(spark, sf_dir))
    none = spark.createDataFrame([], "doc_id string, rule_ord int, target_ord int, rule_id string, target_id string, passed boolean, value string, threshold string")
    return documents.flat_findings(none, written).select(F.col("doc_id").cast("long").alias("k"), "body")


@query("SELECT k, concat('20=', 1 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END, CASE WHEN k % 2 = 1 THEN ',100=1' ELSE '' END) AS freq FROM (SELECT s_suppkey AS k FROM supplier)")
def ratio_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a page names each 1:N, ratios out of range left out."""
    s = F.col("s_suppkey")
    pages = table(spark, sf_dir, "supplier").select(s.alias("doc_id"), F.lit(0).alias("page_no"), F.concat(F.lit("1:20 比例 1 ： "), F.when(s % 2 == 0, "20").otherwise("100"), F.lit(" 1:5000 1:10")).alias("text"))
    found = scale.ratio_frequencies(pages)
    return found.select(F.col("doc_id").alias("k"), F.array_join(F.transform(F.array_sort(F.map_entries("ratio_freq")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("freq"))


# detections and candidates


_TILES = "SELECT p_partkey, p_size * 97 AS w, p_size * 61 AS h FROM part"


@query(f"""WITH s AS (SELECT *, w > 1536 OR h > 1536 AS large FROM ({_TILES})), x AS (SELECT *, unnest(CASE WHEN large THEN range(0, w, 824) ELSE [0] END) AS tx FROM s), y AS (SELECT *, unnest(CASE WHEN large THEN range(0, h, 824) ELSE [0] END) AS ty FROM x),
t AS (SELECT *, CASE WHEN large THEN least(1024, w - tx) ELSE w END AS tw, CASE WHEN large THEN least(1024, h - ty) ELSE h END AS th FROM y) SELECT p_partkey, CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, CAST(tw AS BIGINT) AS tw, CAST(th AS BIGINT) AS th FROM t WHERE NOT large OR (tw >= 307.2 AND th >= 307.2)""")
def training_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 97).alias("width"), (F.col("p_size") * 61).alias("height"))
    return detect.training_tiles(images, 1024, 200, ["p_partkey"]).select("p_partkey", *(F.col(c).cast("long").alias(c) for c in ("tx", "ty", "tw", "th")))


def _ring(x0, y0, w, h):
    return g.box_ring(x0, y0, x0 + w, y0 + h)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 2000 by 1000 with a gate, a compartment over a tile's edge and a line, which gives no sample."""
    k = F.col("s_suppkey") % 50
    two = lambda x, y, w, h: F.array(g.point(x, y), g.point(x + w, y + h))
    shape = lambda geom, label, points: F.struct(F.lit(geom).alias("geom"), F.lit(0).alias("ord"), F.lit(label).alias("label"), points.alias("points"))
    drawn = F.array(shape("box", "gate", two(100 + k, F.lit(200.0), F.lit(50.0), F.lit(50.0))), shape("polygon", "fire_compartment", _ring(F.lit(900.0), F.lit(100.0), F.lit(400.0), F.lit(300.0))), shape("polyline", "evac_distance_line", two(F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(9.0))))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.format_string("a/img%d.jpg", "s_suppkey").alias("image"), F.lit(2000.0).alias("width"), F.lit(1000.0).alias("height"), F.inline(drawn))


_GATE, _ZONE = CLASSES.index("gate"), CLASSES.index("fire_compartment")


def _line(cls: int, x0: str, y0: str, x1: str, y1: str, w: int, h: int) -> str:
    corners = ((x0, y0), (x1, y0), (x1, y1), (x0, y1))
    return "concat('" + str(cls) + "'" + "".join(f", printf(' %.6f %.6f', ({x}) / {w}.0, ({y}) / {h}.0)" for x, y in corners) + ")"


_X = "(100 + s_suppkey % 50)"
_SAMPLES = f"""SELECT concat('img', s_suppkey, '_t0') AS name, {_line(_GATE, _X, '200', f'{_X} + 50', '250', 1024, 1000)} || '|' || {_line(_ZONE, '900', '100', '1024', '400', 1024, 1000)} AS lines FROM supplier
UNION ALL SELECT concat('img', s_suppkey, '_t1'), {_line(_ZONE, '76', '100', '476', '400', 1024, 1000)} FROM supplier"""


@query(_SAMPLES)
def training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines of the tiles of each image: shapes clipped to their tile, and lines left out."""
    found = dataset.samples(_labelled(spark, sf_dir), 1024, 200)
    return found.select("name", F.array_join("lines", "|").alias("lines"))


@query(f"SELECT name, replace(lines, '|', chr(10)) AS value, CASE WHEN length(name) % 2 = 0 THEN 'train' ELSE 'val' END AS split FROM ({_SAMPLES})")
def training_label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files written by split and name, and read back."""
    path = scratch(spark, "labels")
    split = F.when(F.length("name") % 2 == 0, "train").otherwise("val")
    sinks.write_training_labels(dataset.samples(_labelled(spark, sf_dir), 1024, 200).withColumn("split", split), path)
    return spark.read.text(path, wholetext=True).select("name", F.regexp_replace("value", "\\n$", "").alias("value"), "split")


@query(f"SELECT cls, class, CASE class WHEN 'gate' THEN n WHEN 'fire_compartment' THEN 2 * n ELSE 0 END AS n, CASE WHEN class NOT IN ('gate', 'fire_compartment') THEN 'none' WHEN CASE class WHEN 'gate' THEN n ELSE 2 * n END < 150 THEN 'few' ELSE '' END AS note FROM (VALUES {', '.join(f'({i}, {chr(39)}{c}{chr(39)})' for i, c in enumerate(CLASSES))}) t(cls, class), (SELECT count(*) AS n FROM supplier)")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.class_counts(dataset.samples(_labelled(spark, sf_dir), 1024, 200)).select("cls", "class", "n", "note")


@query(f"SELECT concat('nc: {len(CLASSES)}', chr(10), 'names:', chr(10), '  0: {CLASSES[0]}') AS held, {len(LABELS)} AS labels, '{'; '.join(sorted(LABELS))}' AS names")
def label_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training configuration and the label template."""
    config, template = sinks.training_config("/data"), json.loads(sinks.label_template())
    return spark.createDataFrame([(config[config.index("nc:") : config.index("\n  1:")], len(template), "; ".join(sorted(t["name"] for t in template)))], "held string, labels int, names string")


_DETECTIONS = "SELECT p_partkey % 40 AS d, p_partkey AS o, CASE p_size % 3 WHEN 0 THEN 'fire_door' WHEN 1 THEN 'gate' ELSE 'room_title' END AS cls_name, p_size / 50.0::DOUBLE AS conf, p_size AS s FROM part"


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    name = F.when(s % 3 == 0, "fire_door").when(s % 3 == 1, "gate").otherwise("room_title")
    box = F.array(s.cast("double"), F.lit(0.0), s + 10.0, F.lit(10.0))
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).cast("string").alias("doc_id"), F.col("p_partkey").alias("ord"), name.alias("cls_name"), (s / 50.0).alias("conf"), box.alias("box"), F.array(g.point(s, F.lit(1.0))).alias("polygon"), (s * 7).alias("tx"), (s * 3).alias("ty"))


@query(f"SELECT d, o, CAST(s * 8 AS DOUBLE) AS x0, CAST(s * 3 AS DOUBLE) AS y0, CAST(s * 8 + 10 AS DOUBLE) AS x1, CAST(s * 3 + 10 AS DOUBLE) AS y1, CAST(s * 8 AS DOUBLE) AS px, CAST(s * 3 + 1 AS DOUBLE) AS py FROM ({_DETECTIONS})")
def global_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = detect.to_global(_detections(spark, sf_dir))
    return moved.select(F.col("doc_id").cast("long").alias("d"), F.col("ord").alias("o"), *(F.col("box")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))), F.col("polygon")[0]["x"].alias("px"), F.col("polygon")[0]["y"].alias("py"))


@query(f"SELECT d, o, CASE WHEN conf >= 0.7 THEN 'auto' ELSE 'auto_review' END AS tier, CASE cls_name WHEN 'fire_door' THEN 'class=unknown;swing_dir=顺着疏散方向' WHEN 'room_title' THEN 'text_content=' ELSE '' END AS attrs FROM ({_DETECTIONS})")
def default_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.with_default_attrs(_detections(spark, sf_dir))
    return found.select(F.col("doc_id").cast("long").alias("d"), F.col("ord").alias("o"), detect.confidence_tier(F.col("conf")).alias("tier"), F.array_join(F.transform("attrs", lambda a: F.concat_ws("=", a["name"], a["value"])), ";").alias("attrs"))


_JSON = "concat('{\"cls_name\":\"', cls_name, '\",\"conf\":', CAST(conf AS VARCHAR), '}')"


@query(f"""WITH t AS ({_DETECTIONS}), c AS (SELECT d, sum(n) AS total, string_agg(concat('"', cls_name, '":', n), ',' ORDER BY cls_name) AS by_class FROM (SELECT d, cls_name, count(*) AS n FROM t GROUP BY ALL) GROUP BY d), l AS (SELECT d, string_agg({_JSON}, ',' ORDER BY o) AS items FROM t GROUP BY d)
SELECT c.d, concat('{{"total_detections":', total, ',"by_class":{{', by_class, '}},"detections":[', items, ']}}') AS body FROM c JOIN l ON l.d = c.d""")
def detection_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detection_documents(_detections(spark, sf_dir).select("doc_id", "ord", "cls_name", "conf"))
    return found.select(F.col("doc_id").cast("long").alias("d"), "body")


_OPS = "SELECT l_suppkey AS d, l_orderkey * 10 + l_linenumber AS o, CASE WHEN l_linenumber % 3 = 0 THEN 're' ELSE 'l' END AS kind, CAST(l_quantity AS DOUBLE) AS x0, 5.0::DOUBLE AS y0, CAST(l_quantity * (1 + l_linenumber) AS DOUBLE) AS x1, 5.0::DOUBLE + l_linenumber % 2 AS y1 FROM lineitem"


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, q = F.col("l_linenumber"), F.col("l_quantity").cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.lit(0).alias("page_no"), (F.col("l_orderkey") * 10 + line).alias("op_ord"), F.when(line % 3 == 0, "re").otherwise("l").alias("kind"), q.alias("x0"), F.lit(5.0).alias("y0"), (q * (1 + line)).alias("x1"), (F.lit(5.0) + line % 2).alias("y1"), F.array(F.lit(0.0)).alias("color"))


@query(f"SELECT d, o FROM (SELECT d, o, row_number() OVER (PARTITION BY d ORDER BY sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) * 2 DESC, o) AS n FROM ({_OPS}) WHERE kind = 'l' AND 2 * sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) > 120 AND (2 * abs(x1 - x0) < 1.5 OR 2 * abs(y1 - y0) < 1.5)) WHERE n <= 5")
def line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest straight lines of each page."""
    return detect.line_candidates(_ops(spark, sf_dir), 2.0, top=5).select(F.col("doc_id").alias("d"), F.col("op_ord").alias("o"))


@query(f"SELECT d, o, 2 * (x1 - x0) AS w FROM ({_OPS}) WHERE 2 * (x1 - x0) > 0 AND 2 * (x1 - x0) < 60 AND y1 > y0 AND 2 * (y1 - y0) < 60")
def text_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.text_strokes(_ops(spark, sf_dir), 2.0).select(F.col("doc_id").alias("d"), F.col("op_ord").alias("o"), (F.col("x1") - F.col("x0")).alias("w"))


@query("SELECT d, o FROM (SELECT d, o, row_number() OVER (PARTITION BY d ORDER BY w * h DESC, o) AS n FROM (SELECT p_partkey % 40 AS d, p_partkey AS o, 10 * p_size AS w, 5 * p_size AS h FROM part) WHERE w * h / 1000000.0 BETWEEN 0.0008 AND 0.05 AND w <= 750 AND h <= 750) WHERE n <= 3")
def region_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest regions of plausible area and extent."""
    s = F.col("p_size")
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("doc_id"), F.col("p_partkey").alias("ord"), _ring(F.lit(0.0), F.lit(0.0), s * 10.0, s * 5.0).alias("points"), F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"))
    return detect.region_candidates(rows, top=3).select(F.col("doc_id").alias("d"), F.col("ord").alias("o"))


_WORDS = "SELECT c_nationkey AS d, c_custkey AS o, CAST(c_custkey % 100 AS DOUBLE) AS x, CAST(c_custkey * 7 % 100 AS DOUBLE) AS y, left(c_mktsegment, 1) AS t FROM customer"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), c.alias("word_ord"), (c % 100).cast("double").alias("cx"), (c * 7 % 100).cast("double").alias("cy"), F.substring("c_mktsegment", 1, 1).alias("text"))


_HELD = f"SELECT n_nationkey AS d, coalesce(string_agg(t, '' ORDER BY o) FILTER (x >= 10 AND x <= 60 AND y >= 20 AND y <= 80), '') AS in_box, coalesce(string_agg(t, '' ORDER BY o) FILTER (x + y < 100.5), '') AS in_polygon FROM nation LEFT JOIN ({_WORDS}) w ON w.d = n_nationkey GROUP BY n_nationkey"


@query(_HELD)
def words_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside a box, and inside a triangle, one after the other."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.lit(0).alias("ord"))
    boxes = nation.select("*", *(F.lit(v).alias(n) for n, v in (("x0", 10.0), ("y0", 20.0), ("x1", 60.0), ("y1", 80.0))))
    triangle = F.array(g.point(F.lit(-0.25), F.lit(-0.25)), g.point(F.lit(100.75), F.lit(-0.25)), g.point(F.lit(-0.25), F.lit(100.75)))
    words = _words(spark, sf_dir)
    one = detect.words_in_boxes(boxes, words).select(F.col("doc_id").alias("d"), F.col("content").alias("in_box"))
    return one.join(detect.words_in_polygons(nation.withColumn("points", triangle), words).select(F.col("doc_id").alias("d"), F.col("content").alias("in_polygon")), "d")


@query(f"SELECT d, o * 1000 AS num_ord, CAST(o % 40 AS DOUBLE) AS value FROM ({_WORDS}) WHERE o % 40 BETWEEN 10 AND 30")
def word_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers within bounds that words hold, with their place."""
    words = _words(spark, sf_dir).withColumn("text", F.concat(F.lit("L="), (F.col("word_ord") % 40).cast("string"), F.lit("m"))).withColumn("box", F.array("cx", "cy"))
    return annotations.numbers_of_words(words, 10, 30).select(F.col("doc_id").alias("d"), F.col("num_ord").cast("long").alias("num_ord"), "value")


_REGIONS = "SELECT s_suppkey AS k, s_suppkey % 4 AS m FROM supplier"


@query(f"SELECT k, CASE m WHEN 0 THEN 'surrounding_building' WHEN 1 THEN 'station_exit_ground' ELSE 'fire_compartment' END AS label, CASE m WHEN 2 THEN '无人区' WHEN 3 THEN '公共区' END AS zone_type, CASE m WHEN 0 THEN 0.55 WHEN 1 THEN 0.45 WHEN 2 THEN 0.6 ELSE 0.5 END::DOUBLE AS conf, CASE WHEN m < 2 THEN 'fire_clearance_line' WHEN m = 2 THEN 'evac_distance_line' ELSE 'width_dimension_line' END AS line, CASE m WHEN 0 THEN 0.7 WHEN 1 THEN 0.5 WHEN 2 THEN 0.65 ELSE 0.5 END::DOUBLE AS line_conf FROM ({_REGIONS})")
def classified_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and lines by group, size and the words inside."""
    m = F.col("m")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 4).alias("m"))
    group = F.when(m < 2, "site").otherwise("hall")
    region = tx.classify_region(F.when(m == 0, 0.02).otherwise(0.005), group, F.when(m == 2, "通信机房").otherwise("大厅"))
    line = tx.classify_line(m % 2 == 0, F.when(m == 2, 200.0).otherwise(100.0), group, F.lit(1000.0))
    return rows.select("k", region["label"].alias("label"), region["zone_type"].alias("zone_type"), region["conf"].alias("conf"), line["label"].alias("line"), F.round(line["conf"], 6).alias("line_conf"))


@query(f"SELECT k, o AS ord, geom, label, CASE WHEN conf >= 0.7 THEN 'auto' ELSE 'auto_review' END AS source FROM ({_REGIONS}), (VALUES (0, 'box', 'room_title', 0.8), (1, 'box', 'val_text', 0.5), (2, 'polyline', 'evac_distance_line', 0.65), (3, 'polygon', 'fire_compartment', 0.7)) t(o, geom, label, conf)")
def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of texts, lines and regions in one table, written with their source and read back."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"))
    part = lambda *own: rows.select("doc_id", F.inline(F.array(*(F.struct(F.lit(o).alias("ord"), F.lit(label).alias("label"), F.array(g.point(F.lit(1.0), F.lit(2.0)), g.point(F.lit(3.0), F.lit(4.0)), g.point(F.lit(3.0), F.lit(5.0))).alias("points"), F.array().cast("array<struct<name:string,value:string>>").alias("attrs"), F.lit(conf).alias("conf")) for o, label, conf in own))))
    merged = detect.merged_candidates(part((0, "room_title", 0.8), (5, "val_text", 0.5)), part((0, "evac_distance_line", 0.65)), part((0, "fire_compartment", 0.7)))
    path = scratch(spark, "candidates")
    sinks.write_annotations(merged.select(F.col("doc_id").alias("image"), F.lit(9.0).alias("width"), F.lit(9.0).alias("height"), "geom", "ord", "label", "points", "attrs", "source"), path)
    raw = lambda geom: spark.read.format("xml").option("rowTag", "image").schema(f"_name string, {geom} array<struct<_label:string,_source:string>>").load(path).select(F.col("_name").alias("k"), F.lit(geom).alias("geom"), F.explode(geom).alias("s"))
    read = raw("box").unionByName(raw("polyline")).unionByName(raw("polygon")).select("k", "geom", F.col("s._label").alias("label"), F.col("s._source").alias("source"))
    return merged.select(F.col("doc_id").alias("k"), "ord", "geom", "label").join(read, ["k", "geom", "label"]).select(F.col("k").cast("long").alias("k"), "ord", "geom", "label", "source")


@query(f"""SELECT k, concat('To confirm: 2 of ', 3 + m, chr(10), 'Zone types of 1 compartments are guesses: confirm each', CASE WHEN m > 0 THEN concat(chr(10), m, ' equipment rooms, but no equipment zone: a compartment may be missing') ELSE '' END,
chr(10), 'By label: fire_compartment=1, ', 'room_title=', 1 + m, ', val_text=1') AS text FROM ({_REGIONS})""")
def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checklist of a drawing's candidates, with the equipment zone that its rooms miss."""
    m = (F.col("s_suppkey") % 4).cast("int")
    item = lambda label, conf, zone, content: F.struct(F.lit(label).alias("label"), F.lit(conf).alias("conf"), F.lit(zone).cast("string").alias("zone_type"), F.lit(content).alias("content"))
    own = F.array(item("fire_compartment", 0.5, "公共区", ""), item("val_text", 0.4, None, "1"), item("room_title", 0.8, None, "大厅"))
    rooms = F.array_repeat(item("room_title", 0.8, None, "配电室"), m)
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.inline(F.concat(own, rooms)))
    return report.checklist_text(rows, "k").select("k", "text")


# plane geometry


@query("SELECT s_suppkey AS k, round(sqrt(greatest(0, x - 10) ** 2 + greatest(0, y - 10) ** 2), 6) AS to_square, round(sqrt(greatest(0, x - 10) ** 2 + greatest(0, y - 10) ** 2), 6) AS to_box, round(least(sqrt(x * x + y * y), sqrt((x - 10) ** 2 + y * y), sqrt((x - 10) ** 2 + (y - 10) ** 2), sqrt(x * x + (y - 10) ** 2)), 6) AS to_vertex, round(sqrt(greatest(0, x - 10) ** 2 + greatest(0, y - 10) ** 2), 6) AS squares, greatest(0, x / 10 - 0.15) AS net FROM (SELECT s_suppkey, CAST(s_suppkey % 23 AS DOUBLE) AS x, CAST(s_suppkey % 17 AS DOUBLE) AS y FROM supplier)")
def plane_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of a point and of a square from a square, a box and its corners, and net door widths."""
    x, y = (F.col("s_suppkey") % 23).cast("double"), (F.col("s_suppkey") % 17).cast("double")
    square = g.box_ring(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))
    rounded = lambda c, name: F.round(c, 6).alias(name)
    zero, ten = F.lit(0.0), F.lit(10.0)
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), rounded(g.polygon_distance(square, x, y), "to_square"), rounded(g.rect_distance(x, y, zero, zero, ten, ten), "to_box"), rounded(g.vertex_distance(square, x, y), "to_vertex"), rounded(g.polygons_distance(square, g.box_ring(x, y, x + 5, y + 5)), "squares"), g.net_door_width(x / 10).alias("net")
    )


@query("SELECT k, v, CASE WHEN v BETWEEN 300 AND 20000 THEN 'area' WHEN v BETWEEN 10 AND 80 THEN 'distance' END AS kind, CASE WHEN v BETWEEN 20 AND 2000 THEN 1 ELSE 0 END AS ratios FROM (SELECT p_partkey AS k, CAST(p_size * 13 AS DOUBLE) AS v FROM part)")
def routed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers routed by size, and whether one is a ratio that drawings have."""
    v = (F.col("p_size") * 13).cast("double")
    said = F.concat(F.lit("1:"), (F.col("p_size") * 13).cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), v.alias("v"), documents.route(v).alias("kind"), F.size(tx.ratios(said)).alias("ratios"))
