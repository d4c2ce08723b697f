"""Structured documents: object tables nested into JSON, and documents from text layers and flat lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..operators.groups import first_rows

#: Values read off a drawing: areas in square metres and distances in metres by size.
AREAS, DISTANCES = (300.0, 20_000.0), (10.0, 80.0)


def nest(tables: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, body): the object tables of each drawing as one JSON document, lists in order, nulls kept.

    The objects of all tables are grouped at once: one shuffle, and not one for each table and each join of them.
    """
    lists = [name for name in tables if name != "station"]

    def items(name: str) -> DataFrame:
        table = tables[name]
        item = F.to_json(F.struct(*(c for c in table.columns if c not in ("doc_id", "ord"))) if name != "station" else F.struct(*(c for c in table.columns if c != "doc_id")), {"ignoreNullFields": "false"})
        return table.select("doc_id", F.lit(name).alias("name"), (F.col("ord") if name != "station" else F.lit(0)).alias("ord"), item.alias("item"))

    rows = reduce(DataFrame.unionByName, map(items, ["station", *lists]))
    held = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "item", "name"))).alias("held"), F.max(F.when(F.col("name") == "station", F.col("item"))).alias("station")).where("station is not null")
    own = lambda name: F.transform(F.filter("held", lambda x: x["name"] == name), lambda x: x["item"])
    listed = [F.concat(F.lit(f',"{name}":['), F.array_join(own(name), ","), F.lit("]")) for name in lists]
    return held.select("doc_id", F.concat(F.lit('{"station":'), "station", *listed, F.lit("}")).alias("body"))


def compartments_of_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, id, area_m2, zone_type, zone_text, block_ord, bbox) of written compartments (doc_id, page_no, block_ord, text, bbox).

    Of several writings of one ordinal, one with a zone goes before one without, and else the first.
    """
    found = blocks.where(F.contains("text", F.lit("防火分区"))).select("doc_id", "page_no", "block_ord", "bbox", F.posexplode(tx.sections(F.col("text"))).alias("at", "s"))
    told = found.withColumn("seq", F.col("s.seq"))
    chosen = first_rows(told, ["doc_id", "seq"], [F.col("s.zone_type") == "unknown", F.col("page_no"), F.col("block_ord"), F.col("at")])
    return chosen.select("doc_id", F.col("s.seq").alias("seq"), F.concat(F.lit("防火分区"), "s.seq").alias("id"), "s.area_m2", "s.zone_type", "s.zone_text", "block_ord", F.transform("bbox", lambda v: F.round(v, 1)).alias("bbox"))


def text_consistency(compartments: DataFrame) -> DataFrame:
    """(doc_id, n, total_m2, unknown): how many compartments are written, their claimed sum, and those without a zone."""
    unknown = F.array_sort(F.collect_list(F.when(F.col("zone_type") == "unknown", F.col("id"))))
    return compartments.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("area_m2"), 2).alias("total_m2"), F.array_join(unknown, ", ").alias("unknown"))


def route(value: Column) -> Column:
    """Whether a number that stands on a drawing is an area or a distance; null for neither."""
    return F.when(value.between(*AREAS), "area").when(value.between(*DISTANCES), "distance")


def flat_document(numbers: DataFrame) -> DataFrame:
    """(doc_id, body): documents of public compartments and evacuation lines from numbers (doc_id, ord, value), with an empty station.

    Numbers of one place go by value, so that reruns agree.
    """
    routed = numbers.withColumn("kind", route(F.col("value"))).where("kind is not null")
    n = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("ord", "value"))
    rows = routed.withColumn("n", n)
    area = F.struct(F.format_string("FC-%02d", "n").alias("id"), F.col("value").alias("area_m2"), F.lit("public").alias("zone_type"), F.lit(False).alias("is_shared_concourse"))
    line = F.struct(F.format_string("EVAC-%02d", "n").alias("id"), F.col("value").alias("length_m"), F.lit("any_to_exit").alias("kind"))
    of = lambda kind, item: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", F.to_json(item).alias("j"))))), lambda x: x["j"]), ",")
    return rows.groupBy("doc_id").agg(F.concat(F.lit('{"station":{},"fire_compartment":['), of("area", area), F.lit('],"evac_distance_line":['), of("distance", line), F.lit("]}")).alias("body"))


def inverse_scale(numbers: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, scale): by the largest read area over the largest closed region (doc_id, points)."""
    largest = numbers.where(route(F.col("value")) == "area").groupBy("doc_id").agg(F.max("value").alias("m2"))
    drawn = regions.groupBy("doc_id").agg(F.max(g.area(F.col("points"))).alias("px2")).where("px2 > 0")
    return largest.join(drawn, "doc_id").select("doc_id", F.sqrt(F.col("m2") / F.col("px2")).alias("scale"))


def distinct_values(numbers: DataFrame) -> DataFrame:
    """(doc_id, areas, distances): the distinct areas of a drawing's read numbers to two digits, largest first, and distances to one, smallest first."""
    kind = route(F.col("value"))
    held = lambda name, digits: F.collect_set(F.when(kind == name, F.round("value", digits)))
    return numbers.groupBy("doc_id").agg(F.sort_array(held("area", 2), asc=False).alias("areas"), F.sort_array(held("distance", 1)).alias("distances"))


def public_fields(body: Column) -> Column:
    """A JSON object without its fields whose names begin with an underscore, and so the objects of its lists; null for what is no object."""
    fields = F.map_filter(F.from_json(body, "map<string,variant>"), lambda k, _: ~F.startswith(k, F.lit("_")))

    def item(v: Column) -> Column:
        inner = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~F.startswith(k, F.lit("_")))
        return F.coalesce(F.to_json(inner), F.to_json(v))

    def value(v: Column) -> Column:
        return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), item), ","), F.lit("]")), F.to_json(v))

    written = F.transform(F.map_entries(fields), lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit("\x00"), value(e["value"])))
    # the key's array brackets go
    return F.concat(F.lit("{"), F.array_join(F.transform(written, lambda s: F.concat(F.regexp_replace(F.substring_index(s, "\x00", 1), "^\\[|\\]$", ""), F.lit(":"), F.substring(s, F.instr(s, "\x00") + 1, F.length(s)))), ","), F.lit("}"))


def public_columns(rows: DataFrame) -> DataFrame:
    """rows without the columns whose names begin with an underscore."""
    return rows.select(*(c for c in rows.columns if not c.startswith("_")))


def flat_findings(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, body): the flat document of a drawing's written compartments, as of compartments_of_text(), and of its findings."""
    item = F.struct("seq", F.to_json(F.struct("id", "area_m2", "zone_type")).alias("j"))
    zones = texts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"]), ",").alias("zones"))
    found = findings.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_ord", "target_ord", F.to_json(F.struct("rule_id", "target_id", "passed", "value", "threshold")).alias("j")))), lambda x: x["j"]), ",").alias("found"))
    joined = zones.join(found, "doc_id", "left")
    return joined.select("doc_id", F.concat(F.lit('{"source":"vector_text","fire_compartment":['), "zones", F.lit('],"findings":['), F.coalesce("found", F.lit("")), F.lit("]}")).alias("body"))


def measurement_reports(shapes: DataFrame) -> DataFrame:
    """(doc_id, image, label, n, area_m2, length_m): the measured shapes of each image by type, areas and lengths added up; shapes carry a `scale`."""
    points, scale = F.col("points"), F.col("scale")
    area, length = F.when(F.col("geom") == "polygon", g.area(points, scale)), F.when(F.col("geom") == "polyline", g.length(points, scale))
    return shapes.groupBy("doc_id", "image", "label").agg(F.count("*").alias("n"), F.sum(area).alias("area_m2"), F.sum(length).alias("length_m"))


def measurements(shapes: DataFrame) -> DataFrame:
    """(doc_id, image, measured): each shape of an image with its area, length and centre, as one array in order; shapes carry a `scale`."""
    points, scale = F.col("points"), F.col("scale")
    item = F.struct("geom", "ord", "label", g.area(F.when(F.col("geom") == "polygon", points), scale).alias("area_m2"), F.when(F.col("geom") == "polyline", g.length(points, scale)).alias("length_m"), g.mean_point(points).alias("centre"))
    return shapes.groupBy("doc_id", "image").agg(F.array_sort(F.collect_list(item)).alias("measured"))
