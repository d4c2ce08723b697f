"""Data quality of annotations: 32 codes as queries over one table of shapes, and the verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..functions.base import any_of, first_match
from ..operators.spatial import like_boxes_join
from ..sources.annotations import attr
from ..vocab import ENUMS, EQUIPMENT_ROOMS, LABELS, MANDATORY, MOST_SHOPS

#: Pixels within which texts belong to a compartment for sure, and at most; width-line ends to an object; dimensions to a line.
TEXT_NEAR, TEXT_FAR, END_NEAR, DIM_NEAR = 300, 500, 80, 150
SAME_BOX = 0.85
_HAN = "[\\x{4e00}-\\x{9fff}]"
SITE_WORDS, HALL_WORDS = ("总平面",), ("站厅", "站台", "hall")


def _vocabulary(field: str) -> Column:
    pairs = [x for name, spec in LABELS.items() for x in (F.lit(name), F.array(*map(F.lit, getattr(spec, field))).cast("array<string>"))]
    return F.try_element_at(F.create_map(*pairs), F.col("label"))


def drawing_type(shapes: DataFrame) -> DataFrame:
    """(file, group): by a word of an image's name, else by which drawing's labels are more, each label once; site of equals."""
    named = lambda words: any_of([F.contains(F.lower("image"), F.lit(w)) for w in words])
    kinds = {k: [n for n, s in LABELS.items() if s.group == k] for k in ("site", "hall")}
    votes = {k: F.count_distinct(F.when(F.col("label").isin(names), F.col("label"))) for k, names in kinds.items()}
    return shapes.groupBy("file").agg(first_match([(F.bool_or(named(SITE_WORDS)), F.lit("site")), (F.bool_or(named(HALL_WORDS)), F.lit("hall")), (votes["site"] >= votes["hall"], F.lit("site"))], F.lit("hall")).alias("group"))


def _item(rows: DataFrame, level: Column | str, code: Column | str, detail: Column | str, image: str = "image") -> DataFrame:
    text = lambda c: c if isinstance(c, Column) else F.lit(c)
    has = image in rows.columns
    return rows.select("file", (F.col(image) if has else F.lit(None).cast("string")).alias("image"), text(level).alias("level"), text(code).alias("code"), text(detail).alias("detail"))


def filled(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, total, filled, grade): how many rows of a group have a value that is not empty: none, partial or full."""
    has = F.count_if(F.coalesce(F.col(value).cast("string"), F.lit("")) != "")
    return rows.groupBy(*by).agg(F.count("*").alias("total"), has.alias("filled")).withColumn("grade", F.when(F.col("filled") == 0, "none").when(F.col("filled") < F.col("total"), "partial").otherwise("full"))


def lacking(needs: DataFrame, counts: DataFrame, on: list[str]) -> DataFrame:
    """Rows of needs (on, need) whose count (on, got) is less, with `got` and a level: ERROR for none, else WARN."""
    got = F.coalesce("got", F.lit(0))
    return needs.join(counts, on, "left").where(got < F.col("need")).withColumn("level", F.when(got == 0, "ERROR").otherwise("WARN")).withColumn("got", got)


def repeated(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n) of keys that stand more than once."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def _label_checks(shapes: DataFrame) -> list[DataFrame]:
    known = F.col("label").isin(list(LABELS))
    bad = _item(shapes.where(~known), F.when(F.col("label").rlike(_HAN), "ERROR").otherwise("WARN"), "BAD_LABEL", F.col("label"))
    s = shapes.where(known)
    b = g.bounds(F.col("points"))
    outside = (F.col("width") > 0) & (F.col("height") > 0) & ((b["x0"] < -1) | (b["y0"] < -1) | (b["x1"] > F.col("width") + 1) | (b["y1"] > F.col("height") + 1))
    drawn = s.where(F.size("points") > 0)
    degenerate = (b["x1"] - b["x0"] < 1) | (b["y1"] - b["y0"] < 1)
    out = [
        bad,
        _item(s.where(F.size("points") == 0), "ERROR", "EMPTY_GEOM", F.col("label")),
        _item(drawn.where(outside), "WARN", "OUT_OF_BOUNDS", F.col("label")),
        _item(drawn.where((F.col("geom") == "polygon") & (F.size("points") < 3)), "ERROR", "BAD_POLYGON", F.col("label")),
        _item(drawn.where((F.col("geom") == "box") & degenerate), "ERROR", "DEGENERATE_BOX", F.col("label")),
    ]
    a = s.select("file", "image", "label", _vocabulary("attrs").alias("declared"), F.explode("attrs").alias("a"))
    name, value = F.col("a.name"), F.col("a.value")
    junk = name.isin(".", "") | name.rlike(_HAN)
    undeclared = a.where(~F.array_contains("declared", name))
    out.append(_item(undeclared, F.when(junk, "WARN").otherwise("INFO"), F.when(junk, "JUNK_ATTR").otherwise("EXTRA_ATTR"), F.concat_ws(".", "label", name)))
    allowed = F.try_element_at(F.create_map(*(x for k, v in ENUMS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), name)
    out.append(_item(a.where(allowed.isNotNull() & (value != "") & ~F.array_contains(allowed, value)), "WARN", "BAD_ENUM", F.concat_ws(".", "label", name, value)))
    need = s.select("file", "image", "label", "attrs", F.explode(_vocabulary("required")).alias("req"))
    last = F.try_element_at(F.filter("attrs", lambda x: x["name"] == F.col("req")), F.lit(-1))["value"]
    fill = filled(need.withColumn("value", last), ["file", "image", "label", "req"], "value").where("grade <> 'full'")
    none = F.col("filled") == 0
    out.append(_item(fill, F.when(none, "INFO").otherwise("WARN"), F.when(none, "ATTR_ALL_BLANK").otherwise("ATTR_PARTIAL"), F.format_string("%s.%s %d/%d", "label", "req", "filled", "total")))
    return out


def _place_checks(s: DataFrame) -> list[DataFrame]:
    on = ["file", "image", "doc_id"]
    keyed = s.where(F.size("points") > 0)
    centre = g.mean_point(F.array(F.struct(g.bounds(F.col("points"))["x0"].alias("x"), g.bounds(F.col("points"))["y0"].alias("y")), F.struct(g.bounds(F.col("points"))["x1"].alias("x"), g.bounds(F.col("points"))["y1"].alias("y"))))
    of = lambda *labels: keyed.where(F.col("label").isin(*labels))
    texts = of("val_text", "room_title").select(*on, "label", "geom", "ord", centre.alias("at"))
    rings = of("fire_compartment").where(F.size("points") >= 3).select("doc_id", F.col("points").alias("ring"))
    at = F.col("at")
    near = texts.join(rings, "doc_id").groupBy(*on, "label", "geom", "ord").agg(F.bool_or(g.contains(F.col("ring"), at["x"], at["y"])).alias("inside"), F.min(g.vertex_distance(F.col("ring"), at["x"], at["y"])).alias("d"))
    lost = near.where(~F.col("inside") & (F.col("d") > TEXT_NEAR))
    far = F.col("d") > TEXT_FAR
    orphan = _item(lost, F.when(far, "WARN").otherwise("INFO"), F.concat(F.upper("label"), F.when(far, "_ORPHAN").otherwise("_NEAR_ORPHAN")), F.format_string("%.0f", "d"))

    anchors = of("fire_door", "stair_escalator", "gate", "safety_exit").select("doc_id", g.bounds(F.col("points")).alias("box"))
    lines = of("width_dimension_line").where(F.size("points") >= 2).select(*on, "geom", "ord", F.get("points", F.lit(0)).alias("p"), F.element_at("points", -1).alias("q"))
    box = F.col("box")
    to_box = lambda p: g.rect_distance(F.col(p)["x"], F.col(p)["y"], box["x0"], box["y0"], box["x1"], box["y1"])
    ends = lines.join(anchors, "doc_id").groupBy(*on, "geom", "ord").agg(F.min(to_box("p")).alias("dp"), F.min(to_box("q")).alias("dq")).where((F.col("dp") > END_NEAR) & (F.col("dq") > END_NEAR))
    clearance = of("fire_clearance_line").select("doc_id", F.col("points").alias("line"))
    dims = of("dimension_val").select(*on, "geom", "ord", centre.alias("at"))
    apart = dims.join(clearance, "doc_id").groupBy(*on, "geom", "ord").agg(F.min(g.vertex_distance(F.col("line"), at["x"], at["y"])).alias("d")).where(F.col("d") > DIM_NEAR)
    return [orphan, _item(ends, "WARN", "WIDTH_LINE_ORPHAN", F.format_string("%.0f", F.least("dp", "dq"))), _item(apart, "WARN", "DIM_VAL_ORPHAN", F.format_string("%.0f", "d"))]


def _count_checks(shapes: DataFrame, images: DataFrame, kinds: DataFrame) -> list[DataFrame]:
    vocabulary = shapes.sparkSession.createDataFrame([(k, label, n) for k, needs in MANDATORY.items() for label, n in needs.items()], "group string, label string, need int")
    counts = shapes.groupBy("file", "label").agg(F.count("*").alias("got"))
    missing = lacking(kinds.join(F.broadcast(vocabulary), "group"), counts, ["file", "label"])
    shops = shapes.where("label = 'commercial_shop'").groupBy("file", "image").agg(F.count("*").alias("n")).where(F.col("n") > MOST_SHOPS)
    both = shapes.groupBy("file").agg(F.count_if(F.col("label") == "commercial_shop").alias("shops"), F.count_if(F.col("label") == "room_title").alias("rooms")).where("shops > 5 and shops = rooms")
    known = shapes.where(F.col("label").isin(list(LABELS)))
    rooms = known.groupBy("file").agg(
        F.bool_or((F.col("label") == "room_title") & tx.contains_any(attr("text_content"), EQUIPMENT_ROOMS)).alias("rooms"), F.bool_or((F.col("label") == "fire_compartment") & attr("zone_type").isin("无人区", "有人值守区")).alias("zones")
    ).where("rooms and not zones")
    hall = kinds.where("group = 'hall'").select("file")
    evac = known.where("label = 'evac_distance_line'").join(hall, "file", "left_semi").select("file", "image", "doc_id", attr("pair_id").alias("pair"), attr("text_content").alias("said"), "points")
    hall_images = images.join(hall, "file", "left_semi")
    none = hall_images.join(evac.select("doc_id"), "doc_id", "left_anti")
    twice = repeated(evac.where("pair <> ''"), ["file", "image", "doc_id", "pair"]).groupBy("file", "image", "doc_id").agg(F.array_join(F.array_sort(F.collect_list("pair")), ",").alias("pairs"))
    exits = known.where("label = 'safety_exit'").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(tx.split_ids(attr("pair_id"))))).alias("exits")).where(F.size("exits") > 0)
    unpaired = evac.where("pair <> ''").join(exits, "doc_id").where(~F.array_contains("exits", F.col("pair")))
    value = tx.sanitized_number(F.col("said"))
    said = evac.where("said <> ''")
    return [
        _item(missing, F.col("level"), F.when(F.col("got") == 0, "MISSING_CLASS").otherwise("TOO_FEW"), F.format_string("%s %d/%d", "label", "got", "need")),
        _item(shops, "WARN", "SHOP_OVER", F.col("n").cast("string")),
        _item(both, "WARN", "SHOP_EQ_ROOM", F.col("shops").cast("string")),
        _item(rooms.join(hall, "file", "left_semi"), "WARN", "NO_EQUIP_ZONE", ""),
        _item(none, "ERROR", "NO_EVAC_LINE", ""),
        _item(twice, "WARN", "DUP_PAIR_ID", F.col("pairs")),
        _item(unpaired, "INFO", "NO_EXIT_PAIR", F.col("pair")),
        _item(said.where(value.isNotNull() & ((value <= 0) | (value > 100))), "WARN", "EVAC_TEXT_RANGE", F.col("said")),
        _item(said.where(value.isNull()), "WARN", "EVAC_TEXT_NONNUM", F.col("said")),
        _item(evac.where(F.size("points") < 2), "ERROR", "EVAC_TOO_SHORT", ""),
        _item(evac.where(F.size("points") == 2), "INFO", "EVAC_STRAIGHT", ""),
    ]


def _duplicates(shapes: DataFrame, across_images: bool) -> DataFrame:
    """At most one for each earlier box: whether some later one of its label lies over it."""
    boxes = shapes.where((F.col("geom") == "box") & (F.size("points") == 2) & F.col("label").isin(list(LABELS)))
    on = ["file", "label"] if across_images else ["file", "image", "doc_id", "label"]
    row = boxes.select(*dict.fromkeys([*on, "image"]), F.struct(F.length("doc_id").alias("l"), "doc_id", "ord").alias("at"), g.bounds(F.col("points")).alias("box"))
    once = like_boxes_join(row, on, "at", SAME_BOX).select(*on, "a", *([F.col("row_a.image").alias("image")] if across_images else [])).distinct()
    return _item(once, "INFO", "DUP_SHAPE", F.col("label"))


def qc_items(shapes: DataFrame, images: DataFrame, kinds: DataFrame | None = None, across_images: bool = False, files: DataFrame | None = None) -> DataFrame:
    """(file, image, level, code, detail) of all findings; images has a row for each image, also those without shapes.

    kinds gives (file, group) where it is known; else drawing_type() tells it. Duplicates are sought within an image,
    or across those of a file. files gives (file) of all that were looked for: one without an image, or with none that
    can be read, has NO_IMAGE; without files, those of images are all.
    """
    kinds = kinds if kinds is not None else drawing_type(shapes)
    known = shapes.where(F.col("label").isin(list(LABELS)))
    parts = [*_label_checks(shapes), *_place_checks(known), *_count_checks(shapes, images, kinds), _duplicates(shapes, across_images)]
    listed = images.select("file") if files is None else images.select("file").unionByName(files.select("file"))
    parts.append(_item(listed.distinct().join(images.where("corrupt is null").select("file").distinct(), "file", "left_anti"), "ERROR", "NO_IMAGE", ""))
    return reduce(DataFrame.unionByName, parts)


def summary(items: DataFrame) -> DataFrame:
    """(file, level, code, detail, n), severest first."""
    order = F.when(F.col("level") == "ERROR", 0).when(F.col("level") == "WARN", 1).otherwise(2)
    return items.groupBy("file", "level", "code", "detail").agg(F.count("*").alias("n")).orderBy("file", order, "code", "detail")


def verdict(items: DataFrame, files: DataFrame) -> DataFrame:
    """(file, errors, warnings, infos, verdict) of every file."""
    counted = items.groupBy("file").agg(*(F.count_if(F.col("level") == level).alias(name) for level, name in (("ERROR", "errors"), ("WARN", "warnings"), ("INFO", "infos"))))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return files.select("file").distinct().join(counted, "file", "left").select("file", *map(zero, ("errors", "warnings", "infos"))).withColumn("verdict", F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "fix").otherwise("pass"))
