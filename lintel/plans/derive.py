"""Object tables from shapes: the structuring query.

Every table has doc_id and ord, its order within the drawing, which ids and ties go by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..functions.base import lookup
from ..operators.groups import numbered
from ..operators.scale import from_shapes, upper_median
from ..operators.spatial import first_match_join, near_join, nearest_join, pair_join
from ..sources.annotations import attr
from ..vocab import ZONES

#: Pixels: an exit belongs to a compartment this near, a door this near its ring is on a fire wall, a width line this near measures an object.
EXIT_NEAR, WALL_NEAR, LINE_NEAR = 30, 15, 60
ADJACENT_METRES = 50
DEFAULT_STATION = {"type": "underground", "height_m": 0.0, "transfer_lines": 1, "project_all_doors_class_A": False, "is_shared_concourse": False}


def _of(shapes: DataFrame, label: str, geom: str, least: int = 1) -> DataFrame:
    return shapes.where((F.col("label") == label) & (F.col("geom") == geom) & (F.size("points") >= least))


def _nonzero(value: Column) -> Column:
    return F.when(value != 0, value)


def scaled(shapes: DataFrame, scales: DataFrame | None = None) -> DataFrame:
    """shapes with a `scale`: the given one (doc_id, scale), else that of the drawing's own lengths."""
    found = from_shapes(shapes).select("doc_id", F.col("scale").alias("own_scale"))
    out = shapes.join(found, "doc_id", "left")
    if scales is None:
        return out.withColumnRenamed("own_scale", "scale")
    return out.join(scales.select("doc_id", F.col("scale").alias("given")), "doc_id", "left").withColumn("scale", F.coalesce(_nonzero(F.col("given")), "own_scale")).drop("given", "own_scale")


def station_meta(shapes: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row of station data for each drawing, with defaults for what is not given."""
    docs = shapes.select("doc_id").distinct()
    joined = docs.join(meta, "doc_id", "left") if meta is not None else docs
    default = lambda name: F.coalesce(F.col(name), F.lit(DEFAULT_STATION[name])) if meta is not None and name in meta.columns else F.lit(DEFAULT_STATION[name])
    return joined.select("doc_id", *(default(name).alias(name) for name in DEFAULT_STATION))


def structure(shapes: DataFrame, scales: DataFrame | None = None, meta: DataFrame | None = None) -> dict[str, DataFrame]:
    """The object tables of all drawings, given shapes and, where known, scales and station data by doc_id."""
    s = scaled(shapes, scales)
    points, scale = F.col("points"), F.col("scale")
    stations = station_meta(shapes, meta)

    zone = F.coalesce(lookup(ZONES, attr("zone_type")), F.lit("public"))
    rings = numbered(_of(s, "fire_compartment", "polygon", 3), "FC-%02d")
    claim, measured = tx.first_number(attr("area_m2_design")), g.area(points, scale)
    compartments = rings.select("doc_id", "ord", "id", F.coalesce(_nonzero(claim), measured).alias("area_m2"), claim.alias("area_m2_design"), measured.alias("area_m2_geom"), zone.alias("zone_type"), "points")
    walls = compartments.select("doc_id", F.col("ord").alias("fc_ord"), F.col("id").alias("fc_id"), F.col("zone_type").alias("fc_zone"), F.col("points").alias("ring"))

    middle = g.mean_point(points)
    exits = numbered(_of(s, "safety_exit", "box", 2), "EX-%02d").select("doc_id", "ord", "id", middle["x"].alias("cx"), middle["y"].alias("cy"), attr("pair_id").alias("pair_id"), F.col("width").alias("w"), F.col("height").alias("h"), "scale")
    near = g.contains(F.col("ring"), F.col("cx"), F.col("cy")) | (g.boundary_distance(F.col("ring"), F.col("cx"), F.col("cy")) < EXIT_NEAR)
    placed = first_match_join(exits, walls, ["doc_id"], ["ord"], near, ["fc_ord"])
    exit_zone = F.coalesce("found.fc_zone", F.lit("public"))
    exit_table = placed.select(
        "doc_id", "ord", "id", F.when(exit_zone == "public", "ground").otherwise("other").alias("leads_to"),
        g.direction_group(F.col("cx"), F.col("cy"), F.col("w") / 2, F.col("h") / 2).alias("direction_group"), exit_zone.alias("zone"), "pair_id", F.array("cx", "cy").alias("center_px"), F.col("found.fc_id").alias("fc_id"), "scale",
    )

    pairs = pair_join(exit_table.select("doc_id", "ord", "id", "direction_group", "center_px", "scale"), ["doc_id"], "ord")
    a, b = F.col("a"), F.col("b")
    apart = F.hypot(a["center_px"][0] - b["center_px"][0], a["center_px"][1] - b["center_px"][1]) * _nonzero(a["scale"])
    relation = F.when(a["direction_group"] == b["direction_group"], "same_direction").when((F.col("distance_m") > 0) & (F.col("distance_m") <= ADJACENT_METRES), "adjacent")
    exit_pairs = pairs.withColumn("distance_m", apart).withColumn("relation", relation).where("relation is not null")
    exit_pair = exit_pairs.select("doc_id", (a["ord"] * 100_000 + b["ord"]).alias("ord"), F.concat_ws("-", F.lit("EXP"), a["id"], b["id"]).alias("id"), a["id"].alias("exit_a"), b["id"].alias("exit_b"), "relation", "distance_m")

    lines = _of(s, "width_dimension_line", "polyline").select("doc_id", F.col("ord").alias("line_ord"), F.col("points").alias("line"), F.col("scale").alias("line_scale"))
    boxes = s.where(F.col("label").isin("fire_door", "stair_escalator", "gate") & (F.col("geom") == "box") & (F.size("points") >= 2)).select("doc_id", F.col("ord").alias("box_ord"), F.col("label").alias("box_label"), middle.alias("box_at"))
    tests = F.concat(F.array(F.get("line", F.lit(0)), F.element_at("line", -1)), F.array(g.mean_point(F.col("line"))))
    measured_by = near_join(lines, boxes, ["doc_id"], ["line_ord"], tests, F.col("box_at"), ["box_ord"], LINE_NEAR)
    opening = g.length(F.col("line"), F.col("line_scale"))
    last_line = measured_by.where("nearest.box_label = 'fire_door'").groupBy("doc_id", F.col("nearest.box_ord").alias("shape_ord")).agg(F.max_by(g.net_door_width(opening), "line_ord").alias("net"))
    width = lambda c: F.when(c != 0, F.round(c, 3))

    door_shapes = _of(s, "fire_door", "box", 2).withColumn("shape_ord", F.col("ord")).withColumn("swing", attr("swing_dir")).withColumn("cls", attr("class"))
    doors = numbered(door_shapes, "DR-%03d").select("doc_id", "ord", "id", "shape_ord", middle["x"].alias("cx"), middle["y"].alias("cy"), "swing", "cls").join(last_line, ["doc_id", "shape_ord"], "left")
    in_zone = first_match_join(doors, walls, ["doc_id"], ["ord"], g.contains(F.col("ring"), F.col("cx"), F.col("cy")), ["fc_ord"])
    on_wall = F.coalesce(g.boundary_distance(F.col("found.ring"), F.col("cx"), F.col("cy")) < WALL_NEAR, F.lit(False))
    door = in_zone.select(
        "doc_id", "ord", "id", width(F.col("net")).alias("clear_width_m"), F.when(F.contains("swing", F.lit("顺")), "evacuation").when(F.contains("swing", F.lit("逆")), "reverse").otherwise("evacuation").alias("swing_direction"),
        F.lit(True).alias("is_evacuation"), F.lit("between_exits").alias("position"), F.coalesce("found.fc_zone", F.lit("public")).alias("zone"), F.lit(None).cast("double").alias("distance_to_nearest_exit_m"),
        F.when(F.col("cls") == "", "unknown").otherwise(F.col("cls")).alias("class"), on_wall.alias("is_on_firewall"), F.lit(False).alias("is_always_open"),
    )
    ways = measured_by.where("nearest.box_label <> 'fire_door'").select("doc_id", F.col("line_ord").alias("ord"), F.col("nearest.box_label").alias("box_label"), opening.alias("wide"))
    corridor = numbered(ways, "COR-%02d").select("doc_id", "ord", "id", F.when(F.col("box_label") == "stair_escalator", "evac_stair").otherwise("evac_corridor").alias("kind"), width(F.col("wide")).alias("clear_width_m"), F.lit(None).cast("double").alias("length_m"))

    evac = numbered(_of(s, "evac_distance_line", "polyline", 0), "EVAC-%02d").select("doc_id", "ord", "id", F.coalesce(_nonzero(tx.first_number(attr("text_content"))), g.length(points, scale)).alias("length_m"), F.lit("any_to_exit").alias("kind"), attr("pair_id").alias("pair_id"))
    shops = numbered(_of(s, "commercial_shop", "polygon"), "SHOP-%02d").select("doc_id", "ord", "id", g.area(points, scale).alias("area_m2"), middle.alias("at"), "scale")
    shop_pairs = pair_join(shops, ["doc_id"], "ord")
    shop_pair = shop_pairs.select("doc_id", (a["ord"] * 100_000 + b["ord"]).alias("ord"), F.format_string("SP-%d-%d", a["ord"] + 1, b["ord"] + 1).alias("id"), a["id"].alias("shop_a"), b["id"].alias("shop_b"), (F.hypot(a["at"]["x"] - b["at"]["x"], a["at"]["y"] - b["at"]["y"]) * _nonzero(a["scale"])).alias("opening_distance_m"))
    wide = F.abs(F.get("points", F.lit(1))["x"] - F.get("points", F.lit(0))["x"]) * _nonzero(scale)
    shutter = numbered(_of(s, "fire_shutter", "box", 2), "FS-%02d").select("doc_id", "ord", "id", wide.alias("opening_width_m"), wide.alias("shutter_width_m"))

    held = lambda rows, *columns: F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*columns).alias("item")))), lambda x: x["item"])
    exit_item = ("id", "leads_to", "direction_group", "zone", "pair_id", "center_px")
    empty = "array<struct<id:string,leads_to:string,direction_group:string,zone:string,pair_id:string,center_px:array<double>>>"
    by_wall = exit_table.where("fc_id is not null").groupBy("doc_id", F.col("fc_id").alias("id")).agg(held(exit_table, *exit_item).alias("exits"))
    none = F.array().cast(empty)
    shared = stations.select("doc_id", "is_shared_concourse")
    fire_compartment = compartments.drop("points").join(by_wall, ["doc_id", "id"], "left").join(shared, "doc_id").select("doc_id", "ord", "id", "area_m2", "area_m2_design", "area_m2_geom", "zone_type", "is_shared_concourse", F.coalesce("exits", none).alias("exits"), F.coalesce("exits", none).alias("effective_exits"))

    public = compartments.where("zone_type = 'public'").groupBy("doc_id").agg(F.sum(F.coalesce("area_m2", F.lit(0.0))).alias("public_area"))
    by_zone = exit_table.withColumn("is_public", F.col("zone") == "public").groupBy("doc_id", "is_public").agg(held(exit_table, *exit_item).alias("exits"))
    side = lambda flag, name: by_zone.where(F.col("is_public") == flag).select("doc_id", F.col("exits").alias(name))
    stalls = shops.groupBy("doc_id").agg(held(shops, "id", "area_m2").alias("shops"))
    station = stations.join(public, "doc_id", "left").join(side(True, "public_exits"), "doc_id", "left").join(side(False, "equipment_exits"), "doc_id", "left").join(stalls, "doc_id", "left")
    station = station.select(
        "doc_id", "type", "height_m", "transfer_lines", "project_all_doors_class_A",
        F.struct(F.col("public_area").alias("area_m2"), F.coalesce("shops", F.array().cast("array<struct<id:string,area_m2:double>>")).alias("commercial_shops"), F.coalesce("public_exits", none).alias("exits")).alias("public_zone"),
        F.struct(F.coalesce("equipment_exits", none).alias("exits")).alias("equipment_zone"),
    )
    return {
        "station": station, "fire_compartment": fire_compartment, "exit": exit_table.drop("fc_id", "scale"), "exit_pair": exit_pair, "door": door, "corridor": corridor,
        "evac_distance_line": evac, "shop": shops.drop("at", "scale"), "shop_pair": shop_pair, "fire_shutter": shutter,
    }


def median_door_width(doors: DataFrame) -> DataFrame:
    """(doc_id, doors, median_width_m): the upper median of the known widths of a drawing's doors."""
    return doors.where("clear_width_m is not null").groupBy("doc_id").agg(F.count("*").alias("doors"), upper_median(F.col("clear_width_m")).alias("median_width_m"))


def with_rings(compartments: DataFrame, shapes: DataFrame) -> DataFrame:
    """Compartments with the `points` of the polygon in their place: the i-th row and the i-th compartment drawn."""
    rings = numbered(_of(shapes, "fire_compartment", "polygon", 3), "FC-%02d").select("doc_id", "ord", "points")
    return compartments.join(rings, ["doc_id", "ord"])


def building_clearance(shapes: DataFrame) -> DataFrame:
    """Clearances of a site drawing: each building with its category and the nearest exit or vent.

    The scale is the upper median of written dimensions over the clearance lines nearest to them. A building without
    an exit or vent in its drawing has a null distance, so its rules ask for review.
    """
    centre = g.mean_point(F.col("points"))
    lines = _of(shapes, "fire_clearance_line", "polyline", 2).select("doc_id", F.col("ord").alias("line_ord"), g.length(F.col("points")).alias("px"), centre.alias("line_at")).where("px > 5")
    dims = _of(shapes, "dimension_val", "box").select("doc_id", F.col("ord").alias("dim_ord"), tx.first_number(attr("text_content")).alias("metres"), centre.alias("dim_at")).where("metres is not null")
    apart = lambda p, q: F.hypot(F.col(f"{p}.x") - F.col(f"{q}.x"), F.col(f"{p}.y") - F.col(f"{q}.y"))
    scale = nearest_join(lines, dims, ["doc_id"], ["line_ord"], apart("line_at", "dim_at"), ["dim_ord"]).groupBy("doc_id").agg(upper_median(F.col("nearest.metres") / F.col("px")).alias("scale"))
    buildings = numbered(_of(shapes, "surrounding_building", "polygon", 3), "BC-%02d").select("doc_id", "ord", "id", F.col("points").alias("ring"), centre.alias("at"), *(attr(n).alias(n) for n in ("building_type", "name", "fire_rating", "floors", "height_m")))
    metas = _of(shapes, "building_meta", "box").select("doc_id", F.col("ord").alias("meta_ord"), attr("text_content").alias("meta"), centre.alias("meta_at"))
    told = nearest_join(buildings, metas, ["doc_id"], ["ord"], apart("at", "meta_at"), ["meta_ord"], how="left").withColumn("meta", F.coalesce("nearest.meta", F.lit(""))).drop("nearest", "distance")
    kinds = {"station_exit_ground": "出入口", "vent_group_ground": "风亭"}
    attached = shapes.where(F.col("label").isin(list(kinds)) & (F.size("points") >= 3)).select("doc_id", F.col("ord").alias("to_ord"), lookup(kinds, F.col("label")).alias("kind"), F.col("points").alias("to_ring"))
    near = nearest_join(told, attached, ["doc_id"], ["ord"], g.polygons_distance(F.col("ring"), F.col("to_ring")), ["to_ord"], how="left").join(scale, "doc_id", "left")
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    named = F.coalesce(blank("name"), F.when(F.col("meta") != "", F.substring_index("meta", "\n", 1)), F.concat(F.lit("建筑"), (F.col("ord") + 1).cast("string")))
    return near.select("doc_id", "ord", "id", named.alias("building_name"), tx.building_category(F.col("building_type"), F.col("floors"), F.col("height_m"), F.col("meta")).alias("building_category"), blank("building_type").alias("building_type"), blank("fire_rating").alias("fire_rating"), blank("floors").alias("floors"), blank("height_m").alias("height_m"), F.col("nearest.kind").alias("nearest_kind"), F.round(F.col("distance") * F.col("scale"), 2).alias("distance_m"))


def fill_designed_area(compartments: DataFrame, rings: DataFrame, numbers: DataFrame, require_decimal: bool = True, prefer_claim: bool = False) -> DataFrame:
    """Compartments whose claimed area is missing get the median of the read numbers (doc_id, cx, cy, value) inside them.

    rings has doc_id, id and points. The area itself changes only where it is missing, or always with prefer_claim.
    """
    usable = numbers.where("value between 200 and 10000")
    usable = usable.where(F.col("value") != F.floor("value")) if require_decimal else usable
    inside = rings.join(usable, "doc_id").where(g.contains(F.col("points"), F.col("cx"), F.col("cy")))
    medians = inside.groupBy("doc_id", "id").agg(F.round(F.median("value"), 2).alias("read"))
    joined = compartments.join(medians, ["doc_id", "id"], "left")
    missing = F.coalesce(F.col("area_m2_design"), F.lit(0.0)) == 0
    filled = F.when(missing, F.coalesce("read", "area_m2_design")).otherwise(F.col("area_m2_design"))
    own = _nonzero(F.col("area_m2"))
    area = F.coalesce(F.when(missing, F.col("read")), own) if prefer_claim else F.coalesce(own, F.when(missing, F.col("read")), F.col("area_m2"))
    return joined.withColumn("area_m2", area).withColumn("area_m2_design", filled).select(*compartments.columns)


def door_sides(shapes: DataFrame) -> DataFrame:
    """(doc_id, id, fc_id): each door with every compartment on whose ring it stands, those of both sides of a wall."""
    middle = g.mean_point(F.col("points"))
    doors = numbered(_of(shapes, "fire_door", "box", 2), "DR-%03d").select("doc_id", "id", middle["x"].alias("cx"), middle["y"].alias("cy"))
    rings = numbered(_of(shapes, "fire_compartment", "polygon", 3), "FC-%02d").select("doc_id", F.col("id").alias("fc_id"), F.col("points").alias("ring"))
    b = g.bounds(F.col("ring"))
    near = F.col("cx").between(b["x0"] - WALL_NEAR, b["x1"] + WALL_NEAR) & F.col("cy").between(b["y0"] - WALL_NEAR, b["y1"] + WALL_NEAR)
    return doors.join(rings, "doc_id").where(near).where(g.boundary_distance(F.col("ring"), F.col("cx"), F.col("cy")) < WALL_NEAR).select("doc_id", "id", "fc_id")


def with_effective_exits(compartments: DataFrame, doors: DataFrame, sides: DataFrame) -> DataFrame:
    """Opt-in: effective exits are the exits and, for compartments on either side (doc_id, id, fc_id), the always-open class A doors on the fire wall."""
    item = F.struct(F.col("id"), F.lit("other").alias("leads_to"), F.lit(None).cast("string").alias("direction_group"), "zone", F.lit(None).cast("string").alias("pair_id"), F.lit(None).cast("array<double>").alias("center_px"))
    open_doors = doors.where("is_always_open and is_on_firewall and class = '甲级'").join(sides, ["doc_id", "id"]).groupBy("doc_id", "fc_id").agg(F.array_sort(F.collect_list(item)).alias("more"))
    return compartments.join(open_doors.withColumnRenamed("fc_id", "id"), ["doc_id", "id"], "left").withColumn("effective_exits", F.concat("exits", F.coalesce("more", F.array().cast(compartments.schema["exits"].dataType)))).select(*compartments.columns)


def vent_pairs(shapes: DataFrame, scales: DataFrame, higher: DataFrame | None = None) -> DataFrame:
    """Opt-in: each fresh-air vent of a drawing with each exhaust or piston vent, and their distance.

    higher gives (doc_id, ord, height) of vents where it is known; without it the height rule asks for review.
    """
    vents = _of(shapes, "vent_group_ground", "polygon", 3).select("doc_id", "ord", F.col("points").alias("ring"), attr("vent_function").alias("use"), attr("name").alias("name"))
    vents = vents.join(higher, ["doc_id", "ord"], "left") if higher is not None else vents.withColumn("height", F.lit(None).cast("double"))
    named = vents.withColumn("vent_id", F.when(F.col("name") != "", F.col("name")).otherwise(F.format_string("VENT-%02d", F.col("ord") + 1)))
    side = lambda p: named.select("doc_id", *(F.col(c).alias(f"{p}_{c}") for c in ("ord", "ring", "use", "vent_id", "height")))
    pairs = side("f").where("f_use = '新风'").join(side("o").where(F.col("o_use").isin("排风", "活塞风")), "doc_id").join(scales.select("doc_id", "scale"), "doc_id", "left")
    return pairs.select(
        "doc_id", (F.col("f_ord") * 100_000 + F.col("o_ord")).alias("ord"), F.concat_ws("-", F.lit("VP"), (F.col("f_ord") + 1).cast("string"), (F.col("o_ord") + 1).cast("string")).alias("id"), F.lit("fresh_vs_exhaust_or_piston").alias("kind"),
        F.col("f_vent_id").alias("fresh_id"), F.col("o_vent_id").alias("other_id"), (g.polygons_distance(F.col("f_ring"), F.col("o_ring")) * F.col("scale")).alias("distance_m"), (F.col("o_height") > F.col("f_height")).alias("is_exhaust_higher"),
    )
