"""Detections: tiles, suppression, clusters and candidates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..vocab import DETECTED_ATTRS
from .groups import text_in_order
from .spatial import blocked_overlap_join


def _starts(size: Column, tile: int, step: int) -> Column:
    """Tile starts along a side: multiples of the step, the first that reaches the end shifted back to it."""
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((size - tile) / step)).cast("int"))
    return F.array_distinct(F.transform(steps, lambda i: F.least(i * step, F.greatest(F.lit(0), size - tile))))


def tile_grid(images: DataFrame, tile: int = 1024, overlap: int = 200, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(key, tx, ty, tw, th) of tiles that cover images (key, width, height), the last ones shifted inward."""
    step = max(1, tile - overlap)
    size = images.select(*key, F.col("width").cast("int").alias("w"), F.col("height").cast("int").alias("h")).where("w > 0 and h > 0")
    grid = size.withColumn("ty", F.explode(_starts(F.col("h"), tile, step))).withColumn("tx", F.explode(_starts(F.col("w"), tile, step)))
    return grid.select(*key, "tx", "ty", F.least(F.lit(tile), F.col("w") - F.col("tx")).alias("tw"), F.least(F.lit(tile), F.col("h") - F.col("ty")).alias("th"))


def training_tiles(images: DataFrame, tile: int, overlap: int, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(key, tile, tx, ty, tw, th) of unshifted tiles without slivers; an image not over 1.5 tiles either way is one tile."""
    step = max(1, tile - overlap)
    size = images.select(*key, F.col("width").cast("int").alias("w"), F.col("height").cast("int").alias("h")).where("w > 0 and h > 0")
    large = (F.col("w") > 1.5 * tile) | (F.col("h") > 1.5 * tile)
    starts = lambda side: F.when(large, F.sequence(F.lit(0), F.col(side) - 1, F.lit(step))).otherwise(F.array(F.lit(0)))
    cut = lambda side, at: F.when(large, F.least(F.lit(tile), F.col(side) - F.col(at))).otherwise(F.col(side))
    grid = size.withColumn("ty", F.explode(starts("h"))).withColumn("tx", F.explode(starts("w"))).withColumn("tw", cut("w", "tx")).withColumn("th", cut("h", "ty"))
    return grid.where(~large | ((F.col("tw") >= 0.3 * tile) & (F.col("th") >= 0.3 * tile))).select(*key, "tx", "ty", "tw", "th")


def to_global(detections: DataFrame) -> DataFrame:
    """Boxes and polygons of tile-local detections (with tx, ty) in image coordinates."""
    box = F.transform("box", lambda v, i: v + F.when(i % 2 == 0, F.col("tx")).otherwise(F.col("ty")))
    return detections.withColumn("box", box).withColumn("polygon", F.transform("polygon", lambda p: g.point(p["x"] + F.col("tx"), p["y"] + F.col("ty"))))


def suppressed(boxes: np.ndarray, scores: np.ndarray, most: float) -> np.ndarray:
    """Indices, ascending, of boxes that survive greedy suppression: by score, each drops those that overlap it by more."""
    order = np.argsort(-scores, kind="stable")
    size = np.maximum(0, boxes[:, 2] - boxes[:, 0]) * np.maximum(0, boxes[:, 3] - boxes[:, 1])
    kept = []
    while len(order):
        top, rest = order[0], order[1:]
        kept.append(top)
        w = np.maximum(0, np.minimum(boxes[top, 2], boxes[rest, 2]) - np.maximum(boxes[top, 0], boxes[rest, 0]))
        h = np.maximum(0, np.minimum(boxes[top, 3], boxes[rest, 3]) - np.maximum(boxes[top, 1], boxes[rest, 1]))
        union = size[top] + size[rest] - w * h
        order = rest[np.divide(w * h, union, out=np.zeros(len(rest)), where=union > 0) <= most]
    return np.sort(np.array(kept, int))


def nms(detections: DataFrame, most: float = 0.5, by: Sequence[str] = ("doc_id", "cls_id"), order: str = "ord") -> DataFrame:
    """The detections (by, order, conf, x0, y0, x1, y1, ...) that survive suppression within each document and class."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        return rows.iloc[suppressed(rows[["x0", "y0", "x1", "y1"]].to_numpy(float), rows["conf"].to_numpy(float), most)]

    return detections.groupBy(*by).applyInPandas(group, detections.schema)


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and for each the smallest that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        for side in (label[left], label[right]):
            np.minimum.at(after, side, low)
        after = after[after]
        if (after == label).all():
            return nodes, nodes[label]
        label = after


def clusters(boxes: DataFrame, on: Sequence[str] = ("doc_id",), key: str = "ord", gap: float = 12, members: int = 4, width: tuple[float, float] = (8, 1200), height: tuple[float, float] = (6, float("inf"))) -> DataFrame:
    """(on, cluster, n, x0, y0, x1, y1): connected boxes, of at least so many members and within a size.

    Neighbours come from a join on cells; a drawing's links then meet in one Arrow group, which holds as many of them as
    one drawing has and nothing else.
    """
    links = blocked_overlap_join(boxes, on, key, gap)
    kinds = ", ".join(f"`{c}` {links.schema[c].dataType.simpleString()}" for c in on)

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, labels = components(rows["a"].to_numpy(), rows["b"].to_numpy())
        return pd.DataFrame({**{c: [rows[c].iloc[0]] * len(nodes) for c in on}, "k": nodes, "l": labels})

    labelled = links.groupBy(*on).applyInPandas(group, f"{kinds}, k {links.schema['a'].dataType.simpleString()}, l {links.schema['a'].dataType.simpleString()}")
    joined = boxes.withColumn("k", F.col(key)).join(labelled, [*on, "k"], "left").withColumn("cluster", F.coalesce("l", "k"))
    grouped = joined.groupBy(*on, "cluster").agg(F.count("*").alias("n"), *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
    return grouped.where((F.col("n") >= members) & (F.col("x1") - F.col("x0")).between(*width) & (F.col("y1") - F.col("y0")).between(*height))


def line_candidates(ops: DataFrame, scale: float, top: int = 60, least: float = 120, slack: float = 1.5) -> DataFrame:
    """The longest horizontal and vertical lines of each page of vector drawing operations."""
    px = [(F.col(c) * scale).alias(c) for c in ("x0", "y0", "x1", "y1")]
    lines = ops.where("kind = 'l'").select("doc_id", "page_no", "op_ord", "color", *px).withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    straight = lines.where((F.col("length") > least) & ((F.abs(F.col("x1") - F.col("x0")) < slack) | (F.abs(F.col("y1") - F.col("y0")) < slack)))
    return top_rows(straight, ["doc_id", "page_no"], [F.col("length").desc(), F.col("op_ord")], top)


def region_candidates(regions: DataFrame, share: tuple[float, float] = (0.0008, 0.05), vertices: tuple[int, int] = (4, 12), extent: float = 0.75, top: int = 25) -> DataFrame:
    """The largest closed regions (doc_id, ord, points, width, height) of plausible area, vertices and extent."""
    b = g.bounds(F.col("points"))
    sized = regions.withColumn("area", g.area(F.col("points")))
    kept = sized.where(F.try_divide("area", F.col("width") * F.col("height")).between(*share) & F.size("points").between(*vertices) & (b["x1"] - b["x0"] <= extent * F.col("width")) & (b["y1"] - b["y0"] <= extent * F.col("height")))
    return top_rows(kept, ["doc_id"], [F.col("area").desc(), F.col("ord")], top)


def top_rows(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def confidence_tier(conf: Column, sure: float = 0.7) -> Column:
    return F.when(conf >= sure, "auto").otherwise("auto_review")


def with_default_attrs(detections: DataFrame, label: str = "cls_name") -> DataFrame:
    """Detections with the attributes that an annotation of their class must have."""
    made = [x for name, attrs in DETECTED_ATTRS.items() for x in (F.lit(name), F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in attrs.items())))]
    return detections.withColumn("attrs", F.coalesce(F.try_element_at(F.create_map(*made), F.col(label)), F.array().cast("array<struct<name:string,value:string>>")))


def text_strokes(ops: DataFrame, scale: float = 1.0, most: float = 60) -> DataFrame:
    """The boxes (doc_id, page_no, op_ord, x0, y0, x1, y1) of drawing operations as small as strokes of letters: both sides over 0 and under `most`."""
    low = lambda p, q: (F.least(p, q) * scale).alias(p)
    high = lambda p, q: (F.greatest(p, q) * scale).alias(q)
    boxes = ops.select("doc_id", "page_no", "op_ord", low("x0", "x1"), low("y0", "y1"), high("x0", "x1"), high("y0", "y1"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return boxes.where((w > 0) & (w < most) & (h > 0) & (h < most))


def words_in_polygons(regions: DataFrame, words: DataFrame, on: Sequence[str] = ("doc_id",), key: str = "ord") -> DataFrame:
    """Regions (on, key, points, ...) with `content`: the words (on, word_ord, cx, cy, text) inside, joined in order."""
    b = g.bounds(F.col("points"))
    near = F.col("cx").between(b["x0"], b["x1"]) & F.col("cy").between(b["y0"], b["y1"])
    hits = regions.select(*on, key, "points").join(words, list(on)).where(near).where(g.contains(F.col("points"), F.col("cx"), F.col("cy"))).groupBy(*on, key).agg(text_in_order(["word_ord"], "text").alias("content"))
    return regions.join(hits, [*on, key], "left").withColumn("content", F.coalesce("content", F.lit("")))


def merged_candidates(texts: DataFrame, lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Candidates of one drawing in one table (doc_id, ord, geom, label, points, attrs, conf, source): texts, then lines, then regions.

    Each part has doc_id, ord, label, points, attrs and conf; ord is counted anew over all of a drawing's.
    """
    parts = [part.select("doc_id", F.lit(i).alias("__p"), "ord", F.lit(geom).alias("geom"), "label", "points", "attrs", "conf") for i, (geom, part) in enumerate((("box", texts), ("polyline", lines), ("polygon", regions)))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    counted = every.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("__p", "ord")) - 1)
    return counted.drop("__p").withColumn("source", confidence_tier(F.col("conf")))


def by_class(detections: DataFrame, by: str = "doc_id", label: str = "cls_name") -> DataFrame:
    """(doc_id, total, by_class): how many detections a drawing has, and of each class."""
    counted = detections.groupBy(by, label).agg(F.count("*").alias("n"))
    return counted.groupBy(by).agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("by_class"))


def detection_documents(detections: DataFrame, by: str = "doc_id", order: str = "ord") -> DataFrame:
    """(doc_id, body): the detections of each drawing as one JSON document, in order, with their number in all and by class."""
    item = F.struct(*(c for c in detections.columns if c not in (by, order)))
    held = detections.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.to_json(item).alias("j")))), lambda x: x["j"]).alias("items"))
    joined = held.join(by_class(detections, by), by)
    return joined.select(by, F.concat(F.lit('{"total_detections":'), F.col("total").cast("string"), F.lit(',"by_class":'), F.to_json("by_class"), F.lit(',"detections":['), F.array_join("items", ","), F.lit("]}")).alias("body"))


def words_in_boxes(boxes: DataFrame, words: DataFrame, on: Sequence[str] = ("doc_id",), key: str = "ord") -> DataFrame:
    """Boxes (on, key, x0, y0, x1, y1, ...) with `content`: the words (on, word_ord, cx, cy, text) inside, joined in order."""
    inside = F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("y0"), F.col("y1"))
    hits = boxes.join(words, list(on)).where(inside).groupBy(*on, key).agg(text_in_order(["word_ord"], "text").alias("content"))
    return boxes.join(hits, [*on, key], "left").withColumn("content", F.coalesce("content", F.lit("")))
