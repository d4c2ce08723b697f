"""Longest way out of public areas: a grid of passable cells and shortest ways from all exits at once, by drawing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.annotations import attr

CELL = 20
RESULT = "doc_id string, max_distance_m double, farthest_x int, farthest_y int, nearest_exit_id string, mask_cells long, unreachable_cells long"


def shortest(mask: np.ndarray, sources: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The distance in cells of each passable cell from the nearest source (x, y), and that source, the first of equals; sources may lie outside the mask.

    All cells that changed last offer their neighbours a way, and the least offers change these, until none does.
    """
    height, width = mask.shape
    wide = width + 2
    passable = np.pad(mask, 1).ravel()
    dist, source = np.full(passable.shape, np.inf), np.full(passable.shape, len(sources))
    for i, (x, y) in reversed(list(enumerate(sources))):
        if 0 <= x < width and 0 <= y < height:
            dist[(y + 1) * wide + x + 1], source[(y + 1) * wide + x + 1] = 0.0, i
    steps = [(v, u) for v in (-1, 0, 1) for u in (-1, 0, 1) if (v, u) != (0, 0)]
    moves, costs = np.array([v * wide + u for v, u in steps])[:, None], np.array([math.hypot(v, u) for v, u in steps])[:, None]
    front = np.flatnonzero(dist == 0)
    while len(front):
        at, offered = (front + moves).ravel(), (dist[front] + costs).ravel()
        by = np.broadcast_to(source[front], (len(steps), len(front))).ravel()
        better = passable[at] & ((offered < dist[at]) | ((offered == dist[at]) & (by < source[at])))
        at, offered, by = at[better], offered[better], by[better]
        order = np.lexsort((by, offered, at))
        at, offered, by = at[order], offered[order], by[order]
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1]
        front = at[first]
        dist[front], source[front] = offered[first], by[first]
    whole = lambda a: a.reshape(height + 2, wide)[1:-1, 1:-1]
    return whole(dist), np.where(np.isinf(whole(dist)), -1, whole(source))


def farthest(mask: np.ndarray, exits: list[tuple[str, float, float]], scale: float, cell: int = CELL) -> tuple[float | None, int | None, int | None, str | None, int, int]:
    """Metres, place, exit, passable and unreachable cells of the passable cell with the longest way; null metres where some cell has none."""
    total = int(mask.sum())
    dist, source = shortest(mask, [(int(x) // cell, int(y) // cell) for _, x, y in exits])
    lost = int((mask & np.isinf(dist)).sum())
    if not total or lost:
        return None, None, None, None, total, lost
    y, x = np.unravel_index(np.argmax(np.where(mask, dist, -1)), mask.shape)
    return round(float(dist[y, x]) * cell * scale, 2), int(x) * cell, int(y) * cell, exits[source[y, x]][0], total, 0


def passable_cells(areas: DataFrame, cell: int = CELL) -> DataFrame:
    """(doc_id, x, y) of the grid cells whose centre lies in a polygon (doc_id, points, width, height), or on its boundary within half a cell."""
    b = g.bounds(F.col("points"))
    last = lambda side: F.greatest(F.lit(0), F.floor(F.col(side) / cell).cast("int") - 1)
    span = lambda low, high, side: F.sequence(F.greatest(F.lit(0), F.floor(low / cell).cast("int")), F.greatest(F.lit(0), F.least(last(side), F.floor(high / cell).cast("int"))))
    grid = areas.where(F.size("points") >= 3).select("doc_id", "points", F.explode(span(b["y0"], b["y1"], "height")).alias("y"), "width").withColumn("x", F.explode(span(b["x0"], b["x1"], "width")))
    cx, cy = (F.col("x") + 0.5) * cell, (F.col("y") + 0.5) * cell
    return grid.where(g.contains(F.col("points"), cx, cy) | (g.boundary_distance(F.col("points"), cx, cy) <= cell / 2)).select("doc_id", "x", "y").distinct()


def evacuation(cells: DataFrame, exits: DataFrame, scales: DataFrame, cell: int = CELL) -> DataFrame:
    """One row for each drawing that has passable cells, exits (doc_id, ord, id, x, y) and a scale.

    The search of one drawing is sequential by nature and small (some 10^5 cells), so drawings are searched side by
    side, each in one Arrow group.
    """
    held = exits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "x", "y"))).alias("exits"))
    grids = cells.groupBy("doc_id").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))

    def search(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples():
                xs, ys = np.asarray(row.xs, int), np.asarray(row.ys, int)
                mask = np.zeros((max(ys.max(), *(int(e["y"]) // cell for e in row.exits)) + 1, max(xs.max(), *(int(e["x"]) // cell for e in row.exits)) + 1), bool)
                mask[ys, xs] = True
                out.append((row.doc_id, *farthest(mask, [(e["id"], e["x"], e["y"]) for e in row.exits], row.scale, cell)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"farthest_x": "Int32", "farthest_y": "Int32"})

    joined = grids.join(held, "doc_id").join(scales.where("scale > 0").select("doc_id", "scale"), "doc_id")
    return joined.mapInPandas(search, RESULT)


def derived_lines(shapes: DataFrame, exits: DataFrame, scales: DataFrame, cell: int = CELL) -> DataFrame:
    """Rows for the table of evacuation lines: the longest derived way of each drawing.

    Public areas count, or public compartments where a drawing has none; public exits, or all where it has none.
    """
    polygons = shapes.where("geom = 'polygon' and size(points) >= 3")
    drawn = polygons.where("label = 'public_area'")
    zones = polygons.where((F.col("label") == "fire_compartment") & (attr("zone_type") == "公共区")).join(drawn.select("doc_id").distinct(), "doc_id", "left_anti")
    areas = drawn.unionByName(zones).select("doc_id", "points", "width", "height")
    public = exits.where("zone = 'public'")
    used = public.unionByName(exits.join(public.select("doc_id").distinct(), "doc_id", "left_anti"))
    found = evacuation(passable_cells(areas, cell), used.select("doc_id", "ord", "id", F.col("center_px")[0].alias("x"), F.col("center_px")[1].alias("y")), scales, cell)
    return found.where("max_distance_m is not null").select("doc_id", F.lit(1_000_000).alias("ord"), F.lit("EVAC-DERIVED-01").alias("id"), F.col("max_distance_m").alias("length_m"), F.lit("any_to_exit").alias("kind"), F.lit("auto").alias("pair_id"))
