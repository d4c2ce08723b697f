"""Plane geometry over columns of points, array<struct<x double, y double>>, as built-in expressions.

A ring is not closed: its last point joins its first. Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let, number

POINT = "struct<x:double,y:double>"
POINTS = f"array<{POINT}>"
#: Keeps a horizontal edge from dividing by zero in the ray test.
EPSILON = 1e-9


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def parse_points(text: Column) -> Column:
    """Points of "x,y;x,y"; parts that are no numbers give null coordinates."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p) != "")
    at = lambda p, i: F.get(F.split(p, ","), F.lit(i)).try_cast("double")
    return F.transform(parts, lambda p: point(at(p, 0), at(p, 1)))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The corners of a box in order."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def _indices(n: Column) -> Column:
    """0 to n - 1; none for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _edges(points: Column, closed: bool) -> Column:
    """The edges of a ring, or of a line, as structs (a, b)."""
    n = F.size(points)
    last = n if closed else n - 1
    following = lambda i: (i + 1) % n if closed else i + 1
    return F.transform(_indices(last), lambda i: F.struct(F.get(points, i).alias("a"), F.get(points, following(i)).alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def area(points: Column, scale: Column | float = 1.0) -> Column:
    """Shoelace area times the square of the scale; null for under three points or no scale."""
    s = number(scale)
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    return F.when((F.size(points) >= 3) & s.isNotNull(), F.abs(_sum(F.transform(_edges(points, True), cross))) / 2 * s * s)


def length(points: Column, scale: Column | float = 1.0) -> Column:
    """The length of a line times the scale; null without a scale."""
    return _sum(F.transform(_edges(points, False), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))) * number(scale)


def mean_point(points: Column) -> Column:
    """The mean of the vertices; null for none."""
    n = F.size(points)
    return F.when(n > 0, point(_sum(F.transform(points, lambda p: p["x"])) / n, _sum(F.transform(points, lambda p: p["y"])) / n))


def bounds(points: Column) -> Column:
    """The box (x0, y0, x1, y1) around points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting, with edges half open in y: the number of edges to the right of the point is odd."""

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        return spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"] + F.lit(EPSILON)) + a["x"])

    return F.size(F.filter(_edges(ring, True), crossed)) % 2 == 1


def _to_segment(px: Column, py: Column, e: Column) -> Column:
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    along = F.coalesce(F.try_divide((px - e["a"]["x"]) * dx + (py - e["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.hypot(px - (e["a"]["x"] + t * dx), py - (e["a"]["y"] + t * dy))


def boundary_distance(points: Column, x: Column, y: Column, closed: bool = True) -> Column:
    """The distance of a point from the nearest edge."""
    return F.array_min(F.transform(_edges(points, closed), lambda e: _to_segment(x, y, e)))


def polygon_distance(ring: Column, x: Column, y: Column) -> Column:
    """The distance of a point from a polygon; 0 inside."""
    return F.when(contains(ring, x, y), F.lit(0.0)).otherwise(boundary_distance(ring, x, y))


def _side(e: Column, p: Column) -> Column:
    return F.signum((e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (p["x"] - e["a"]["x"]))


def _cross(e: Column, f: Column) -> Column:
    return (_side(e, f["a"]) * _side(e, f["b"]) < 0) & (_side(f, e["a"]) * _side(f, e["b"]) < 0)


def polygons_distance(one: Column, other: Column) -> Column:
    """The least distance of two polygons; 0 where they cross or one holds the other."""

    def between(a: Column) -> Column:
        def inner(b: Column) -> Column:
            meets = F.exists(a, lambda e: F.exists(b, lambda f: _cross(e, f)))
            far = lambda points, edges: F.array_min(F.transform(points, lambda p: F.array_min(F.transform(edges, lambda e: _to_segment(p["x"], p["y"], e)))))
            held = contains(one, F.get(other, 0)["x"], F.get(other, 0)["y"]) | contains(other, F.get(one, 0)["x"], F.get(one, 0)["y"])
            return F.when(held | meets, F.lit(0.0)).otherwise(F.least(far(one, b), far(other, a)))

        return let(_edges(other, True), inner)

    return let(_edges(one, True), between)


def rect_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The distance of a point from a box; 0 inside."""
    return F.hypot(x - F.greatest(x0, F.least(x, x1)), y - F.greatest(y0, F.least(y, y1)))


def vertex_distance(points: Column, x: Column, y: Column) -> Column:
    """The distance of a point from the nearest vertex."""
    return F.array_min(F.transform(points, lambda p: F.hypot(p["x"] - x, p["y"] - y)))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1); 0 where both are empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    size = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return F.coalesce(F.try_divide(w * h, size(a) + size(b) - w * h), F.lit(0.0))


def direction_group(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """The 15-degree bucket of a point seen from a centre, as text; `center` within a pixel of it."""
    dx, dy = x - cx, y - cy
    bucket = F.floor(F.degrees(F.atan2(dy, dx)) / 15).cast("string")
    return F.when((F.abs(dx) < 1) & (F.abs(dy) < 1), F.lit("center")).otherwise(bucket)


def clamp_to(points: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Points of a polygon clamped to a box, and moved to its corner; null where that leaves under 3 pixels either way."""
    moved = F.transform(points, lambda p: point(F.greatest(x0, F.least(p["x"], x1)) - x0, F.greatest(y0, F.least(p["y"], y1)) - y0))

    def large(ps: Column) -> Column:
        b = bounds(ps)
        return F.when((b["x1"] - b["x0"] >= 3) & (b["y1"] - b["y0"] >= 3), ps)

    return let(moved, large)


def label_line(cls: Column, points: Column, w: Column, h: Column) -> Column:
    """A training label: the class and the points as parts of width and height, with six decimals, ties to even: a tile's side is a power of two, so there are ties."""
    part = lambda v, whole: F.format_string("%.6f", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / whole)), 6))
    return F.concat_ws(" ", cls.cast("string"), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", part(p["x"], w), part(p["y"], h))), " "))


def net_door_width(opening: Column, frame: float = 0.15) -> Column:
    return F.greatest(F.lit(0.0), opening - frame)
