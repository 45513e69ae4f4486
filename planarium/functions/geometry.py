"""Polygon expressions over ARRAY<STRUCT<x, y>> columns; everything stays in the JVM.

Polygons are open rings (the last vertex joins the first).  Clipping and
intersection expect convex counter-clockwise rings; `counter_clockwise` turns
a ring round where its signed area is negative.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(c: str):
    return lambda p: p[c]


def following(poly: Column) -> Column:
    """The ring turned by one: the successor of each vertex."""
    return F.when(F.size(poly) > 0, F.concat(F.slice(poly, F.lit(2), F.greatest(F.size(poly) - 1, F.lit(0))), F.slice(poly, 1, 1))).otherwise(poly)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def signed_area(poly: Column) -> Column:
    return let(poly, lambda v: _sum(F.zip_with(v, following(v), _cross)) / 2)


def area(poly: Column) -> Column:
    """Shoelace area."""
    return F.abs(signed_area(poly))


def perimeter(poly: Column) -> Column:
    step = lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
    return let(poly, lambda v: _sum(F.zip_with(v, following(v), step)))


def hull_features(poly: Column) -> Column:
    """Struct (area, perimeter, circularity); NaN without a polygon of three vertices."""
    flat = poly.isNull() | (F.size(poly) < 3)
    a, p = F.when(~flat, area(poly)).otherwise(F.lit(NAN)), F.when(~flat, perimeter(poly)).otherwise(F.lit(NAN))
    return F.struct(a.alias("area"), p.alias("perimeter"), F.when(flat | (p == 0), F.lit(NAN)).otherwise(4 * math.pi * a / F.nullif(p * p, F.lit(0.0))).alias("circularity"))


def centroid(poly: Column) -> Column:
    """Area centroid; NaN below three vertices or without area."""
    a = signed_area(poly)
    ok = poly.isNotNull() & (F.size(poly) >= 3) & (F.abs(a) > 0)
    part = lambda c: _sum(F.zip_with(poly, following(poly), lambda p, q: (p[c] + q[c]) * _cross(p, q)))
    return point(*(F.when(ok, part(c) / F.nullif(6 * a, F.lit(0.0))).otherwise(F.lit(NAN)) for c in "xy"))


def vertex_mean(poly: Column) -> Column:
    return point(*(_sum(F.transform(poly, _at(c))) / F.nullif(F.size(poly), F.lit(0)) for c in "xy"))


def equivalent_diameter(poly: Column) -> Column:
    """Diameter of the disc of equal area."""
    return 2 * F.sqrt(area(poly) / math.pi)


def scaled(poly: Column, x: Column, y: Column, factor: Column) -> Column:
    """Scaled about (x, y)."""
    return F.transform(poly, lambda p: point(x + (p["x"] - x) * factor, y + (p["y"] - y) * factor))


def scaled_to_diameter(poly: Column, x: Column, y: Column, diameter: Column) -> Column:
    """Scaled about (x, y) to an equivalent diameter; unchanged without area."""
    d = equivalent_diameter(poly)
    return F.when(d > 0, scaled(poly, x, y, diameter / F.nullif(d, F.lit(0.0)))).otherwise(poly)


def clamped(poly: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Each vertex moved into (x0, x1, y0, y1)."""
    x0, x1, y0, y1 = map(F.lit, bounds)
    return F.transform(poly, lambda p: point(F.least(F.greatest(p["x"], x0), x1), F.least(F.greatest(p["y"], y0), y1)))


def counter_clockwise(poly: Column) -> Column:
    return F.when(signed_area(poly) < 0, F.reverse(poly)).otherwise(poly)


def _half_plane(poly: Column, side) -> Column:
    """The part of a ring where side(vertex) >= 0."""

    def step(edge: Column) -> Column:
        p, q = edge["p"], edge["q"]
        a, b = side(p), side(q)
        t = a / F.nullif(a - b, F.lit(0.0))
        cut = point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))
        none = F.slice(F.array(cut), 1, 0)
        return F.when((a >= 0) & (b >= 0), F.array(q)).when((a >= 0) & (b < 0), F.array(cut)).when(b >= 0, F.array(cut, q)).otherwise(none)

    return F.flatten(F.transform(F.zip_with(poly, following(poly), lambda p, q: F.struct(p.alias("p"), q.alias("q"))), step))


def clipped_to_box(poly: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Intersection with (x0, x1, y0, y1); null if fewer than three vertices remain."""
    x0, x1, y0, y1 = bounds
    sides = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in ((1.0, 0.0, -x0), (-1.0, 0.0, x1), (0.0, 1.0, -y0), (0.0, -1.0, y1))))
    out = F.aggregate(sides, poly, lambda acc, s: _half_plane(acc, lambda p: s["a"] * p["x"] + s["b"] * p["y"] + s["c"]))
    return let(out, lambda v: F.when(F.size(v) >= 3, v))


def intersection(a: Column, b: Column) -> Column:
    """Intersection ring of two convex counter-clockwise rings (fewer than three vertices: none)."""
    edges = F.zip_with(b, following(b), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    side = lambda e: lambda v: (e["q"]["x"] - e["p"]["x"]) * (v["y"] - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (v["x"] - e["p"]["x"])
    return F.aggregate(edges, a, lambda acc, e: _half_plane(acc, side(e)))


def with_corner(poly: Column, x: Column, y: Column, bounds: tuple[float, float, float, float], tolerance: float = 0.01) -> Column:
    """A ring that touches two adjacent sides of the box gets their corner; vertices are sorted by angle about (x, y)."""
    x0, x1, y0, y1 = bounds
    near = lambda c, v: lambda p: F.abs(p[c] - v) < tolerance
    corners = []
    for cx in (x0, x1):
        for cy in (y0, y1):
            a, b = near("x", cx), near("y", cy)
            missing = F.exists(poly, a) & F.exists(poly, b) & ~F.exists(poly, (lambda a, b: lambda p: a(p) & b(p))(a, b))
            corners.append(F.when(missing, point(F.lit(cx), F.lit(cy))))
    new = F.array_compact(F.array(*corners))
    turned = lambda v: F.transform(F.array_sort(F.transform(v, lambda p: F.struct(F.atan2(p["y"] - y, p["x"] - x).alias("angle"), p.alias("p")))), lambda s: s["p"])
    return let(new, lambda n: F.when(F.size(n) > 0, turned(F.concat(poly, n))).otherwise(poly))


def dilated(poly: Column, fraction: float, segments: int = 16) -> Column:
    """A convex counter-clockwise ring moved outwards by fraction * equivalent diameter, corners rounded by arcs."""
    if fraction <= 0:
        return poly
    r = equivalent_diameter(poly) * fraction
    n = F.size(poly)

    def arc(i: Column) -> Column:
        p, q, s = F.get(poly, (i + n - 1) % n), F.get(poly, i), F.get(poly, (i + 1) % n)
        first = F.atan2(-(q["x"] - p["x"]), q["y"] - p["y"])
        last = F.atan2(-(s["x"] - q["x"]), s["y"] - q["y"])
        turn = F.pmod(last - first, F.lit(2 * math.pi))
        steps = F.greatest(F.ceil(turn / (math.pi / 2 / segments)), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), steps), lambda k: point(q["x"] + r * F.cos(first + turn * k / steps), q["y"] + r * F.sin(first + turn * k / steps)))

    return F.when(r > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), arc))).otherwise(poly)


def inside(poly: Column, x: Column, y: Column) -> Column:
    """Is (x, y) in a convex counter-clockwise ring, its border included?"""
    return F.forall(F.zip_with(poly, following(poly), lambda p, q: (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])), lambda s: s >= -1e-12)


def kept_in_box(poly: Column, x: Column, y: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Is the centre in the closed box, and something of the ring too?"""
    x0, x1, y0, y1 = bounds
    return x.between(x0, x1) & y.between(y0, y1) & clipped_to_box(poly, bounds).isNotNull()


def crosses_box(poly: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Does a vertex lie outside of the box, so that clipping changes the ring?"""
    x0, x1, y0, y1 = bounds
    return F.exists(poly, lambda p: ~(p["x"].between(x0, x1) & p["y"].between(y0, y1)))


def convex_hull(points: Column) -> Column:
    """Counter-clockwise hull of an array of points, by the lower and the upper chain; null below three vertices."""
    left = lambda a, b, p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

    def chain(sorted_: Column) -> Column:
        """One side of the hull: each point drops those before it that don't turn left; `n` times at most, one a step."""

        def add(acc: Column, p: Column) -> Column:
            pop = lambda a, _: F.when((F.size(a) >= 2) & (left(F.element_at(a, -2), F.element_at(a, -1), p) <= 0), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)
            return F.concat(F.aggregate(acc, acc, pop), F.array(p))

        none = F.slice(sorted_, F.lit(1), F.lit(0))
        return F.aggregate(sorted_, none, add)

    part = lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))
    ordered = F.array_sort(F.array_distinct(points))
    return let(ordered, lambda v: let(F.concat(part(chain(v)), part(chain(F.reverse(v)))), lambda h: F.when(F.size(h) >= 3, h)))
