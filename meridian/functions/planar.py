"""Planar geometry as native column expressions.

A point is a struct (x, y), a ring or line an array of points, a polygon an array of rings with the
exterior first.  Rings needn't be closed: the edge from the last vertex to the first is always there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"
POLYGON = f"array<{RING}>"
#: Tolerances of the predicates.
EPSILON = 1e-9
RELATIVE = 1e-14
TINY = 2.220446049250313e-16


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def edges(ring: Column) -> Column:
    """Edges (x1, y1, x2, y2) of a ring, from each vertex to the next and from the last to the first."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return _edges(ring, following)


def segments(line: Column) -> Column:
    """Segments of a line, without a closing one."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return _edges(F.slice(line, 1, n), F.slice(line, 2, n))


def _edges(a: Column, b: Column) -> Column:
    def edge(p: Column, q: Column) -> Column:
        return F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))

    return F.zip_with(a, b, edge)


def crosses_ray(x: Column, y: Column, e: Column) -> Column:
    """Whether the ray to the right of (x, y) crosses an edge, half-open: left and bottom edges are in, right and top ones out."""
    slope = F.try_divide((e["x1"] - e["x2"]) * (y - e["y2"]), e["y1"] - e["y2"])
    return ((e["y1"] > y) != (e["y2"] > y)) & (x < slope + e["x2"])


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule; a ring of fewer than three vertices holds nothing."""
    odd = F.aggregate(edges(ring), F.lit(False), lambda acc, e: acc != F.coalesce(crosses_ray(x, y, e), F.lit(False)))
    return (F.size(ring) >= 3) & odd


def point_in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """In the exterior and in no hole."""
    holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0)))
    inside = point_in_ring(x, y, F.get(polygon, F.lit(0)))
    return F.coalesce(inside & ~F.exists(holes, lambda r: point_in_ring(x, y, r)), F.lit(False))


def ring_signed_area(ring: Column) -> Column:
    """Shoelace; counter-clockwise is positive; fewer than three vertices have no area."""
    total = F.aggregate(edges(ring), F.lit(0.0), lambda acc, e: acc + (e["x1"] * e["y2"] - e["x2"] * e["y1"]))
    return F.when(F.size(ring) < 3, 0.0).otherwise(total / 2)


def polygon_area(polygon: Column) -> Column:
    """Of the exterior less the holes."""
    holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0)))
    return F.abs(ring_signed_area(F.get(polygon, F.lit(0)))) - F.aggregate(holes, F.lit(0.0), lambda acc, r: acc + F.abs(ring_signed_area(r)))


def multipolygon_area(polygons: Column) -> Column:
    """The sum of the members' areas; overlaps count twice."""
    return F.aggregate(polygons, F.lit(0.0), lambda acc, p: acc + polygon_area(p))


def _moments(ring: Column) -> Column:
    """Sums (a: twice the signed area, mx, my) over the edges."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc: Column, e: Column) -> Column:
        cross = e["x1"] * e["y2"] - e["x2"] * e["y1"]
        return F.struct((acc["a"] + cross).alias("a"), (acc["mx"] + (e["x1"] + e["x2"]) * cross).alias("mx"), (acc["my"] + (e["y1"] + e["y2"]) * cross).alias("my"))

    return F.aggregate(edges(ring), zero, step)


def polygon_centroid(polygon: Column) -> Column:
    """Weighted by area, holes subtracted; null where the area is zero."""
    sums = F.transform(polygon, _moments)
    # each ring counts with the sign of its part: exterior plus, holes minus
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"), F.lit(1.0).alias("s"))

    def step(acc: Column, r: Column) -> Column:
        s = acc["s"] * F.when(r["a"] < 0, -1.0).otherwise(1.0)
        return F.struct((acc["a"] + s * r["a"]).alias("a"), (acc["mx"] + s * r["mx"]).alias("mx"), (acc["my"] + s * r["my"]).alias("my"), F.lit(-1.0).alias("s"))

    return F.aggregate(sums, zero, step, lambda t: F.when(F.abs(t["a"]) > TINY, point(t["mx"] / (3 * t["a"]), t["my"] / (3 * t["a"]))))


def bbox(points: Column) -> Column:
    """Envelope (xmin, ymin, xmax, ymax) of points; null if there are none."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    box = F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))
    return F.when(F.size(points) > 0, box)


def lines_bbox(lines: Column) -> Column:
    """Of an array of lines."""
    return bbox(F.flatten(lines))


def multipolygon_bbox(polygons: Column) -> Column:
    """Of the exteriors of an array of polygons."""
    return bbox(F.flatten(F.transform(polygons, lambda p: F.coalesce(F.get(p, F.lit(0)), F.array().cast(RING)))))


def lines_length(lines: Column) -> Column:
    """Of an array of lines, together."""
    return F.aggregate(lines, F.lit(0.0), lambda acc, line: acc + line_length(line))


def polygon_bbox(polygon: Column) -> Column:
    """Of the exterior."""
    return bbox(F.get(polygon, F.lit(0)))


def is_box(polygon: Column) -> Column:
    """Whether a polygon is one ring of four corners with sides along the axes, so that its box says all about it."""
    corner = lambda k: F.get(F.get(polygon, F.lit(0)), F.lit(k))
    far = lambda p, q: (p["x"] != q["x"]) & (p["y"] != q["y"])
    straight = F.forall(edges(F.get(polygon, F.lit(0))), lambda e: ((e["x1"] == e["x2"]) | (e["y1"] == e["y2"])) & (e["x1"] - e["x2"] + e["y1"] - e["y2"]).between(-1e308, 1e308))
    return F.coalesce((F.size(polygon) == 1) & (F.size(F.get(polygon, F.lit(0))) == 4) & far(corner(0), corner(2)) & far(corner(1), corner(3)) & straight, F.lit(False))


def box_contains(box: Column, x: Column, y: Column) -> Column:
    return (x >= box["xmin"]) & (x <= box["xmax"]) & (y >= box["ymin"]) & (y <= box["ymax"])


def boxes_intersect(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def box_union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["xmin"], b["xmin"]).alias("xmin"), F.least(a["ymin"], b["ymin"]).alias("ymin"), F.greatest(a["xmax"], b["xmax"]).alias("xmax"), F.greatest(a["ymax"], b["ymax"]).alias("ymax"))


def box_distance(box: Column, x: Column, y: Column) -> Column:
    """From a point to a box; 0 inside."""
    dx = F.greatest(box["xmin"] - x, F.lit(0.0), x - box["xmax"])
    dy = F.greatest(box["ymin"] - y, F.lit(0.0), y - box["ymax"])
    return F.sqrt(dx * dx + dy * dy)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def closest_on_segment(x: Column, y: Column, e: Column) -> Column:
    """The nearest point of a segment; a segment without length is its first end."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    square = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, square)))
    t = F.when(square < TINY, 0.0).otherwise(t)
    return point(e["x1"] + t * dx, e["y1"] + t * dy)


def distance_to_segment(x: Column, y: Column, e: Column) -> Column:
    p = closest_on_segment(x, y, e)
    return distance(x, y, p["x"], p["y"])


def distance_to_line(x: Column, y: Column, line: Column) -> Column:
    """Smallest over the segments; an empty line is at 0, a single point at its own distance."""
    first = F.get(line, F.lit(0))
    least = F.array_min(F.transform(segments(line), lambda e: distance_to_segment(x, y, e)))
    return F.when(F.size(line) == 0, 0.0).when(F.size(line) == 1, distance(x, y, first["x"], first["y"])).otherwise(least)


def line_length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda acc, e: acc + distance(e["x1"], e["y1"], e["x2"], e["y2"]))


def nearest_boundary(x: Column, y: Column, polygon: Column) -> Column:
    """(d, x, y) of the closest point on any ring; the first edge wins ties."""
    all_edges = F.flatten(F.transform(polygon, edges))

    def near(e: Column, i: Column) -> Column:
        p = closest_on_segment(x, y, e)
        return F.struct(distance(x, y, p["x"], p["y"]).alias("d"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))

    return F.array_min(F.transform(all_edges, near))


def distance_to_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """0 inside, else to the nearest edge of any ring; without edges infinite."""
    near = F.array_min(F.transform(F.flatten(F.transform(polygon, edges)), lambda e: distance_to_segment(x, y, e)))
    return F.when(point_in_polygon(x, y, polygon), 0.0).otherwise(F.coalesce(near, F.lit(float("inf"))))


def orientation(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    """0 collinear (relative tolerance), 1 clockwise, 2 counter-clockwise."""
    v = (qy - py) * (rx - qx) - (qx - px) * (ry - qy)
    scale = (F.abs(qx - px) + F.abs(qy - py)) * (F.abs(rx - qx) + F.abs(ry - qy))
    return F.when(F.abs(v) <= EPSILON * scale, 0).when(v > 0, 1).otherwise(2)


def _in_box(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column, tol: Column) -> Column:
    """Whether q lies in the box of p and r."""
    return (qx <= F.greatest(px, rx) + tol) & (qx >= F.least(px, rx) - tol) & (qy <= F.greatest(py, ry) + tol) & (qy >= F.least(py, ry) - tol)


def tolerance(*coordinates: Column) -> Column:
    return F.greatest(F.lit(EPSILON), F.lit(RELATIVE) * F.greatest(*[F.abs(c) for c in coordinates]))


def segments_intersect(a: Column, b: Column) -> Column:
    """Touching counts."""
    p1, q1, p2, q2 = ((a["x1"], a["y1"]), (a["x2"], a["y2"]), (b["x1"], b["y1"]), (b["x2"], b["y2"]))
    o1, o2, o3, o4 = orientation(*p1, *q1, *p2), orientation(*p1, *q1, *q2), orientation(*p2, *q2, *p1), orientation(*p2, *q2, *q1)
    tol = tolerance(*p1, *q1, *p2, *q2)
    return (
        ((o1 != o2) & (o3 != o4))
        | ((o1 == 0) & _in_box(*p1, *p2, *q1, tol))
        | ((o2 == 0) & _in_box(*p1, *q2, *q1, tol))
        | ((o3 == 0) & _in_box(*p2, *p1, *q2, tol))
        | ((o4 == 0) & _in_box(*p2, *q1, *q2, tol))
    )


def segment_intersection(a: Column, b: Column) -> Column:
    """The meeting point of two segments that cross properly or touch; null if parallel or apart."""
    dx1, dy1, dx2, dy2 = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
    denominator = dx1 * dy2 - dy1 * dx2
    t = F.try_divide((b["x1"] - a["x1"]) * dy2 - (b["y1"] - a["y1"]) * dx2, denominator)
    u = F.try_divide((b["x1"] - a["x1"]) * dy1 - (b["y1"] - a["y1"]) * dx1, denominator)
    return F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), point(a["x1"] + t * dx1, a["y1"] + t * dy1))


def any_segments_meet(a: Column, b: Column) -> Column:
    """Whether any edge of array ``a`` meets any of ``b``."""
    return F.exists(a, lambda e: F.exists(b, lambda f: segments_intersect(e, f)))


def lines_intersect(a: Column, b: Column) -> Column:
    return any_segments_meet(segments(a), segments(b))


def polygons_intersect(a: Column, b: Column) -> Column:
    """Touching counts: boxes first, then edges, then one inside the other."""
    boxes = boxes_intersect(polygon_bbox(a), polygon_bbox(b))
    meet = any_segments_meet(F.flatten(F.transform(a, edges)), F.flatten(F.transform(b, edges)))
    pa, pb = F.get(F.get(a, F.lit(0)), F.lit(0)), F.get(F.get(b, F.lit(0)), F.lit(0))
    return boxes & (meet | point_in_polygon(pa["x"], pa["y"], b) | point_in_polygon(pb["x"], pb["y"], a))


def line_intersects_polygon(line: Column, polygon: Column) -> Column:
    """A vertex inside, or a segment that meets a ring."""
    inside = F.exists(line, lambda p: point_in_polygon(p["x"], p["y"], polygon))
    return inside | any_segments_meet(segments(line), F.flatten(F.transform(polygon, edges)))
