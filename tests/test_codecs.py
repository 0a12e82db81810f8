"""Codecs, shapes and systems against known values; no Spark where none is needed."""

import math
import random
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridian.crs import registry
from meridian.crs.ellipsoid import WGS84
from meridian.functions import planar, udf
from meridian.sources import codecs

number = st.floats(-1e6, 1e6, allow_nan=False)
point = st.tuples(number, number)
line = st.lists(point, min_size=2, max_size=5).map(tuple)
polygon = st.lists(line, min_size=1, max_size=3).map(tuple)
simple = st.one_of(
    point.map(lambda c: ("Point", c)),
    line.map(lambda c: ("LineString", c)),
    polygon.map(lambda c: ("Polygon", c)),
    line.map(lambda c: ("MultiPoint", c)),
    polygon.map(lambda c: ("MultiLineString", c)),
    st.lists(polygon, min_size=1, max_size=2).map(lambda c: ("MultiPolygon", tuple(c))),
)
geometry = st.one_of(simple, st.lists(simple, min_size=1, max_size=3).map(lambda c: ("GeometryCollection", tuple(c))))


@given(geometry)
def test_codecs_round_trip(g):
    assert codecs.from_wkt(codecs.to_wkt(g)) == g
    assert codecs.from_wkb(codecs.to_wkb(g)) == g
    assert codecs.from_geojson(codecs.to_geojson(g)) == g


@pytest.mark.parametrize("text", ["POINT (1)", "POINT (1 2) x", "POINT EMPTY", "LINESTRING ((1 2))", "CIRCLE (1 2)", "POINT (1 1e999)", "", "POLYGON ((1 2, 3 4)"])
def test_malformed_text_is_refused(text):
    with pytest.raises(ValueError):
        codecs.from_wkt(text)


def test_extra_ordinates_and_headers():
    assert codecs.from_wkt("srid=4326;Point zm (1 2 3 4)") == ("Point", (1.0, 2.0))
    assert codecs.from_wkt("MULTIPOINT (1 2, 3 4)") == codecs.from_wkt("multipoint ((1 2), (3 4))")
    big = struct.pack(">BIIddd", 0, 0x80000001 | 0x20000000, 4326, 1.0, 2.0, 3.0)
    assert codecs.from_wkb(big) == ("Point", (1.0, 2.0))
    assert codecs.decode_type_code(3006) == (6, 2, False)
    with pytest.raises(ValueError):
        codecs.from_wkb(codecs.to_wkb(("Point", (1, 2))) + b"x")
    deep = ("Point", (0.0, 0.0))
    for _ in range(40):
        deep = ("GeometryCollection", (deep,))
    with pytest.raises(ValueError):
        codecs.from_wkb(codecs.to_wkb(deep))


def plain_hull(points):
    """The corners: points that some line through another has all others on its left, less those between two of them."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    cross = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    edges = [(a, b) for a in points for b in points if a != b and all(cross(a, b, p) > 0 or (cross(a, b, p) == 0 and min(a, b) <= p <= max(a, b)) for p in points)]
    following = dict(edges)
    ring = [points[0]]
    while following[ring[-1]] != ring[0]:
        ring.append(following[ring[-1]])
    return ring


def plain_simplify(points, tolerance):
    """Douglas and Peucker by recursion."""
    if len(points) < 3:
        return points

    def off(p, a, b):
        d = (b[0] - a[0], b[1] - a[1])
        s = d[0] ** 2 + d[1] ** 2
        t = min(1, max(0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / s)) if s else 0
        return math.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1])

    far = [off(p, points[0], points[-1]) for p in points[1:-1]]
    k = far.index(max(far)) + 1
    return plain_simplify(points[: k + 1], tolerance)[:-1] + plain_simplify(points[k:], tolerance) if far[k - 1] > tolerance else [points[0], points[-1]]


def test_hulls_and_simplified_lines_of_many_rows(spark):
    rng = random.Random(1)
    lines = [[(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(rng.randint(1, 14))] for _ in range(150)] + [[(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(200)]]
    lines += [[], [(1, 1)], [(1, 1), (1, 1)], [(0, 0), (1, 1), (2, 2), (3, 3)], [(math.cos(t), math.sin(t)) for t in range(300)]]
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in line]) for i, line in enumerate(lines)] + [(len(lines), None)], "i int, p array<struct<x:double,y:double>>")
    got = df.select("i", udf.st_convexhull(F.col("p")).alias("h"), udf.st_simplify(F.col("p"), 1.5).alias("s")).orderBy("i").collect()
    assert got[-1].h is None and got[-1].s is None
    for row, line in zip(got, lines, strict=False):
        assert [(p.x, p.y) for p in row.s] == plain_simplify(line, 1.5)
        hull, want = [(p.x, p.y) for p in row.h], plain_hull([(float(x), float(y)) for x, y in line])
        assert hull == want


def test_measures_of_any_geometry(spark):
    texts = ["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 7 5, 7 7, 5 7, 5 5)))", "MULTILINESTRING ((0 0, 3 4), (1 1, 1 2))", "GEOMETRYCOLLECTION (POINT (9 -9), LINESTRING (0 0, 0 2), MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0))))"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [tuple(r.m) for r in df.select("i", udf.st_measures(udf.st_geomfromtext(F.col("t"))).alias("m")).orderBy("i").collect()]
    assert got == [(15, 0, 0, 0, 4, 4), (5, 0, 0, 0, 7, 7), (0, 6, 0, 0, 3, 4), (1, 2, 0, -9, 9, 2)]
    point = lambda *p: F.array(*[planar.point(F.lit(float(x)), F.lit(float(y))) for x, y in p])
    lines = F.array(point((0, 0), (3, 4)), point((1, 7)))
    polygons = F.array(F.array(point((0, 0), (4, 0), (4, 4))), F.array(point((-1, 2), (0, 2), (0, 9))))
    row = spark.range(1).select(planar.lines_length(lines).alias("n"), planar.lines_bbox(lines).alias("l"), planar.multipolygon_bbox(polygons).alias("p")).first()
    assert row.n == 5 and tuple(row.l) == (0, 0, 3, 7) and tuple(row.p) == (-1, 0, 4, 9)


def test_names_of_systems():
    assert [registry.parse_crs(t) for t in ("Web-Mercator", "EPSG:2154", "utm-33n", "UTM-7S")] == [3857, 2154, 32633, 32707]
    for bad in ("epsg:1", "utm-61n", "x"):
        with pytest.raises(ValueError):
            registry.parse_crs(bad)
    assert math.isclose(WGS84.b, 6356752.314245, abs_tol=1e-6)
