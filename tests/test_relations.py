"""Relations of lines and polygons, validity, rasters on other grids and geofences on cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from meridian.functions import overlay, relate
from meridian.functions.escape import check_position
from meridian.raster import band as B
from meridian.sources.tables import csv_projection

RING = "array<struct<x:double,y:double>>"
SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
HOLED = [SQUARE, [(4, 4), (6, 4), (6, 6), (4, 6)]]


def pts(line):
    return [{"x": float(x), "y": float(y)} for x, y in line]


def shape(rings):
    return [pts(r) for r in rings]


def moved(ring, dx, dy=0):
    return [(x + dx, y + dy) for x, y in ring]


def test_lines_against_lines(spark):
    cases = [
        ([(0, 0), (2, 2)], [(0, 2), (2, 0)], True, False),  # an X
        ([(0, 0), (1, 1)], [(1, 1), (2, 0)], False, False),  # end to end
        ([(0, 0), (2, 0)], [(1, 0), (1, 1)], False, False),  # a T: the end of one
        ([(0, 0), (3, 0)], [(1, 0), (5, 0)], False, False),  # a shared stretch
        ([(1, 0), (2, 0)], [(0, 0), (5, 0)], False, True),
        ([(1, 0), (2, 0)], [(0, 0), (1.5, 0), (5, 0)], False, True),
        ([(0, 0), (2, 0), (2, 2)], [(0, 0), (2, 0)], False, False),
        ([(0, 0), (4, 4)], [(2, 0), (2, 2), (4, 0)], True, False),  # through a middle vertex
        ([(0, 0)], [(0, 0), (1, 1)], False, False),
        ([], [(0, 0), (1, 1)], False, False),
    ]
    df = spark.createDataFrame([(i, pts(a), pts(b), c, w) for i, (a, b, c, w) in enumerate(cases)], f"i int, a {RING}, b {RING}, c boolean, w boolean")
    got = df.select("i", "c", "w", relate.linestrings_cross(F.col("a"), F.col("b")).alias("gc"), relate.line_within_line(F.col("a"), F.col("b")).alias("gw"), relate.linestrings_cross(F.col("b"), F.col("a")).alias("back"))
    assert [(r.gc, r.gw, r.back) for r in got.orderBy("i").collect()] == [(c, w, c) for *_, c, w in cases]


def test_lines_against_polygons(spark):
    cases = [
        ([(-1, 5), (11, 5)], True, False),
        ([(1, 1), (3, 3)], False, True),
        ([(1, 5), (9, 5)], True, False),  # over the hole
        ([(0, 0), (10, 0)], False, False),  # along the edge
        ([(0, 0), (3, 3)], False, True),  # starts on a corner
        ([(20, 20), (30, 30)], False, False),
        ([(4, 4), (6, 4)], False, False),  # along the hole
    ]
    df = spark.createDataFrame([(i, pts(a), shape(HOLED)) for i, (a, _, _) in enumerate(cases)], f"i int, a {RING}, p array<{RING}>")
    got = df.select("i", relate.line_crosses_polygon(F.col("a"), F.col("p")).alias("c"), relate.line_within_polygon(F.col("a"), F.col("p")).alias("w"))
    assert [(r.c, r.w) for r in got.orderBy("i").collect()] == [(c, w) for _, c, w in cases]


def test_matrices_of_polygons(spark):
    cases = [
        ([SQUARE], [SQUARE], "2FFF1FFF2"),
        ([SQUARE], [moved(SQUARE, 20)], "FF2FF1212"),
        ([SQUARE], [moved(SQUARE, 10)], "FF2F11212"),  # a shared side
        ([SQUARE], [moved(SQUARE, 10, 10)], "FF2F01212"),  # a shared corner
        ([SQUARE], [moved(SQUARE, 5, 5)], "212101212"),
        ([SQUARE], [[(2, 2), (3, 2), (3, 3), (2, 3)]], "212FF1FF2"),
        ([SQUARE], [[(0, 2), (3, 2), (3, 3), (0, 3)]], "212F11FF2"),
        (HOLED, [[(4, 4), (6, 4), (6, 6), (4, 6)]], "FF2F112F2"),  # in the hole, filling it
        (HOLED, [[(4.5, 4.5), (5.5, 4.5), (5.5, 5.5), (4.5, 5.5)]], "FF2FF1212"),
    ]
    df = spark.createDataFrame([(i, shape(a), shape(b)) for i, (a, b, _) in enumerate(cases)], f"i int, a array<{RING}>, b array<{RING}>")
    matrix = lambda a, b: relate.relate_polygons(F.col(a), F.col(b))
    rows = df.select("i", matrix("a", "b").alias("m"), matrix("b", "a").alias("t")).orderBy("i").collect()
    assert [r.m for r in rows] == [m for *_, m in cases]
    assert [r.t for r in rows] == ["".join(m[3 * j + i] for i in range(3) for j in range(3)) for *_, m in cases]
    one = spark.createDataFrame([("212F11FF2",)], "m string")
    fits = one.select(*[relate.matches(F.col("m"), p).alias(f"c{k}") for k, p in enumerate(["T*****FF*", "2*2F*1**2", "F********", "T*****FF", "T*****FFx"])]).first()
    assert list(fits) == [True, True, False, False, False]
    assert one.select(relate.dimension(F.col("m"), "boundary", "interior")).first()[0] == -1


def test_validity_and_containment(spark):
    closed = lambda ring: [*ring, ring[0]]
    cases = [
        ([closed(SQUARE)], True),
        ([SQUARE], False),
        ([closed([(0, 0), (10, 10), (10, 0), (0, 10)])], False),  # a bow tie
        ([closed([(0, 0), (5, 0), (10, 0)])], False),  # no area
        ([closed(r) for r in HOLED], True),
        ([closed(SQUARE), closed([(8, 8), (12, 8), (12, 9), (8, 9)])], False),
        ([closed(SQUARE), closed([(20, 20), (21, 20), (21, 21)])], False),
        ([[]], False),
        ([], False),
    ]
    df = spark.createDataFrame([(i, shape(p)) for i, (p, _) in enumerate(cases)], f"i int, p array<{RING}>")
    assert [bool(r.v) for r in df.select("i", relate.is_valid(F.col("p")).alias("v")).orderBy("i").collect()] == [v for _, v in cases]
    pairs = [([SQUARE], [SQUARE], True), ([SQUARE], [[(0, 2), (3, 2), (3, 3)]], True), (HOLED, [[(3, 3), (7, 3), (7, 7), (3, 7)]], False), (HOLED, [[(1, 1), (3, 1), (3, 3)]], True), ([SQUARE], [moved(SQUARE, 1)], False)]
    df = spark.createDataFrame([(i, shape(a), shape(b)) for i, (a, b, _) in enumerate(pairs)], f"i int, a array<{RING}>, b array<{RING}>")
    assert [r.v for r in df.select("i", relate.polygon_contains_polygon(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()] == [v for *_, v in pairs]
    df = spark.createDataFrame([(shape(HOLED),)], f"p array<{RING}>")
    at = lambda f, x, y: f(F.lit(float(x)), F.lit(float(y)), F.col("p"))
    got = df.select(*[at(f, x, y).alias(f"{f.__name__}{x}{y}") for f in (relate.covers_point, relate.strictly_inside, relate.on_boundary) for x, y in ((10, 5), (1, 1), (5, 5), (4, 5))]).first()
    assert list(got) == [True, True, False, True, False, True, False, False, True, False, False, True]


@pytest.mark.parametrize("method", ["nearest", "bilinear", "average"])
def test_rasters_on_other_grids(spark, method):
    w, h, nodata = 7, 5, -1.0
    value = {(x, y): nodata if (x, y) == (3, 2) else float(x * 10 + y) for x in range(w) for y in range(h)}
    meta = B.BandMeta(w, h, nodata=nodata, transform=B.GeoTransform(100.0, 50.0, 2.0, 3.0))
    cells = spark.createDataFrame([(x, y, v) for (x, y), v in value.items()], "x int, y int, v double")
    target = B.BandMeta(6, 6, transform=B.GeoTransform(99.0, 51.0, 2.5, 2.5))
    got = {(r.x, r.y): r.v for r in B.resample_to(cells, meta, target, method).collect()}
    valid = lambda x, y: None if value[x, y] == nodata else value[x, y]

    def plain(tx, ty):
        fx, fy = (99 + (tx + 0.5) * 2.5 - 100) / 2, (50 - (51 - (ty + 0.5) * 2.5)) / 3
        if method == "average":
            edge = lambda f, n: min(max(f, 0), n)
            x0, x1 = (99 + tx * 2.5 - 100) / 2, (99 + (tx + 1) * 2.5 - 100) / 2
            y0, y1 = (ty * 2.5 - 1) / 3, ((ty + 1) * 2.5 - 1) / 3
            a, b = edge(math.floor(x0), w - 1), edge(math.floor(y0), h - 1)
            found = [valid(x, y) for x in range(a, max(edge(max(math.ceil(x1), 1), w), a + 1)) for y in range(b, max(edge(max(math.ceil(y1), 1), h), b + 1))]
            found = [v for v in found if v is not None]
            return sum(found) / len(found) if found else nodata
        if not (0 <= fx < w and 0 <= fy < h):
            return nodata
        if method == "nearest":
            return value[int(fx), int(fy)]
        split = lambda f, n: (0, 0.0) if f <= 0.5 else (n - 1, 0.0) if f - 0.5 >= n - 1 else (int(f - 0.5), f - 0.5 - int(f - 0.5))
        (ix, dx), (iy, dy) = split(fx, w), split(fy, h)
        four = [(valid(min(ix + i, w - 1), min(iy + j, h - 1)), (dx if i else 1 - dx) * (dy if j else 1 - dy)) for i in (0, 1) for j in (0, 1)]
        return nodata if any(v is None for v, _ in four) else sum(v * k for v, k in four)

    assert got == {(x, y): pytest.approx(plain(x, y)) for x in range(6) for y in range(6)}
    assert meta.extent == (100.0, 35.0, 114.0, 50.0)
    if method == "average":
        blocks = {(r.x, r.y): r.v for r in B.overview(cells, meta, 2).collect()}
        assert blocks == {(r.x, r.y): pytest.approx(r.v) for r in B.downsample(cells, meta, 2).collect()}
    with pytest.raises(ValueError):
        B.resample(cells, meta, 0, 3)


def test_positions_against_a_zone(spark):
    zone = pts([(-122.42, 37.77), (-122.40, 37.77), (-122.40, 37.79), (-122.42, 37.79), (-122.42, 37.77)])
    df = spark.createDataFrame([(0, 37.775, -122.415, zone), (1, 37.760, -122.430, zone)], f"i int, lat double, lon double, zone {RING}")
    inside, outside = [r.c for r in df.select("i", check_position(F.col("lat"), F.col("lon"), F.col("zone")).alias("c")).orderBy("i").collect()]
    assert inside.breached and not outside.breached and outside.bearing is None and outside.distance is None
    assert abs(inside.bearing - 270) < 0.01 and abs(inside.distance - 440.4) < 1  # 0.005 degrees to the west; 555 m to the south


def test_columns_of_properties(spark):
    df = spark.createDataFrame([(1.0, 2.0, {"b": "x", "a.c": "y"}), (3.0, 4.0, {"b": "z"}), (5.0, 6.0, None)], "x double, y double, p map<string,string>")
    out = csv_projection(df, "p")
    assert out.columns == ["x", "y", "a.c", "b"]
    assert sorted(map(tuple, out.collect())) == [(1.0, 2.0, "y", "x"), (3.0, 4.0, None, "z"), (5.0, 6.0, None, None)]
