"""Literal values of cell ids, edges of rasters and zones; plans that don't grow with chained transforms."""

import math

import pytest
from pyspark.sql import functions as F

from meridian.crs import projections, registry
from meridian.functions import geodesic, s2
from meridian.raster import band as B


def test_opposite_faces_share_their_quotients(spark):
    rows = spark.createDataFrame([(10.0, 170.0), (10.0, -10.0), (-80.0, 40.0), (0.0, -91.0)], "lat double, lon double")
    f, u, v = s2.face_uv(F.col("lat"), F.col("lon"))
    got = [(r.f, r.u, r.v) for r in rows.select(f.alias("f"), u.alias("u"), v.alias("v")).collect()]
    assert [g[0] for g in got] == [3, 0, 5, 4]
    assert got[0][1:] == pytest.approx((-0.17632698, -0.17904710), abs=1e-7)


def test_centres_lie_in_their_cells_on_every_face(spark):
    rows = spark.createDataFrame([(float(a), float(o)) for a in range(-85, 90, 17) for o in range(-175, 180, 25)], "lat double, lon double")
    cells = rows.withColumn("cell", s2.cell_at(F.col("lat"), F.col("lon"), 12)).select("cell")
    centres = spark.createDataFrame(s2.with_center(cells).collect(), "cell long, lat double, lon double")  # not one expression
    assert centres.where(s2.cell_at(F.col("lat"), F.col("lon"), 12) != F.col("cell")).count() == 0
    out = spark.createDataFrame([(100.0, 0.0), (0.0, 181.0), (math.nan, 0.0)], "lat double, lon double")
    assert out.where(s2.cell_at(F.col("lat"), F.col("lon")).isNotNull()).count() == 0


def test_edge_samples_need_the_edge_cell_alone(spark):
    m = B.BandMeta(2, 1, nodata=-1.0, transform=B.GeoTransform(0.0, 1.0, 1.0, 1.0))
    cells = spark.createDataFrame([(0, 0, -1.0), (1, 0, 8.0)], "x int, y int, v double")
    at = spark.createDataFrame([(1, 1.7, 0.5), (2, 1.2, 0.5), (3, 2.0, 0.5)], "k long, wx double, wy double")
    assert {r.k: r.v for r in B.sample_bilinear(at, cells, m, "k").collect()} == {1: 8.0, 2: None, 3: None}


def test_svalbard_ends_before_84(spark):
    rows = spark.createDataFrame([(83.9, 8.0), (84.0, 8.0)], "lat double, lon double")
    assert [r[0] for r in rows.select(projections.utm_zone(F.col("lat"), F.col("lon"))).collect()] == [31, 32]


def test_chained_datum_shifts_have_short_plans(spark):
    x, y = F.col("lon"), F.col("lat")
    for source, target in ((4326, 27700), (27700, 4326)):
        x, y = registry.transform(source, target, x, y)
    plan = spark.createDataFrame([(52.0, -1.0)], "lat double, lon double").select(x.alias("x"), y.alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 500_000


# Coordinates in one system and in another, by EPSG code (x, y; longitude and latitude where a system has degrees).
TRANSFORMED = [
    (27700, 2154, 449101.976793592, 118762.520893760, 397281.685151484, 7104944.603258362),
    (4326, 5070, -108.012518295, 44.565741988, -949481.993153309, 2457462.195000900),
    (3857, 4326, 14672156.980370624, -3364194.407667337, 131.802228665, -28.909987235),
    (32618, 3857, 350882.296162363, 5956772.026958097, -8600644.357123487, 7120737.895983402),
    (2154, 4326, 795739.106044562, 6454687.736167831, 4.219043331, 45.184848783),
    (27700, 4277, 575714.799909360, 738668.227892228, 0.855644333, 56.507308773),
    (4277, 4326, 0.972107876, 56.217516485, 0.970139082, 56.217493070),
    (32633, 3857, 607317.721282202, 7464115.861157241, 1946967.839676939, 10234666.165182829),
    (4326, 27700, -5.111181385, 55.293208517, 202562.652583516, 604310.705659720),
    (4326, 32618, -73.218001562, 36.240739569, 660125.569356274, 4012122.894181943),
    (32755, 3857, 507755.406273375, 2570067.793008739, 16383754.524685279, -10152331.052890709),
    (32618, 5070, 673841.219603725, 3647610.255869563, 2103805.456351452, 1352305.294560957),
]
# Two ends (latitude, longitude) and the points that split the geodesic between them into eight equal parts.
SPLIT = [
    [(0, 0), (14.9563891749, 14.6116979293), (28.8295776730, 31.3345880863), (40.0348793188, 52.5994444654), (46.1134377992, 79.8516372912), (44.8198555585, 109.4645761689), (36.7072997983, 134.7739139832), (24.3772461533, 154.2412510581), (10, 170)],
    [(-37.8, 144.9), (-37.3312549754, 145.7219418157), (-36.8568332198, 146.5336723794), (-36.3768983323, 147.3353732170), (-35.8916102862, 148.1272293770), (-35.4011254405, 148.9094288472), (-34.9055965622, 149.6821620135), (-34.4051728555, 150.4456211585), (-33.9, 151.2)],
]


@pytest.mark.parametrize("case", TRANSFORMED, ids=lambda c: f"{c[0]}-{c[1]}")
def test_transforms_have_known_values(spark, case):
    source, target, x, y, to_x, to_y = case
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(registry.transform(source, target, F.lit(x), F.lit(y)), "xy", strict=True)]).first()
    near = 1e-7 if abs(to_x) <= 180 and abs(to_y) <= 90 else 0.01
    assert (row.x, row.y) == (pytest.approx(to_x, abs=near), pytest.approx(to_y, abs=near))


def test_points_along_geodesics_have_known_values(spark):
    ends = spark.createDataFrame([(k, *map(float, (*p[0], *p[-1]))) for k, p in enumerate(SPLIT)], "k int, a double, b double, c double, d double")
    got = ends.select("k", geodesic.sample(*[F.col(c) for c in "abcd"], 8).alias("s")).orderBy("k").collect()
    for r, points in zip(got, SPLIT, strict=True):
        assert [v for p in r.s for v in (p.lat, p.lon)] == pytest.approx([v for p in points for v in p], abs=1e-9)
