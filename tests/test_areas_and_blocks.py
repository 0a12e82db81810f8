"""Areas without rings, means of tall rectangles by blocks, relations of points without an arrangement."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from meridian.functions import overlay, planar, relate
from meridian.raster import band as B

KIND = f"a {planar.POLYGON}, b {planar.POLYGON}"


def _ring(rng, n=5):
    return [{"x": float(rng.randint(0, 40)), "y": float(rng.randint(0, 40))} for _ in range(n)]


@pytest.mark.parametrize("operation", ["union", "intersection", "difference", "symmetric_difference"])
def test_areas_are_those_of_the_shapes(spark, operation):
    rng = random.Random(5)
    rows = [([_ring(rng)], [_ring(rng), _ring(rng, 3)]) for _ in range(40)] + [(None, [_ring(rng)]), ([], [_ring(rng, 3)])]
    a, b = F.col("a"), F.col("b")
    found = spark.createDataFrame(rows, KIND).select(overlay.clip_area(a, b, operation).alias("got"), planar.multipolygon_area(overlay.clip(a, b, operation)).alias("want")).collect()
    for r in found:
        assert r.got == (None if r.want is None else pytest.approx(r.want, abs=1e-6))


def test_means_under_tall_rectangles(spark):
    rng = random.Random(7)
    grid = [(x, y, -1.0 if rng.random() < 0.2 else float(rng.randint(0, 99))) for x in range(3) for y in range(53) if (x, y) != (1, 7)]
    boxes = [(k, *sorted(rng.sample(range(4), 2)), *sorted(rng.sample(range(54), 2))) for k in range(60)] + [(60, 1, 2, 7, 8)]
    meta = B.BandMeta(3, 53, nodata=-1.0, transform=B.GeoTransform(0.0, 53.0, 1.0, 1.0))
    areas = spark.createDataFrame([(k, float(x0), 53.0 - y1, float(x1), 53.0 - y0) for k, x0, x1, y0, y1 in boxes], "k int, xmin double, ymin double, xmax double, ymax double")
    found = {r.k: r.v for r in B.sample_average(areas, spark.createDataFrame(grid, "x int, y int, v double"), meta, "k").collect()}
    for k, x0, x1, y0, y1 in boxes:
        under = [v for x, y, v in grid if x0 <= x < x1 and y0 <= y < y1 and v != -1.0]
        assert found[k] == (pytest.approx(sum(under) / len(under)) if under else None)


def test_points_against_polygons(spark):
    rng = random.Random(3)
    ring = [(0, 0), (20, 0), (20, 20), (0, 20)]
    hole = [(5, 5), (15, 5), (10, 15)]
    polygon = [[{"x": float(x), "y": float(y)} for x, y in part] for part in (ring, hole)]
    rows = [(float(rng.randint(-2, 22)), float(rng.randint(-2, 22)), polygon) for _ in range(150)] + [(7.5, 10.0, polygon), (None, 1.0, polygon), (1.0, 1.0, []), (1.0, 1.0, None)]
    x, y, p = F.col("x"), F.col("y"), F.col("p")
    point = F.when(x.isNotNull() & y.isNotNull(), planar.point(x, y))
    both = spark.createDataFrame(rows, f"x double, y double, p {planar.POLYGON}").select(relate.relate_point_polygon(x, y, p).alias("got"), relate.relate(relate.point_shape(point), relate.polygon_shape(p)).alias("want")).collect()
    assert [r.got for r in both] == [r.want for r in both]
    assert len({r.got for r in both}) == 5
