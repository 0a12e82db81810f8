"""Lines against polygons by the cells that their segments pass."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from meridian.functions import planar
from meridian.operators import joins


def _ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_long_lines_against_brute_force(spark):
    rng = random.Random(6)
    at = lambda: (rng.randint(-60, 60) / 2, rng.randint(-60, 60) / 2)
    lines = [(k, _ring([at() for _ in range(rng.randint(1, 4))])) for k in range(60)] + [(90, _ring([(3, -30), (3, 30)])), (91, _ring([(3, -30), (3.0000000001, 30)])), (92, _ring([(-30, 4), (30, 4)])), (93, _ring([(1, 1), (1, 1)])), (94, _ring([(float("nan"), 1), (2, 2)]))]
    box = lambda x, y, w, h: _ring([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
    zones = [[box(*at(), rng.randint(1, 9), rng.randint(1, 9))] for _ in range(40)] + [[box(x, y, 9, 9), box(x + 2, y + 2, 5, 5)] for x, y in (at() for _ in range(15))] + [[_ring([at(), at(), at()])] for _ in range(15)]
    a = spark.createDataFrame(lines, f"line_id int, line {planar.RING}")
    z = spark.createDataFrame(list(enumerate(zones)), f"zone_id int, polygon {planar.POLYGON}")
    want = a.where("line_id < 94").crossJoin(z).where(planar.line_intersects_polygon(F.col("line"), F.col("polygon"))).select("line_id", "zone_id").collect()
    for size in (1.0, 4.0, 100.0, None):
        assert sorted(joins.line_polygon_join(a.where("line_id < 94"), z, size).collect()) == sorted(want)


def test_a_segment_takes_the_cells_that_it_passes(spark):
    one = spark.createDataFrame([(_ring([(0.5, 0.5), (99.5, 99.4)]),)], f"line {planar.RING}").select(F.explode(planar.segments(F.col("line"))).alias("_s"))
    boxed = one.withColumns({"xmin": F.lit(0.5), "ymin": F.lit(0.5), "xmax": F.lit(99.5), "ymax": F.lit(99.4)})
    assert joins._passed(boxed, 1.0).count() < 210  # 10,000 in its box


def test_an_end_a_last_digit_off_a_side_touches_it(spark):
    a = spark.createDataFrame([(1, _ring([(-5, 1), (-1e-13, 1)])), (2, _ring([(-5, 1), (-1e-3, 1)]))], f"line_id int, line {planar.RING}")
    z = spark.createDataFrame([(7, [_ring([(0, 0), (2, 0), (2, 2), (0, 2)])])], f"zone_id int, polygon {planar.POLYGON}")
    assert [tuple(r) for r in joins.line_polygon_join(a, z, 1.0).collect()] == [(1, 7)]
