"""Boxes against the general relations and overlays, and pairs of polygons some of which are boxes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from meridian.functions import overlay, planar, relate
from meridian.operators import joins

KIND = f"id int, polygon {planar.POLYGON}"


def _ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def _box(x0, y0, x1, y1):
    return [_ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]


def _shapes(rng):
    side = lambda: sorted(rng.sample(range(9), 2))
    boxes = [_box(x0, y0, x1, y1) for (x0, x1), (y0, y1) in ((side(), side()) for _ in range(40))]
    tilted = [[_ring([(x, y - 2), (x + 2, y), (x, y + 2), (x - 2, y)])] for x, y in ((2, 2), (5, 6))]
    holed = [[*_box(0, 0, 8, 8), *_box(2, 2, 5, 5)], [[*_box(1, 1, 4, 4)[0], {"x": 1.0, "y": 1.0}]]]
    return boxes + tilted + holed


def test_boxes_relate_and_overlap_as_polygons_do(spark):
    shapes = _shapes(random.Random(3))[:40] + [_box(3, 3, 3, 6), _box(2, 2, 2, 2)]
    a = spark.createDataFrame(list(enumerate(shapes)), KIND)
    both = a.crossJoin(a.select(F.col("polygon").alias("other")))
    p, q = F.col("polygon"), F.col("other")
    x, y = planar.polygon_bbox(p), planar.polygon_bbox(q)
    rows = both.select(relate.relate_boxes(x, y).alias("got"), relate.relate_polygons(p, q).alias("want"), overlay.box_areas(x, y)["both"].alias("area"), overlay.intersection_area(p, q).alias("true")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    assert [r.area for r in rows] == pytest.approx([r.true for r in rows])


def test_sides_that_differ_by_the_last_digit_are_compared_as_they_are(spark):
    a, b = _box(0, 0, 1024.01, 5), _box(1024.0100000000002, 0, 1030, 5)
    one = spark.createDataFrame([(1, a)], KIND).withColumnRenamed("id", "left_id")
    two = spark.createDataFrame([(2, _box(1000, 1, 1024.0099999999998, 2)), (3, b)], KIND).withColumnRenamed("id", "right_id")
    found = joins.polygon_measures(one, two, relate.relate_boxes, relate.relate_polygons, "matrix", 100.0).collect()
    assert {r.right_id: r.matrix for r in found} == {2: "212FF1FF2"}


def test_what_is_a_box(spark):
    nan, inf = float("nan"), float("inf")
    cases = [(True, _box(0, 0, 2, 1)), (True, [_ring([(0, 0), (0, 1), (2, 1), (2, 0)])]), (False, _box(0, 0, 0, 1)), (False, [_ring([(0, 0), (2, 0), (0, 1), (2, 1)])]), (False, [_ring([(0, 0), (2, 0), (1, 1), (0, 1)])]),
             (False, [*_box(0, 0, 4, 4), *_box(1, 1, 2, 2)]), (False, _box(nan, 0, 1, 1)), (False, _box(0, 0, inf, 1)), (False, []), (False, None)]
    rows = spark.createDataFrame(list(enumerate(p for _, p in cases)), KIND).select("id", planar.is_box(F.col("polygon")).alias("box")).collect()
    assert [r.box for r in sorted(rows)] == [c for c, _ in cases]


def test_pairs_of_boxes_and_others_are_each_measured_once(spark):
    shapes = _shapes(random.Random(11))
    rows = spark.createDataFrame(list(enumerate(shapes)), KIND)
    left, right = rows.withColumnRenamed("id", "left_id"), rows.withColumnRenamed("id", "right_id")
    found = joins.polygon_measures(left, right, relate.relate_boxes, relate.relate_polygons, "matrix", 3.0, ordered=True).collect()
    pairs = joins.polygon_pairs(left, right, 3.0).where("left_id < right_id")
    want = pairs.select("left_id", "right_id", relate.relate_polygons(F.col("polygon_l"), F.col("polygon_r")).alias("matrix")).collect()
    assert sorted(found) == sorted(want)
    assert len({(r.left_id, r.right_id) for r in found}) == len(found)
