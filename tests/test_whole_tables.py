"""Queries and their SQL run over whole tables; joins by cells equal their predicates on all pairs."""

import random
import re

import pytest

from meridian.functions import planar
from meridian.operators import joins
from meridian.plans.catalogue import ORACLE

@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracles_have_no_filter_of_ids(name):
    assert not re.search(r"_id % \d+ = 0", ORACLE[name])


def test_lines_meet_polygons_by_cells(spark):
    point = lambda x, y: {"x": float(x), "y": float(y)}
    lines = [(1, [point(5, 5)]), (2, [point(-30, 5), point(40, 5)]), (3, [point(-30, 50), point(40, 50)]), (4, [point(-9, -9), point(-1, -1)]), (5, [point(0, -20), point(0, 20)]), (6, [point(4, 4), point(6, 6), point(90, 90)])]
    square = [[point(0, 0), point(10, 0), point(10, 10), point(0, 10)]]
    geometry = "array<struct<x:double,y:double>>"
    table = spark.createDataFrame(lines, f"line_id long, line {geometry}")
    zones = spark.createDataFrame([(1, square)], f"zone_id long, polygon array<{geometry}>")
    want = sorted(r.line_id for r in table.join(zones).where(planar.line_intersects_polygon(table.line, zones.polygon)).collect())
    assert want == [1, 2, 5, 6]
    for size in (3.0, 25.0, 500.0):
        found = joins.line_polygon_join(table, zones, size)
        assert sorted(tuple(r) for r in found.collect()) == [(i, 1) for i in want]
        plan = found._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_nearest_polygon_equals_all_pairs(spark):
    point = lambda x, y: {"x": float(x), "y": float(y)}
    square = lambda x, y, h: [[point(x, y), point(x + h, y), point(x + h, y + h), point(x, y + h)]]
    rng = random.Random(3)
    geometry = "array<array<struct<x:double,y:double>>>"
    zones = [(k, square(rng.uniform(0, 900), rng.uniform(0, 900), rng.choice((1e-3, 2, 60)))) for k in range(12)] + [(90, square(5000, 5000, 700))]
    points = [(k, rng.uniform(-3000, 6000), rng.uniform(-3000, 6000)) for k in range(200)] + [(500, None, 1.0)]
    for some in (zones, zones[:1], [(3, square(0, 0, 1e-9))]):
        left, right = spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(some, f"zone_id long, polygon {geometry}")
        every = left.where("x is not null").crossJoin(right).select("point_id", "zone_id", planar.distance_to_polygon(left.x, left.y, right.polygon).alias("d")).collect()
        want = {p: min((r.d, r.zone_id) for r in every if r.point_id == p) for p, x, _ in points if x is not None}
        got = {r.point_id: (r.distance, r.zone_id) for r in joins.nearest_polygon_join(left, right).collect()}
        assert got == want
    assert joins.nearest_polygon_join(left, right.limit(0)).count() == 0
