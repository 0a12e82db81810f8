"""Strips against exact fractions, the arrangement and the general predicates."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from test_areas_to_the_last_digit import area, common, exact

from meridian.functions import overlay, planar, strips
from meridian.operators import joins

KIND = f"id int, polygon {planar.POLYGON}"


def _ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def _convex(rng):
    """Corners on an ellipse, either way around, the first perhaps repeated."""
    n, x, y, a, b = rng.randrange(3, 9), rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(1, 6), rng.uniform(1, 6)
    turns = sorted(rng.sample(range(24), n))
    p = [(x + a * math.cos(t * math.pi / 12 + 0.1), y + b * math.sin(t * math.pi / 12 + 0.1)) for t in turns]
    return p[::-1] if rng.random() < 0.5 else p


def _frame(spark, shapes, name):
    return spark.createDataFrame(list(enumerate(shapes)), KIND).withColumnRenamed("id", name)


def test_areas_of_convex_rings_against_exact_fractions(spark):
    rng = random.Random(5)
    pairs = [(_convex(rng), _convex(rng)) for _ in range(400)]
    table = spark.createDataFrame([(i, [_ring([*p, p[0]] if i % 2 else p)], [_ring(q)]) for i, (p, q) in enumerate(pairs)], f"i int, a {planar.POLYGON}, b {planar.POLYGON}")
    a, b = strips.strips(F.col("a")), strips.strips(F.col("b"))
    rows = table.select("i", a.alias("p"), b.alias("q")).select("i", strips.areas(F.col("p"), F.col("q")).alias("s"), strips.intersect(F.col("p"), F.col("q")).alias("m"), strips.clip_area(F.col("p"), F.col("q"), "symmetric_difference").alias("x")).collect()
    told = [r for r in rows if r.s is not None]
    assert len(told) > 300
    turned = lambda p: p if area(exact(p)) > 0 else p[::-1]
    for r in told:
        p, q = map(exact, map(turned, pairs[r.i]))
        both = common(p, q)
        assert float(area(p)) == pytest.approx(r.s.a, rel=1e-13)
        assert float(both) == pytest.approx(r.s.both, rel=1e-11, abs=1e-12)
        assert float(area(p) + area(q) - 2 * both) == pytest.approx(r.x, rel=1e-11)
        assert (both > Fraction(0)) == r.m


def test_what_fits(spark):
    square = lambda x, y, h: _ring([(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)])
    nine = _ring([(math.cos(k * math.pi / 4.5), math.sin(k * math.pi / 4.5)) for k in range(9)])
    star = _ring([(math.cos(k * math.pi * 0.8), math.sin(k * math.pi * 0.8)) for k in range(5)])
    cases = [(True, [square(0, 0, 1)]), (True, [square(0, 0, 2)[::-1], square(1, 1, 1)]), (False, [square(0, 0, 2), square(1, 1, 1.5)]), (False, [square(0, 0, 2), square(-1, -1, 0.5), square(1, 1, 0.5)]),
             (False, [_ring([(0, 0), (4, 0), (1, 1), (0, 4)])]), (False, [_ring([(0, 0), (2, 2), (2, 0), (0, 2)])]), (False, [nine]), (False, [star]), (False, [_ring([(0, 0), (1, 0)])]), (False, [_ring([(0, 0), (1, 0), (2, 0), (1, 1)])]),
             (False, [_ring([(0, 0), (1, 0), (math.nan, 1)])]), (False, [_ring([(0, 0), (math.inf, 0), (1, 1)])]), (False, [_ring([(0, 0), (1000, 1), (0, 2)])]), (False, []), (False, [[]]), (False, None)]
    frame = _frame(spark, [p for _, p in cases], "id")
    for dealt in (frame.coalesce(1), frame.repartition(16)):
        rows = dealt.select("id", strips.strips(F.col("polygon")).isNotNull().alias("fits")).collect()
        assert [r.fits for r in sorted(rows)] == [c for c, _ in cases]


def test_pairs_of_all_kinds_are_each_measured_once_and_as_before(spark):
    rng = random.Random(2)
    square = lambda x, y, h: _ring([(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)])
    shapes = [[_ring(_convex(rng))] for _ in range(25)]
    shapes += [[square(x, y, 3), square(x, y, h)] for x, y, h in ((0, 0, 2), (1, 1, 1), (-3, 2, 2.5), (4, -4, 3))] + [[square(0, 0, 0.5)], [square(0, 0, 2)], [square(1, 1, 0.25)]]
    shapes += [[_ring([(0, 0), (6, 0), (6, 6), (3, 1), (0, 6)])], [square(0, 0, 5), square(-2, -2, 1), square(2, 2, 1)], [_ring([(-4, -4), (4, -4), (4, 4), (0, -2)])]]
    left, right = _frame(spark, shapes, "left_id"), _frame(spark, shapes, "right_id")
    pairs = joins.polygon_pairs(left, right, 4.0).where("left_id < right_id")
    a, b = F.col("polygon_l"), F.col("polygon_r")
    for operation in ("intersection", "difference"):
        got = joins.polygon_overlays(left, right, lambda p, q: strips.clip_area(p, q, operation), lambda p, q: overlay.clip_area(p, q, operation), "area", 4.0, where="left_id < right_id").collect()
        want = {(r.left_id, r.right_id): r.area for r in pairs.select("left_id", "right_id", overlay.clip_area(a, b, operation).alias("area")).collect()}
        assert len(got) == len(want) > 200
        assert {(r.left_id, r.right_id): r.area for r in got} == pytest.approx(want, rel=1e-9, abs=1e-9)
    got = joins.polygon_intersection_join(left, right, 4.0, where="left_id < right_id").collect()
    want = pairs.where(planar.polygons_intersect(a, b)).select("left_id", "right_id").collect()
    assert sorted(got) == sorted(want)
