"""Overlay against plain clipping of convex shapes, holes and shared edges; geodesics against published pairs."""

import random

import pytest
from pyspark.sql import functions as F

from meridian.functions import geodesic, overlay, planar

GEOMETRY = "array<array<struct<x:double,y:double>>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def area(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True)) / 2


def clipped(subject, clip):
    """Of two convex rings that run to the left."""
    out = list(subject)
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1], strict=True):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        now, out = out, []
        for p, q in zip(now, now[1:] + now[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return abs(area(out)) if len(out) > 2 else 0.0


def test_overlay_areas(spark):
    rng = random.Random(4)
    triangle = lambda: (lambda t: t if area(t) > 0 else t[::-1])([(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(3)])
    rows, want = [], []
    for _ in range(60):
        a, b = triangle(), rng.choice([triangle(), box(rng.uniform(0, 8), rng.uniform(0, 8), 3, 2)])
        rows.append(([ring(a if rng.random() < 0.5 else a[::-1])], [ring(b)]))
        want.append(clipped(a, b))
    square, hole = box(0, 0, 10, 10), box(2, 2, 6, 6)[::-1]
    special = [
        ([square], [square], 100.0), ([square, hole], [square], 64.0), ([square, hole], [box(3, 3, 2, 2)], 0.0), ([square], [box(10, 0, 5, 5)], 0.0),
        ([square], [box(0, 0, 5, 5)], 25.0), ([square], [box(5, -5, 5, 10)], 25.0), ([square, hole], [box(1, 1, 8, 8), hole], 28.0), ([square], [box(20, 20, 1, 1)], 0.0),
        ([[(0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9)]], [box(-1, 5, 12, 2)], 12.0),
    ]
    rows += [([ring(r) for r in a], [ring(r) for r in b]) for a, b, _ in special]
    want += [w for _, _, w in special]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, a {GEOMETRY}, b {GEOMETRY}").withColumn("s", overlay.areas(F.col("a"), F.col("b")))
    s = F.col("s")
    got = table.select("i", "s.both", overlay.overlaps(s).alias("o"), overlay.contains(s).alias("c"), overlay.touches(F.col("a"), F.col("b"), s).alias("t"), overlay.union_area(s).alias("u"), "s.a", "s.b").orderBy("i").collect()
    assert [r.both for r in got] == pytest.approx(want, abs=1e-7)
    assert all(r.u == pytest.approx(r.a + r.b - r.both) for r in got)
    assert [(r.o, r.c, r.t) for r in got[60:]] == [(False, True, False), (False, False, False), (False, False, False), (False, False, True), (False, True, False), (True, False, False), (False, True, False), (False, False, False), (True, False, False)]
    empty = spark.createDataFrame([(None, [ring(square)]), ([], [ring(square)])], f"a {GEOMETRY}, b {GEOMETRY}")
    assert [r[0] for r in empty.select(overlay.intersection_area(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0]


def test_geodesics(spark):
    rows = spark.createDataFrame([(1, -37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777), (2, 0.0, 0.0, 0.0, 90.0), (3, 40.0, 179.0, 41.0, -179.0), (4, 10.0, 20.0, 10.0, 20.0), (5, 0.0, 0.0, 0.3, 179.9), (6, 91.0, 0.0, 0.0, 0.0), (7, 30.0, 0.0, 90.0, 0.0)], "k int, a double, b double, c double, d double")
    c = [F.col(x) for x in "abcd"]
    got = {r.k: r.g for r in rows.select("k", geodesic.inverse(*c).alias("g")).collect()}
    # the well-known line from Flinders Peak to Buninyong, here on WGS84
    assert got[1].distance == pytest.approx(54972.271, abs=0.01) and got[1].initial == pytest.approx(306.868, abs=1e-3)
    assert got[2].distance == pytest.approx(6378137 * 3.141592653589793 / 2, abs=1e-4) and got[2].initial == pytest.approx(90)
    assert got[4].distance == 0 and got[5].distance == pytest.approx(19970142.046, abs=1e-3) and got[6] is None and got[7].initial == pytest.approx(0)
    back = rows.withColumn("g", geodesic.inverse(*c)).where("g is not null").withColumn("p", geodesic.direct(c[0], c[1], F.col("g.initial"), F.col("g.distance")))
    for r in back.collect():
        assert (r.p.lat, r.p.lon % 360) == pytest.approx((r.c, r.d % 360), abs=1e-8) or r.c == 90
    line = rows.where("k = 1").select(geodesic.sample(*c, 4).alias("s")).first().s
    assert len(line) == 5 and (line[0].lat, line[4].lon) == pytest.approx((-37.95103341666667, 143.92649552777777))
