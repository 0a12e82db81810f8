"""Joins against brute force over odd shapes, extents and repeated rows, and what their plans hold."""

import random

import pytest
from pyspark.sql import functions as F

from meridian.functions import planar, s2
from meridian.operators import joins
from meridian.operators.nearest import nearest_boxes


def inside(p, rings):
    def odd(ring):
        hit = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x1 - x2) * (p[1] - y2) / (y1 - y2) + x2:
                hit = not hit
        return hit and len(ring) > 2

    return odd(rings[0]) and not any(odd(r) for r in rings[1:])


def shapes(rng):
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    out = [(k, [box(rng.randint(-20, 20), rng.randint(-20, 20), rng.randint(1, 6), rng.randint(1, 6))]) for k in range(30)]
    out += [(100 + k, [[(rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(rng.randint(3, 9))]]) for k in range(10)]  # rings that cross themselves
    out += [(200, [box(-500, -500, 1000, 1000), box(-400, -400, 790, 790)]), (201, [box(-3, -3, 6, 6), box(-2, -2, 3, 3), box(-1, -1, 3, 3)])]  # large; holes that overlap
    return out + [out[0], (0, [box(5, 5, 9, 9)]), (300, [[(0, 0), (1, 1)]]), (301, [[]])]  # repeated, two parts of an id, degenerate


@pytest.mark.parametrize("size", [None, 0.7, 40.0])
def test_points_in_polygons_of_all_extents(spark, size):
    rng = random.Random(3)
    polygons = shapes(rng)
    points = [(k, rng.choice([rng.uniform(-30, 30), float(rng.randint(-22, 22))]), rng.choice([rng.uniform(-30, 30), float(rng.randint(-22, 22))])) for k in range(700)]
    points += [points[0], (5000, 450.0, 0.0), (5001, None, 1.0), (5002, float("nan"), 1.0), (5003, float("inf"), 0.0)]
    p = spark.createDataFrame(points, "point_id int, x double, y double")
    z = spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for i, rings in polygons], f"zone_id int, polygon {planar.POLYGON}")
    want = sorted((i, j) for i, x, y in points if x is not None and abs(x) < 1e9 for j, rings in polygons if rings[0] and inside((x, y), rings))
    assert sorted(map(tuple, joins.spatial_join(p, z, size).collect())) == want
    assert joins.spatial_join(p, z.limit(0), size).count() == 0 and joins.spatial_join(p.limit(0), z, size).count() == 0
    boxes = sorted((i, j) for i, x, y in points if x is not None and abs(x) < 1e9 for j, rings in polygons if rings[0] and min(q[0] for q in rings[0]) <= x <= max(q[0] for q in rings[0]) and min(q[1] for q in rings[0]) <= y <= max(q[1] for q in rings[0]))
    assert sorted((r.point_id, r.zone_id) for r in joins.box_join(p, z, size).collect()) == boxes


def test_no_polygon_in_the_exchange(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5)], "point_id int, x double, y double")
    z = spark.createDataFrame([(1, [[{"x": 0.0, "y": 0.0}, {"x": 1e6, "y": 0.0}, {"x": 1e6, "y": 1e6}]])], f"zone_id int, polygon {planar.POLYGON}")
    plan = joins.spatial_join(p, z, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join") :].splitlines()
    assert not any("polygon#" in line for line in joined[:1]) and "Cross" not in plan
    assert joins.spatial_join(p, z, 1.0).count() == 1


def test_nearest_boxes_against_brute_force(spark):
    rng = random.Random(4)
    boxes = [(k, rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.1, 3.0, 60.0])) for k in range(120)]
    boxes = [(k, x, y, x + w, y + w / 2) for k, x, y, w in boxes] + [(500, 900.0, 900.0, 901.0, 901.0)]
    probes = [(k, rng.uniform(-60, 60), rng.uniform(-60, 60)) for k in range(60)] + [(99, 5000.0, -5000.0), (98, None, 0.0)]
    p = spark.createDataFrame(probes, "probe int, x double, y double")
    b = spark.createDataFrame(boxes, "zone_id int, xmin double, ymin double, xmax double, ymax double")

    def want(k, within=float("inf")):
        out = []
        for i, x, y in probes:
            if x is not None:
                d = sorted((max(b[1] - x, 0, x - b[3]) ** 2 + max(b[2] - y, 0, y - b[4]) ** 2, b[0]) for b in boxes)
                out += [(i, j, rank + 1) for rank, (s, j) in enumerate(d[:k]) if s**0.5 <= within]
        return sorted(out)

    for k in (1, 4, 200):
        assert sorted((r.probe, r.zone_id, r["rank"]) for r in nearest_boxes(p, b, k).collect()) == want(k)
    assert sorted((r.probe, r.zone_id, r["rank"]) for r in nearest_boxes(p, b, 5, within=4.0).collect()) == want(5, 4.0)
    assert nearest_boxes(p, b, 0).count() == 0 and nearest_boxes(p, b.limit(0), 3).count() == 0
    plan = nearest_boxes(p, b, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 3  # whatever the number of boxes


COVERED = {
    "concave with a hole": ([[(10, 40), (11.5, 40), (11.5, 40.7), (10.7, 40.7), (10.7, 41.5), (10, 41.5)], [(10.2, 40.2), (10.4, 40.2), (10.4, 40.4), (10.2, 40.4)]], 8),
    "corner of the cube": ([[(40, 30), (50, 30), (50, 40), (40, 40)]], 5),
    "edge of the cube": ([[(40, -3), (50, -3), (50, 3), (40, 3)]], 4),
    "around a pole": ([[(-180, 80), (180, 80), (180, 90), (-180, 90)]], 4),
    "smaller than a cell": ([[(1, 1), (1.001, 1), (1.001, 1.001)]], 4),
    "two vertices": ([[(0, 0), (1, 1)]], 5),
    "out of range": ([[(0, 0), (200, 0), (1, 1)]], 3),
    "not a number": ([[(0, 0), (float("nan"), 0), (1, 1)]], 3),
}


def test_coverings_against_all_cells(spark):
    """Every cell of the level, by its centre."""
    z = spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for k, (rings, _) in enumerate(COVERED.values())], f"zone_id int, polygon {planar.POLYGON}")
    for k, (rings, level) in enumerate(COVERED.values()):
        got = {r.cell for r in s2.cover(z.where(F.col("zone_id") == k), level).collect()}
        side = 1 << level
        every = spark.range(6 * side * side).select(s2.from_face_ij(F.floor(F.col("id") / (side * side)), F.floor(F.col("id") / side) % side, F.col("id") % side, level).alias("cell"))
        valid = all(abs(x) <= 180 and abs(y) <= 90 for r in rings for x, y in r)
        want = {r.cell for r in s2.with_center(every).collect() if valid and inside((r.lon, r.lat), [[(float(a), float(b)) for a, b in ring] for ring in rings])}
        assert got == want, list(COVERED)[k]
    with pytest.raises(ValueError):
        s2.cover(z, 31)


def test_neighbours_are_beside(spark):
    seeds = [(0.0, 0.0), (0.0, 90.0), (0.0, 180.0), (0.0, -90.0), (89.0, 0.0), (-89.0, 45.0), (45.0, 45.0)]
    steps = [(1, 0), (0, 1), (-1, 0), (0, -1), (1, 1), (-1, -1)]
    df = spark.createDataFrame(seeds, "lat double, lon double").select(s2.cell_at(F.col("lat"), F.col("lon"), 6).alias("c"))
    rows = df.select("c", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("s"))
    rows = rows.select("c", "s", s2.neighbour(F.col("c"), F.col("s.i"), F.col("s.j")).alias("n"))
    rows = rows.withColumn("back", s2.neighbour(F.col("n"), -F.col("s.i"), -F.col("s.j"))).withColumn("level", s2.level(F.col("n")))
    assert all(r.level == 6 and r.back == r.c and r.n != r.c for r in rows.collect())
