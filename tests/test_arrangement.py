"""Overlays, buffers, matrices and geodesics against point membership, closed forms and values worked out by hand."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridian.crs.ellipsoid import WGS84, Ellipsoid
from meridian.functions import batches, buffers, geodesic, overlay, planar, relate
from meridian.functions.arrangement import KEEP, Arrangement, Segments

RING = planar.RING
SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


def pts(ring):
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def column(multis):
    return pa.array([[[pts(r) for r in p] for p in m] for m in multis], batches.MULTI_TYPE)


def plain(multi):
    return [[[tuple(q) for q in r.tolist()] for r in p] for p in multi]


def odd(p, multi):
    """Whether an odd number of rings is around a point."""
    inside = False
    for ring in (r for polygon in multi for r in polygon):
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > p[1]) != (y2 > p[1]) and x1 + (p[1] - y1) * (x2 - x1) / (y2 - y1) > p[0]:
                inside = not inside
    return inside


def shoelace(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def area(multi):
    return sum(abs(shoelace(p[0])) - sum(abs(shoelace(h)) for h in p[1:]) for p in multi)


def holed(x, y, w, h):
    corners = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    return [corners(x, y, x + w, y + h), corners(x + w / 4, y + h / 4, x + 3 * w / 4, y + 3 * h / 4)]


def any_shape(rng):
    kind = rng.randint(0, 4)
    if kind == 0:
        return [[[(rng.randint(0, 8), rng.randint(0, 8)) for _ in range(3)]]]
    if kind == 1:
        n, cx, cy = rng.randint(4, 9), rng.uniform(0, 5), rng.uniform(0, 5)
        reach = [rng.uniform(1, 5) for _ in range(n)]
        return [[[(cx + d * math.cos(2 * math.pi * k / n), cy + d * math.sin(2 * math.pi * k / n)) for k, d in enumerate(reach)]]]
    if kind == 2:
        return [holed(rng.randint(0, 6), rng.randint(0, 6), rng.choice([4, 8]), rng.choice([4, 8]))]
    if kind == 3:
        return [holed(0, 0, 4, 4), holed(8, 0, 4, 4)]
    return []


MEANS = {"intersection": lambda a, b: a and b, "union": lambda a, b: a or b, "difference": lambda a, b: a and not b, "symmetric_difference": lambda a, b: a != b}


def test_overlays_hold_the_points_they_should():
    rng = random.Random(7)
    cases = [(any_shape(rng), any_shape(rng)) for _ in range(250)]
    made = Arrangement(Segments.of([batches.multi(column([a for a, _ in cases]), 0), batches.multi(column([b for _, b in cases]), 1)]), len(cases))
    for operation, keep in KEEP.items():
        for (a, b), found in zip(cases, map(plain, made.polygons(keep)), strict=True):
            for _ in range(40):
                p = (rng.uniform(-3, 14), rng.uniform(-3, 14))
                assert odd(p, found) == MEANS[operation](odd(p, a), odd(p, b)), (operation, p, a, b, found)
            for polygon in found:
                assert shoelace(polygon[0]) > 0 and all(shoelace(h) < 0 for h in polygon[1:])
                for ring in polygon:
                    assert len(ring) == len(set(ring)) >= 3


def test_overlays_of_long_boundaries():
    n = 10_000
    circle = lambda cx: [[[(cx + 100 * math.cos(2 * math.pi * k / n), 100 * math.sin(2 * math.pi * k / n)) for k in range(n)]]]
    made = Arrangement(Segments.of([batches.multi(column([circle(0)]), 0), batches.multi(column([circle(50)]), 1)]), 1)
    lens = 2 * 100**2 * math.acos(0.25) - 25 * math.sqrt(4 * 100**2 - 50**2)
    assert area(plain(made.polygons(KEEP["intersection"])[0])) == pytest.approx(lens, rel=1e-6)


def table(spark, rows, kinds):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} {t}" for n, t in kinds.items()))


def test_overlay_columns(spark):
    poly = lambda *rings: [pts(r) for r in rings]
    moved = lambda d, e=0: poly([(x + d, y + e) for x, y in SQUARE])
    rows = [(poly(SQUARE), moved(5, 5)), (poly(SQUARE), moved(20)), (poly(SQUARE), moved(10)), (poly(SQUARE), poly([(4, 4), (6, 4), (6, 6), (4, 6)])), (poly(SQUARE), poly(SQUARE)), (poly(SQUARE), None), (poly(SQUARE), []), ([], [])]
    df = table(spark, rows, {"a": planar.POLYGON, "b": planar.POLYGON})
    a, b = F.col("a"), F.col("b")
    got = df.select("i", *[getattr(overlay, n)(a, b).alias("_" + n[0]) for n in ("union", "intersection", "difference", "symmetric_difference")]).orderBy("i").collect()
    sizes = [None if r._u is None else [round(area([[[(p.x, p.y) for p in ring] for ring in poly] for poly in r["_" + c]]), 9) for c in "uids"] for r in got]
    assert sizes == [[175, 25, 75, 150], [200, 0, 100, 200], [200, 0, 100, 200], [100, 4, 96, 96], [100, 100, 0, 0], None, [100, 0, 100, 100], [0, 0, 0, 0]]
    assert [len(got[1]._u), len(got[2]._u), len(got[3]._d[0]), len(got[4]._d)] == [2, 1, 2, 0]
    assert len(got[2]._u[0][0]) == 4  # the vertices between are gone
    pile = table(spark, [([moved(k, k) for k in range(5)] + [moved(3, 3)],), ([poly(*holed(0, 0, 8, 8)), poly([(2, 2), (4, 2), (4, 6), (2, 6)][::-1])],), ([],), (None,)], {"p": f"array<{planar.POLYGON}>"})
    found = [r.a for r in pile.select("i", planar.multipolygon_area(overlay.union_all(F.col("p"))).alias("a")).orderBy("i").collect()]
    assert found[0] == pytest.approx(100 + 4 * 19) and found[1] == pytest.approx(56) and found[2] == 0 and found[3] is None
    with pytest.raises(ValueError):
        overlay.clip(a, b, "minus")


def test_buffers(spark):
    disk = lambda n, r: n / 2 * math.sin(2 * math.pi / n) * r * r
    lines = [([(0, 0), (10, 0)], 1.0, 20 + disk(64, 1)), ([(0, 0), (10, 0), (10, 10)], 1.0, None), ([(3, 4)], 2.0, disk(64, 2)), ([(3, 4), (3, 4)], 2.0, disk(64, 2)), ([(0, 0), (1, 0)], 0.0, 0), ([(0, 0), (1, 0)], -1.0, 0), ([], 1.0, 0), ([(0, 0), (1, 0)], None, None), (None, 1.0, None)]
    df = table(spark, [(None if p is None else pts(p), d) for p, d, _ in lines], {"p": RING, "d": "double"})
    got = df.select("i", buffers.buffer_line(F.col("p"), F.col("d"), 64).alias("s")).select("i", "s", planar.multipolygon_area(F.col("s")).alias("a")).orderBy("i").collect()
    for row, (_, _, want) in zip(got, lines, strict=True):
        if want is not None:
            assert row.a == pytest.approx(want, abs=1e-9)
    assert len(got[1].s) == 1 and got[1].a == pytest.approx(40 - 1 + 1.25 * math.pi, rel=2e-3)  # two strips less the corner they share, two half disks, a quarter
    assert got[7].s is None and got[8].s is None
    big = holed(0, 0, 10, 10)
    polygons = [([SQUARE], 1.0, 140 + disk(64, 1)), (big, 1.0, 140 + disk(64, 1) - 9), (big, 3.0, 220 + disk(64, 3)), ([SQUARE], -1.0, 64), (big, -1.0, 64 - 25 - 20 - disk(64, 1)), ([[(0, 0), (10, 0), (10, 1), (0, 1)]], -1.0, 0), (big, 0.0, 75), ([SQUARE], float("nan"), None)]
    df = table(spark, [([pts(r) for r in p], d) for p, d, _ in polygons], {"p": planar.POLYGON, "d": "double"})
    got = df.select("i", buffers.buffer_polygon(F.col("p"), F.col("d"), 64).alias("s")).select("i", "s", planar.multipolygon_area(F.col("s")).alias("a")).orderBy("i").collect()
    for row, (_, _, want) in zip(got, polygons, strict=True):
        assert (row.a is None) if want is None else row.a == pytest.approx(want, abs=1e-9)
    assert [len(got[k].s[0]) for k in (1, 2)] == [2, 1]  # the hole shrinks, then fills
    one = df.select(planar.multipolygon_area(buffers.buffer_point(planar.point(F.lit(3.0), F.lit(4.0)), 1.0, 64)).alias("a")).first().a
    assert one == pytest.approx(disk(64, 1))


# relations


def brute_matrix(a, b):
    """Nine letters of two shapes on a grid, from which part of each the nodes, the middles of pieces and points beside them lie in.

    Pieces come from exact fractions; a point is judged by its own tests.
    """
    from fractions import Fraction as Q

    def edges(s):
        rings = [(r[k], r[(k + 1) % len(r)]) for p in s["polygons"] for r in p for k in range(len(r))]
        return rings, [(u, v) for line in s["lines"] for u, v in zip(line, line[1:])]

    cross = lambda o, u, v: (u[0] - o[0]) * (v[1] - o[1]) - (u[1] - o[1]) * (v[0] - o[0])

    def on(p, e):
        (x1, y1), (x2, y2) = e
        return cross(e[0], e[1], p) == 0 and min(x1, x2) <= p[0] <= max(x1, x2) and min(y1, y2) <= p[1] <= max(y1, y2)

    def place(p, s):
        rings, lines = edges(s)
        ends = [q for line in s["lines"] for q in (line[0], line[-1])]
        if p in s["points"]:
            return 0
        if ends.count(p) % 2:
            return 1
        if any(on(p, e) for e in lines):
            return 0
        if any(on(p, e) for e in rings):
            return 1
        hit = sum(((e[0][1] > p[1]) != (e[1][1] > p[1])) and Q(e[0][0]) + Q(p[1] - e[0][1]) * (e[1][0] - e[0][0]) / (e[1][1] - e[0][1]) > p[0] for e in rings)
        return 0 if hit % 2 else 2

    every = [e for s in (a, b) for part in edges(s) for e in part]
    nodes = {q for e in every for q in e} | set(a["points"]) | set(b["points"])
    for i, (p, q) in enumerate(every):
        for r, s in every[i + 1 :]:
            den = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
            if den:
                t = Q((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0]), den)
                u = Q((r[0] - p[0]) * (q[1] - p[1]) - (r[1] - p[1]) * (q[0] - p[0]), den)
                if 0 <= t <= 1 and 0 <= u <= 1:
                    nodes.add((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    best = [[-1] * 3 for _ in range(3)]
    best[2][2] = 2

    def saw(p, d):
        i, j = place(p, a), place(p, b)
        best[i][j] = max(best[i][j], d)

    for n in nodes:
        saw(n, 0)
    beside = Q(1, 10**6)
    for e in every:
        along = sorted({n for n in nodes if on(n, e)})
        for u, v in zip(along, along[1:]):
            m = (Q(u[0] + v[0]) / 2, Q(u[1] + v[1]) / 2)
            saw(m, 1)
            for sign in (1, -1):
                saw((m[0] - sign * beside * (v[1] - u[1]), m[1] + sign * beside * (v[0] - u[0])), 2)
    return "".join("F012"[d + 1] for row in best for d in row)


def random_shape(rng):
    g = lambda: (rng.randint(0, 4), rng.randint(0, 4))
    empty = {"points": [], "lines": [], "polygons": []}
    kind = rng.randint(0, 4)
    if kind == 0:
        return empty | {"points": [g() for _ in range(rng.randint(1, 3))]}
    if kind < 3:
        lines = []
        while len(lines) < kind:
            line = [g() for _ in range(rng.randint(2, 4))]
            if len(set(zip(line, line[1:]))) == len(line) - 1 and all(u != v for u, v in zip(line, line[1:])):
                lines.append(line)
        return empty | {"lines": lines}
    if kind == 3:
        while True:
            t = [g(), g(), g()]
            if shoelace(t):
                return empty | {"polygons": [[t]]}
    return empty | {"polygons": [[[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)]]]}


def test_matrices_of_any_pair_against_brute_force(spark):
    rng = random.Random(9)
    cases = [(random_shape(rng), random_shape(rng)) for _ in range(400)]
    kinds = {f"{s}_{n}": t for s in "ab" for n, t in (("points", RING), ("lines", f"array<{RING}>"), ("polygons", f"array<{planar.POLYGON}>"))}
    flat = lambda s: (pts(s["points"]), [pts(line) for line in s["lines"]], [[pts(r) for r in p] for p in s["polygons"]])
    df = table(spark, [(*flat(a), *flat(b)) for a, b in cases], kinds)
    side = lambda s: relate.shape(F.col(f"{s}_points"), F.col(f"{s}_lines"), F.col(f"{s}_polygons"))
    got = [r.m for r in df.select("i", relate.relate(side("a"), side("b")).alias("m")).orderBy("i").collect()]
    for (a, b), m in zip(cases, got, strict=True):
        assert m == brute_matrix(a, b), (a, b)


def test_named_relations_and_nulls(spark):
    df = table(spark, [(pts([(0, 0), (4, 4)]), pts([(0, 4), (4, 0)]), [pts(SQUARE)]), (pts([(0, 0), (4, 4)]), None, None)], {"a": RING, "b": RING, "p": planar.POLYGON})
    got = df.select("i", relate.linestrings_cross(F.col("a"), F.col("b")).alias("c"), relate.line_within_polygon(F.col("a"), F.col("p")).alias("w")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(0, True, True), (1, None, None)]
    rings = [([*SQUARE, SQUARE[0]], True), ([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)], False), ([(0, 0), (4, 0), (4, 0), (4, 4), (0, 0)], False), (SQUARE, False), ([], False), (None, None)]
    df = table(spark, [(None if r is None else pts(r),) for r, _ in rings], {"r": RING})
    assert [r.v for r in df.select("i", relate.ring_is_simple(F.col("r")).alias("v")).orderBy("i").collect()] == [v for _, v in rings]


# geodesics

#: Published test values: nearly antipodal pairs on WGS 84 (latitude and longitude difference, distance, both azimuths).
ANTIPODAL = [((-30.0, 0.0, 29.9, 179.8), 19989832.827610, 161.890524736, 18.090737245)]


def test_geodesics_near_antipodes(spark):
    g = geodesic.Geodesics(WGS84)
    one = lambda *v: {k: float(x[0]) for k, x in g.inverse(*[np.array([float(n)]) for n in v]).items() if not isinstance(x, tuple)}
    for ends, distance, first, last in ANTIPODAL:
        found = one(*ends)
        assert (found["distance"], found["initial"], found["final"]) == (pytest.approx(distance, abs=1e-6), pytest.approx(first, abs=1e-8), pytest.approx(last, abs=1e-8))
    assert one(0, 0, 0, 180)["distance"] == pytest.approx(20003931.458625, abs=1e-5)
    assert one(90, 0, -90, 7)["distance"] == pytest.approx(20003931.458625, abs=1e-5)
    assert one(0, 0, 0, 90)["distance"] == pytest.approx(WGS84.a * math.pi / 2, abs=1e-6)
    rng = np.random.default_rng(3)
    n = 4000
    lat, lat2, lon, lon2 = rng.uniform(-90, 90, n), rng.uniform(-90, 90, n), rng.uniform(-180, 180, n), rng.uniform(-180, 180, n)
    lat2[: n // 2], lon2[: n // 2] = np.clip(-lat[: n // 2] + rng.normal(0, 0.3, n // 2), -90, 90), lon[: n // 2] + 180 + rng.normal(0, 0.3, n // 2)
    there, back = g.inverse(lat, lon, lat2, lon2), g.inverse(lat2, lon2, lat, lon)
    assert np.abs(there["distance"] - back["distance"]).max() < 1e-6
    end = g.direct(lat, lon, there["initial"], there["distance"])
    off = np.hypot(end["lat"] - lat2, (np.remainder(end["lon"] - lon2 + 180, 360) - 180) * np.cos(np.radians(lat2)))
    assert off.max() < 2e-9
    # halves of a line, and the triangle inequality
    half = g.direct(lat, lon, there["initial"], there["distance"] / 2)
    rest = g.inverse(half["lat"], half["lon"], lat2, lon2)
    assert np.abs(rest["distance"] - there["distance"] / 2).max() < 1e-6
    sphere = geodesic.Geodesics(Ellipsoid(6371000.0, 0.0))
    great = 6371000 * np.arccos(np.clip(np.sin(np.radians(lat)) * np.sin(np.radians(lat2)) + np.cos(np.radians(lat)) * np.cos(np.radians(lat2)) * np.cos(np.radians(lon2 - lon)), -1, 1))
    assert np.abs(sphere.inverse(lat, lon, lat2, lon2)["distance"] - great)[n // 2 :].max() < 0.2


def test_geodesic_columns(spark):
    rows = [(-30.0, 0.0, 29.9, 179.8), (91.0, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0), (float("nan"), 0.0, 0.0, 0.0), (10.0, 20.0, 10.0, 20.0)]
    df = table(spark, rows, {c: "double" for c in ("lat", "lon", "lat2", "lon2")})
    ends = [F.col(c) for c in ("lat", "lon", "lat2", "lon2")]
    got = df.select("i", geodesic.inverse(*ends).alias("g"), geodesic.sample(*ends, 4).alias("s")).orderBy("i").collect()
    assert got[0].g.distance == pytest.approx(19989832.82761, abs=1e-5) and [r.g for r in got[1:4]] == [None] * 3 and got[4].g.distance == 0
    assert [len(r.s) if r.s else None for r in got] == [5, None, None, None, 5]
    assert (got[0].s[0].lat, got[0].s[4].lon) == (-30.0, 179.8)


#: Published values of an area, a perimeter and the ring's vertices (latitude, longitude): around a pole, Antarctica.
AREAS = [
    (24952305678.0, 631819.8745, [(89, 0), (89, 90), (89, 180), (89, 270)]),
    (13662703680020.1, 16831067.893, [(-63.1, -58), (-72.9, -74), (-71.9, -102), (-74.9, -102), (-74.3, -131), (-77.5, -163), (-77.4, 163), (-71.7, 172), (-65.9, 140), (-65.7, 113), (-66.6, 88), (-66.9, 59), (-69.8, 25), (-70.0, -4), (-71.0, -14), (-77.3, -33), (-77.9, -46), (-74.7, -61)]),
]


def test_geodesic_polygons(spark):
    g = geodesic.Geodesics(WGS84)
    eighth = math.pi * g.c2 / 2
    flip = lambda ring: [(lon, lat) for lat, lon in ring]
    rings = [flip(r) for *_, r in AREAS] + [flip(r)[::-1] for *_, r in AREAS]
    rings += [[(0, 0), (90, 0), (0, 90)], [(179, 0), (-179, 0), (-179, 1), (179, 1)], [(1, 0), (3, 0), (3, 1), (1, 1)], [(1, 0), (3, 0), (3, 1), (1, 1), (1, 0)], [(0, 0), (1, 1)], [], [(0, 91), (1, 0), (1, 1)]]
    df = table(spark, [(pts(r),) for r in rings] + [(None,)], {"r": RING})
    got = [r.m for r in df.select("i", geodesic.polygon_measure(F.col("r")).alias("m")).orderBy("i").collect()]
    for k, (size, around, _) in enumerate(AREAS):
        assert abs(got[k].area) == pytest.approx(size, rel=1e-11) and got[k].perimeter == pytest.approx(around, abs=1e-3)
        assert got[k + 2].area == pytest.approx(-got[k].area, rel=1e-12)
    assert got[4].area == pytest.approx(eighth, rel=1e-12)
    assert got[5].area == pytest.approx(got[6].area, rel=1e-12) and got[7] == got[6] and got[6].area > 0
    assert got[8].area == 0 and got[9].perimeter == 0 and got[10] is None and got[11] is None
