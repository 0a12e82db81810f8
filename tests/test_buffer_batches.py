"""Buffers of single segments without cutting, and how many shapes are buffered at once."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridian.functions import batches, buffers, planar


@pytest.mark.parametrize("sides", [4, 16])
def test_one_segment_widened(spark, sides):
    rng = random.Random(2)
    ends = [((0, 0), (5, 0)), ((0, 0), (0, 5)), ((3, 3), (-2, -2)), ((0, 0), (3, 0)), ((1, 1), (1, 1))] + [tuple((rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(2)) for _ in range(30)]
    rows = [([{"x": float(x), "y": float(y)} for x, y in pair],) for pair in ends] + [(None,), ([],)]
    made = spark.createDataFrame(rows, f"line {planar.RING}").select("line", buffers.buffer_line(F.col("line"), 3.0, sides).alias("got"))
    disk = sides / 2 * math.sin(2 * math.pi / sides) * 9
    for row in made.withColumn("area", planar.multipolygon_area(F.col("got"))).collect():
        if not row.line:
            assert row.got is None if row.line is None else row.got == []
            continue
        length = math.dist((row.line[0].x, row.line[0].y), (row.line[1].x, row.line[1].y))
        if length == 0 or length >= 3:
            assert row.area == pytest.approx(6 * length + disk, rel=1e-9)
            assert all(row.got[0][0][k] != row.got[0][0][k - 1] for k in range(len(row.got[0][0])))


def test_capsules_equal_the_arrangement():
    rng = np.random.default_rng(4)
    ends = rng.uniform(-50, 50, (200, 4))
    ends[:40] = np.round(ends[:40] / 10) * 10
    ends = ends[np.hypot(ends[:, 2] - ends[:, 0], ends[:, 3] - ends[:, 1]) >= 4]
    r = np.full(len(ends), 4.0)
    for sides in (4, 6, 16, 32):
        got = buffers._capsules(ends, r, sides).to_pylist()
        lines = batches._chains(pa.array([[{"x": e[0], "y": e[1]}, {"x": e[2], "y": e[3]}] for e in ends.tolist()], batches.LINE_TYPE), np.arange(len(ends)), 0, batches.LINE)
        band = buffers._band(lines, np.empty((0, 2)), np.empty(0, np.int64), r, sides)
        made = buffers.Arrangement(buffers.Segments.of(band), len(ends), (False, True)).areas(np.array([[False, True], [False, True]]))
        for row, want in zip(got, made, strict=True):
            xy = np.array([(p["x"], p["y"]) for p in row[0][0]])
            area = float(np.dot(xy[:, 0], np.roll(xy[:, 1], -1)) - np.dot(np.roll(xy[:, 0], -1), xy[:, 1])) / 2
            assert area == pytest.approx(want, rel=1e-9)


def test_many_polygons_are_buffered_some_at_a_time(monkeypatch):
    most = []
    made = buffers.Arrangement
    monkeypatch.setattr(buffers, "Arrangement", lambda s, *rest: most.append(len(s.group)) or made(s, *rest))
    square = [[{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 0.0}, {"x": 9.0, "y": 9.0}, {"x": 0.0, "y": 9.0}]]
    polygons = pa.array([square] * 5000, batches.POLYGON_TYPE)
    out = buffers.polygon_buffers(polygons, pa.array([1.0] * 5000), 32)
    assert len(out) == 5000 and max(most) <= 250_000
