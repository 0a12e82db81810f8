"""Nearest boxes where many boxes lie over each other."""

from __future__ import annotations

import random

import pytest

from meridian.operators.nearest import _over_cells, holding_boxes, nearest_boxes

BOX = "zone_id int, xmin double, ymin double, xmax double, ymax double"


def _brute(probes, boxes, k):
    for p, x, y in probes:
        d = sorted((max(a - x, 0, x - c) ** 2 + max(b - y, 0, y - e) ** 2, i) for i, a, b, c, e in boxes)
        yield from ((p, i, r + 1, s**0.5) for r, (s, i) in enumerate(d[:k]))


@pytest.mark.parametrize("spread", [4, 40, 4000])
def test_boxes_over_each_other(spark, spread):
    rng = random.Random(spread)
    corner = [(rng.randint(-spread, spread), rng.randint(-spread, spread), rng.choice([0, 1, 7, 8, 30]), rng.choice([0, 2, 8, 300])) for _ in range(500)]
    boxes = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(corner)]
    probes = [(p, float(rng.randint(-spread, spread)), float(rng.randint(-spread, spread))) for p in range(120)] + [(200, -0.5, 0.25), (201, 9e5, -9e5)]
    found = nearest_boxes(spark.createDataFrame(probes, "probe int, x double, y double"), spark.createDataFrame(boxes, BOX), 3).collect()
    want = sorted(_brute(probes, boxes, 3))
    assert sorted((r.probe, r.zone_id, r["rank"]) for r in found) == [w[:3] for w in want]
    assert sorted((r.probe, r.zone_id, r.d) for r in found) == [(p, i, pytest.approx(d)) for p, i, _, d in sorted(want)]


def test_only_the_lowest_ids_of_a_cell_reach_its_probes(spark):
    boxes = [(i, -20.0 - i % 7, -20.0, 20.0, 20.0 + i % 5) for i in range(3000)]
    probes = spark.createDataFrame([(p, p % 9 - 4.0, p % 5 - 2.0) for p in range(400)], "probe int, x double, y double")
    found = holding_boxes(probes, *_over_cells(spark.createDataFrame(boxes, BOX), "zone_id"), 3, "probe", "zone_id")
    assert sorted({(r.zone_id, r["_rank"]) for r in found.collect()}) == [(0, 1), (1, 2), (2, 3)]
    assert nearest_boxes(probes, spark.createDataFrame(boxes, BOX), 3).count() == 1200
