"""Joins look up a position once, however many points lie there."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meridian.functions import planar
from meridian.operators import joins


@pytest.fixture(scope="module")
def points(spark):
    """200 points at 20 positions, some of them nowhere."""
    place = F.col("id") % 20
    x = F.when(place == 19, F.lit(None)).when(place == 18, F.lit(float("nan"))).otherwise(place / 2.0)
    return spark.range(200).select(F.col("id").alias("point_id"), x.alias("x"), (place % 5).cast("double").alias("y"), F.concat(F.lit("p"), F.col("id")).alias("name"))


@pytest.fixture(scope="module")
def zones(spark):
    corner = lambda x, y: planar.point(F.col("id") * 1.5 + x, F.lit(float(y)))
    square = F.array(F.array(corner(0, 0), corner(3, 0), corner(3, 4), corner(0, 4)))
    return spark.range(5).select((4 - F.col("id")).alias("zone_id"), square.alias("polygon"), F.concat(F.lit("z"), F.col("id")).alias("label"))


@pytest.fixture(scope="module")
def pairs(points, zones):
    met = points.crossJoin(zones).where(planar.point_in_polygon(F.col("x"), F.col("y"), F.col("polygon")))
    return sorted((r.point_id, r.zone_id, r.name, r.label) for r in met.collect())


def test_positions_travel_once_and_columns_come_along(points, zones, pairs):
    assert joins._gathered(points, ["point_id"]).count() == 18
    assert joins._gathered(points.where("point_id < 20"), ["point_id"]).count() == 18
    found = joins.spatial_join(points, zones, keep=("name",), also=("label",))
    assert found.columns == ["point_id", "zone_id", "name", "label"]
    assert sorted(map(tuple, found.collect())) == pairs


def test_arrays_of_points_are_bounded(points, zones, pairs, monkeypatch):
    monkeypatch.setattr(joins, "TOGETHER", 2)
    assert joins._gathered(points, ["point_id"]).count() > 36
    assert sorted(map(tuple, joins.spatial_join(points, zones).collect())) == [p[:2] for p in pairs]


def test_counts_and_members(points, zones, pairs):
    counts = {r.zone_id: r.n for r in joins.point_counts(points, zones).collect()}
    assert counts == {z: sum(p[1] == z for p in pairs) for z in {p[1] for p in pairs}}
    assert sorted(r.point_id for r in joins.points_in_any(points, zones).collect()) == sorted({p[0] for p in pairs})


def test_batches_number_matches_in_order(points, zones, pairs):
    found = sorted(map(tuple, joins.spatial_join_batched(points, zones, 7).collect()))
    assert found == [(p[0], p[1], k // 7) for k, p in enumerate(pairs)]
    assert joins.spatial_join_batched(points, zones, 0).count() == 0


def test_nearest_takes_the_lowest_id_on_edges_too(points, zones):
    d = planar.distance_to_polygon(F.col("x"), F.col("y"), F.col("polygon"))
    every = points.where("x - x = 0").crossJoin(zones).select("point_id", "zone_id", d.alias("d"))
    want = {r.point_id: (r.m.zone_id, r.m.d) for r in every.groupBy("point_id").agg(F.min(F.struct("d", "zone_id")).alias("m")).collect()}
    found = joins.nearest_polygon_join(points.where("x - x = 0"), zones)
    assert {r.point_id: (r.zone_id, r.distance) for r in found.collect()} == want
