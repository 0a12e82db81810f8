"""Queries on keys for which the last digits of doubles decide, against their SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from meridian.plans import catalogue


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of suppliers and parts with the given keys, and a way to run a query and its SQL over it."""

    def make(suppliers, parts=()):
        for name, key, rows in (("supplier", "s_suppkey", suppliers), ("part", "p_partkey", parts)):
            frame = spark.createDataFrame([(k,) for k in rows], f"{key} long")
            if name == "part":
                frame = frame.withColumns({"p_size": (F.col(key) % 50).cast("int"), "p_retailprice": F.lit(1.0)})
            frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def both(spark, name, folder):
    with duckdb.connect() as db:
        for table in ("supplier", "part"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        want = db.execute(catalogue.ORACLE[name]).fetchall()
    return sorted(tuple(r) for r in catalogue.QUERIES[name](spark, folder).collect()), sorted(want)


def test_averages_under_zones_whose_sides_lie_on_borders_of_cells(spark, tables):
    zones = [1469, 3169, 7269, 11369, 13069, 15469, 21269, 23669, 5]
    middle = [((1100 - ((k * 40127 + 777) % 180000) / 100 + 800 + s * (10 + k * 37 % 90)) * 15) for k in zones for s in (-1, 1)]
    rows = sorted({int(m) + d for m in middle for d in range(-3, 4) if 0 <= int(m) + d < 29_999} | {29_999})
    got, want = both(spark, "raster_sample_average", tables(zones, [y * 40 + x for y in rows for x in range(40)]))
    assert any(v is not None for _, v in want)
    assert got == want


#: Zones with pairs whose areas in hundredths end in n.nnnn5.
TIES = [5, 1463, 6, 347, 9, 4154, 20, 899, 2, 872, 881, 5555, 1661, 11, 4838, 1, 1562, 2150, 1119, 1801, 4062]


@pytest.mark.parametrize("name", ["clip_common_area", "clip_union_area", "clip_difference_area", "clip_xor_area"])
def test_areas_that_round_by_their_last_digit(spark, tables, name):
    got, want = both(spark, name, tables(TIES))
    assert len(want) > 4
    assert got == want


def test_triangles_that_touch_by_their_last_digit(spark, tables):
    got, want = both(spark, "polygon_intersection_join", tables([233, 3593, 323, 3683, 953, 4313, 1403, 4763, 2483, 5843, 5, 1463]))
    assert len(want) > 0
    assert got == want


@pytest.mark.parametrize("name", ["rects_overlap", "clip_common_area", "polygon_intersection_join"])
def test_zones_whose_sides_touch_but_whose_centres_are_too_far_apart_by_a_last_digit(spark, tables, name):
    got, want = both(spark, name, tables([4022, 50822, 678, 24278, 5780, 46780, 3827, 33227]))
    assert got == want
