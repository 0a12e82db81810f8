"""Every registered geospatial query against its DuckDB oracle on the smallest tables, and what plans must not contain."""

import os

import duckdb
import pytest

from meridian.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", ["pip_join", "polygon_intersection_join", "nearest_zone"])
def test_joins_have_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_cell_size_does_not_change_the_join(spark):
    from meridian.operators import joins
    from meridian.plans.fixtures import view
    from meridian.plans.planar_queries import polygons

    points, zones = view(spark, SF, "pts"), polygons(spark, SF)
    results = [sorted(map(tuple, joins.spatial_join(points, zones, size).collect())) for size in (None, 17.0, 500.0)]
    assert results[0] == results[1] == results[2]
