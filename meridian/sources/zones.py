"""Polygons from vertex tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def polygons_from_vertices(vertices: DataFrame, polygon_id: str = "zone_id") -> DataFrame:
    """(id, polygon) from rows (id, ring, k, vx, vy): rings by number, vertices by ``k``."""
    point = F.struct("k", F.col("vx").alias("x"), F.col("vy").alias("y"))
    rings = vertices.groupBy(polygon_id, "ring").agg(F.sort_array(F.collect_list(point)).alias("p"))
    bare = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    ordered = rings.select(polygon_id, F.struct("ring", bare.alias("r")).alias("s")).groupBy(polygon_id).agg(F.sort_array(F.collect_list("s")).alias("s"))
    return ordered.select(polygon_id, F.transform("s", lambda s: s["r"]).alias("polygon"))


def lines_from_points(points: DataFrame, line_id: str = "line_id") -> DataFrame:
    """(id, line) from rows (id, k, x, y) in the order of ``k``."""
    ordered = points.groupBy(line_id).agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("p"))
    return ordered.select(line_id, F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("line"))
