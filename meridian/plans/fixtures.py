"""Geometry views derived from the driver's tables; the same SQL text runs in Spark and in DuckDB.

``with_views(sql)`` puts the definitions that a query needs in front of it as common table
expressions, for the oracle; ``view(spark, sf_dir, name)`` gives the same view as a DataFrame.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Views of positions, from which much is computed.
POSITIONS = ("pts", "geopts")
TABLES = ("orders", "supplier", "customer", "part", "events")

VIEWS = {
    "pts": "SELECT o_orderkey AS point_id, CAST((o_orderkey*7919) % 200000 AS DOUBLE)/100 - 1000 AS x, CAST((o_orderkey*104729+31337) % 200000 AS DOUBLE)/100 - 1000 AS y FROM orders",
    "zones": "SELECT s_suppkey AS zone_id, CAST((s_suppkey*61231) % 180000 AS DOUBLE)/100 - 900 AS cx, CAST((s_suppkey*40127+777) % 180000 AS DOUBLE)/100 - 900 AS cy, CAST(10 + (s_suppkey*37) % 90 AS DOUBLE) AS h, s_suppkey % 3 AS shape FROM supplier",
    "zone_vertices": """SELECT zone_id, ring, k, vx, vy FROM (
SELECT zone_id, 0 AS ring, 0 AS k, cx-h AS vx, cy-h AS vy FROM zones UNION ALL
SELECT zone_id, 0, 1, cx+h, cy-h FROM zones UNION ALL
SELECT zone_id, 0, 2, CASE WHEN shape=2 THEN cx ELSE cx+h END, cy+h FROM zones UNION ALL
SELECT zone_id, 0, 3, cx-h, cy+h FROM zones WHERE shape<>2 UNION ALL
SELECT zone_id, 1, 0, cx-h/2, cy-h/2 FROM zones WHERE shape=1 UNION ALL
SELECT zone_id, 1, 1, cx+h/2, cy-h/2 FROM zones WHERE shape=1 UNION ALL
SELECT zone_id, 1, 2, cx+h/2, cy+h/2 FROM zones WHERE shape=1 UNION ALL
SELECT zone_id, 1, 3, cx-h/2, cy+h/2 FROM zones WHERE shape=1) q""",
    "zone_edges": "SELECT zone_id, ring, k, vx AS x1, vy AS y1, coalesce(lead(vx) OVER w, first_value(vx) OVER w2) AS x2, coalesce(lead(vy) OVER w, first_value(vy) OVER w2) AS y2 FROM zone_vertices WINDOW w AS (PARTITION BY zone_id, ring ORDER BY k), w2 AS (PARTITION BY zone_id, ring ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "geopts": "SELECT c_custkey AS gid, CAST((c_custkey*7919) % 360000 AS DOUBLE)/1000 - 180 AS lon, CAST((c_custkey*104729) % 168000 AS DOUBLE)/1000 - 84 AS lat FROM customer",
    "cells": "SELECT CAST(p_partkey % 40 AS INT) AS x, CAST(floor(p_partkey/40) AS INT) AS y, CASE WHEN p_partkey % 17 = 0 THEN CAST(-9999 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS v FROM part",
    "cells2": "SELECT CAST(p_partkey % 40 AS INT) AS x, CAST(floor(p_partkey/40) AS INT) AS y, CASE WHEN p_partkey % 23 = 0 THEN CAST(-9999 AS DOUBLE) ELSE CAST(p_retailprice AS DOUBLE) END AS v FROM part",
    "line_pts": "SELECT o_custkey AS line_id, o_orderkey AS k, x, y FROM orders JOIN pts ON point_id = o_orderkey",
    "fixes": "SELECT event_id AS fix_id, CAST(((user_id*131+event_id)*7919) % 360000 AS DOUBLE)/1000 - 180 AS lon, CAST(((user_id*131+event_id)*104729) % 168000 AS DOUBLE)/1000 - 84 AS lat, ts FROM events",
    # point in zone, half-open, holes subtracted
    "inside": """SELECT point_id, zone_id FROM (SELECT p.point_id, e.zone_id, e.ring, CAST(sum(CASE WHEN (e.y1>p.y)<>(e.y2>p.y) THEN CASE WHEN p.x < (e.x1-e.x2)*(p.y-e.y2)/nullif(e.y1-e.y2,0)+e.x2 THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT)%2 AS ins
FROM pts p JOIN zones z ON p.x BETWEEN z.cx-z.h AND z.cx+z.h AND p.y BETWEEN z.cy-z.h AND z.cy+z.h JOIN zone_edges e ON e.zone_id=z.zone_id GROUP BY 1,2,3) r GROUP BY 1,2 HAVING max(CASE WHEN ring=0 THEN ins ELSE 0 END)=1 AND max(CASE WHEN ring>0 THEN ins ELSE 0 END)=0""",
}


def _needed(sql: str) -> list[str]:
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            for inner in [*_needed(VIEWS[name]), name]:
                if inner not in found:
                    found.append(inner)
    return sorted(found, key=list(VIEWS).index)


def with_views(sql: str) -> str:
    """``sql`` (a SELECT, or common table expressions and a SELECT) behind the views it names."""
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in _needed(sql))
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    body = re.sub(r"(?is)\Awith\s+(recursive\s+)?", "", body) if body.upper().startswith("WITH") else None
    head = f"WITH {'RECURSIVE ' * recursive}{parts}"
    if not parts:
        return sql.strip()
    return f"{head}, {body}" if body is not None else f"{head} {sql.strip()}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the Parquet tables of ``sf_dir``.

    Positions from fewer files than there are cores are dealt over all of them: a small file is one
    task, and what is computed for each position costs more than moving it.
    """
    sql = with_views(f"SELECT * FROM {name}")
    for t in TABLES:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", sql)
    rows = spark.sql(sql)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in POSITIONS and len(rows.inputFiles()) < cores else rows
