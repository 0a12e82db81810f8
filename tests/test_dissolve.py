"""Unions as an aggregate against grids of cells, with crowded tiles and groups that are null."""

import random

from pyspark.sql import functions as F

from meridian.functions import planar
from meridian.operators import dissolve


def test_dissolved_squares_cover_what_they_did(spark, monkeypatch):
    monkeypatch.setattr(dissolve, "FAN", 5)
    rng = random.Random(6)
    rows = []
    for k in range(260):
        group = rng.choice(["a", "b", None])
        x, y = (rng.randint(-12, 12), rng.randint(-12, 12)) if k % 2 else (rng.randint(0, 2), rng.randint(0, 2))  # half of them in one tile
        w, h = rng.randint(1, 4), rng.randint(1, 3)
        rows.append((group, x, y, w, h))
    square = lambda x, y, w, h: [[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]]
    df = spark.createDataFrame([(g, square(*r)) for g, *r in rows] + [("a", None), ("c", []), ("c", None)], f"g string, polygon {planar.POLYGON}")
    cells = {}
    for g, x, y, w, h in rows:
        cells.setdefault(g, set()).update((i, j) for i in range(x, x + w) for j in range(y, y + h))
    for size in (4.0, 1000.0):
        got = {r.g: r.a for r in dissolve.dissolve(df, ["g"], size).select("g", planar.multipolygon_area(F.col("shape")).alias("a")).collect()}
        assert {g: round(a, 6) for g, a in got.items()} == {g: len(c) for g, c in cells.items()}
    assert dissolve.dissolve(df.limit(0), ["g"], 4.0).count() == 0
    whole = dissolve.dissolve(df, [], 4.0).select(planar.multipolygon_area(F.col("shape")).alias("a")).collect()
    assert [round(r.a, 6) for r in whole] == [len(set().union(*cells.values()))]
