"""Unions of many polygons as an aggregate: by tiles, then across their borders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.functions import overlay, planar

#: Shapes that one task unites at a time.
FAN = 256


def dissolve(polygons: DataFrame, by: list[str], size: float, geometry: str = "polygon") -> DataFrame:
    """(``by``, ``shape``): the union of each group's polygons as one multipolygon.

    Polygons of a tile of ``size`` are dealt into lots of at most about FAN, lots are united, and in each round the unions of FAN
    lots, then of four tiles, so that no task holds more than so many shapes whatever the crowd in a tile, and
    what vanishes inside of a union travels no further.  Null and empty polygons add nothing; a group without any other has none.
    """
    x, y = "_tx", "_ty"
    box = planar.polygon_bbox(F.col(geometry))
    placed = polygons.select(*by, F.col(geometry).alias("_p"), box.alias("_b")).where("_b is not null")
    tile = lambda low, high: F.floor((F.col(f"_b.{low}") + F.col(f"_b.{high}")) / 2 / size).cast("long")
    placed = placed.select(*by, "_p", tile("xmin", "xmax").alias(x), tile("ymin", "ymax").alias(y))
    crowd = placed.groupBy(*by, x, y).agg(F.ceil(F.count("*") / FAN).cast("long").alias("_lots"))
    span = crowd.agg(F.max("_lots"), F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if span[0] is None:
        return polygons.select(*by, F.lit(None).cast(overlay.MULTIPOLYGON).alias("shape")).limit(0)
    crowd = crowd.toDF(*[f"_k{k}" for k in range(len(by) + 2)], "_lots")
    same = [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate([*by, x, y])]
    dealt = placed.join(crowd, same).select(*by, x, y, F.pmod(F.xxhash64("_p"), F.col("_lots")).alias("_lot"), F.array("_p").alias("_m"))

    def united(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by, x, y, "_lot").agg(F.flatten(F.collect_list("_m")).alias("_m")).withColumn("_m", overlay.union_all(F.col("_m")))

    done, lots = united(dealt), span[0]
    while lots > 1:
        lots = -(-lots // FAN)
        done = united(done.withColumn("_lot", F.col("_lot") % lots if lots > 1 else F.lit(0).cast("long")))
    low, high = min(span[1], span[3]), max(span[2], span[4])
    while low != high:
        low, high = low >> 1, high >> 1
        if (low, high) == (-1, 0):  # halving never joins the two sides of an axis
            low = high = 0
            done = united(done.withColumns({x: F.lit(0).cast("long"), y: F.lit(0).cast("long")}))
        else:
            done = united(done.withColumns({x: F.shiftright(x, 1), y: F.shiftright(y, 1)}))
    return done.select(*by, F.col("_m").alias("shape"))
