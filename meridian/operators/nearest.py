"""Nearest boxes: two equi-joins on cells of doubling widths, no rounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import planar

from .joins import COVER, LEVELS, _at_levels, _in_cells, _levelled


#: Boxes that hold a probe are looked up in cells of the extent of the smallest boxes, but for this share of them.
SMALL = 0.05
#: Boxes over one cell from which on those that hold a probe are looked up before others are searched for.
CROWD = 64
KEYS = ["_level", "_cx", "_cy"]


def _lowest(rows: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_rank") <= k)


def _over_cells(boxes: DataFrame, box_id: str) -> tuple[DataFrame, float]:
    """A row for each cell that a box meets, at a level at which it has few, with its id and ``_box`` (null: it holds all of the cell); and the width of the smallest cells."""
    extent = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    least, most = boxes.agg(F.percentile_approx(extent, SMALL), F.max(extent)).first()
    size = max(least or 0.0, (most or 0.0) / (1 << LEVELS), 1e-9) / 8
    slack = F.col("_step") * 1e-9 + (F.abs(F.col("_cx")) + F.abs(F.col("_cy"))) * F.col("_step") * 1e-15
    low, high = lambda c: F.col(c) * F.col("_step") - slack, lambda c: (F.col(c) + 1) * F.col("_step") + slack
    whole = (F.col("xmin") <= low("_cx")) & (F.col("xmax") >= high("_cx")) & (F.col("ymin") <= low("_cy")) & (F.col("ymax") >= high("_cy"))
    return _in_cells(_levelled(boxes, size)).select(*KEYS, box_id, F.when(~whole, F.struct("xmin", "ymin", "xmax", "ymax")).alias("_box")), size


def _crowded(cells: DataFrame, k: int) -> bool:
    """Whether some cell lies in so many boxes that those who hold a probe are worth looking up first."""
    return (cells.where("_box is null").groupBy(*KEYS).count().agg(F.max("count")).first()[0] or 0) >= max(CROWD, k)


def holding_boxes(probes: DataFrame, cells: DataFrame, size: float, k: int, probe_id: str, box_id: str) -> DataFrame:
    """(probe, x, y, box, ``_rank``): of the boxes that hold a probe, borders included, the ``k`` lowest ids.

    Of the boxes that hold all of a cell only the ``k`` lowest ids matter to any probe in it, and of those that hold a part of it only ids
    below the ``k``-th such one: what a probe looks at doesn't grow with the boxes that lie over it.
    """
    levels = sorted(r[0] for r in cells.select("_level").distinct().collect())  # at most some twenty numbers
    full = _lowest(cells.where("_box is null").select(*KEYS, box_id), KEYS, box_id, k)
    kth = full.groupBy(*KEYS).agg(F.max(box_id).alias("_kth"), F.count("*").alias("_n")).where(F.col("_n") >= k).select(*KEYS, "_kth")
    part = cells.where("_box is not null").join(kth, KEYS, "left").where(F.col("_kth").isNull() | (F.col(box_id) < F.col("_kth")))
    held = part.select(*KEYS, box_id, "_box").unionByName(full.select(*KEYS, box_id, F.lit(None).cast(part.schema["_box"].dataType).alias("_box")))
    near = _at_levels(probes.select(probe_id, "x", "y"), levels or [0], size).join(held, KEYS)
    near = near.where(F.col("_box").isNull() | planar.box_contains(F.col("_box"), F.col("x"), F.col("y")))
    return _lowest(near.select(probe_id, "x", "y", box_id), [probe_id, "x", "y"], box_id, k)


def nearest_boxes(probes: DataFrame, boxes: DataFrame, k: int, size: float | None = None, probe_id: str = "probe", box_id: str = "zone_id", within: float | None = None) -> DataFrame:
    """The ``k`` boxes nearest to each probe (id, x, y) with distance ``d`` and ``rank``; lower ids win ties.  ``within``: none farther than that.

    Where many boxes lie over each other, probes in ``k`` boxes have them at distance 0 (:func:`holding_boxes`); the others are searched for.
    Cells of ``size`` and its doublings hold the boxes that come within a cell of them.  The first level at which a probe's
    cell holds ``k`` boxes bounds its distances by their farthest corners, the ``k``-th of them; all boxes within that bound are in the
    probe's cell at the first level as wide as it.  No boxes or k below 1: no rows.
    """
    corners = ("xmin", "ymin", "xmax", "ymax")
    known = boxes.select(box_id, *corners).where("xmin is not null")
    open_ = probes.select(probe_id, "x", "y").where("x - x = 0 and y - y = 0")
    extent = known.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax"), F.avg(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))), F.count("*")).first()
    span = open_.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if not extent[5] or span[0] is None or k < 1:
        kind = {c: t for c, t in boxes.dtypes}[box_id]
        return open_.select(probe_id, F.lit(None).cast(kind).alias(box_id), F.lit(0.0).alias("d"), F.lit(1).alias("rank")).limit(0)
    result = lambda rows: rows.select(probe_id, box_id, "d", "rank")
    inside, (over, width) = None, _over_cells(known, box_id)
    if (within is None or within >= 0) and extent[5] >= CROWD and _crowded(over, k):
        inside = holding_boxes(open_, over, width, k, probe_id, box_id)
        done = inside.where(F.col("_rank") == k).select(probe_id, "x", "y")
        inside = result(inside.join(done, [probe_id, "x", "y"], "left_semi").select(probe_id, box_id, F.lit(0.0).alias("d"), F.col("_rank").alias("rank")))
        open_ = open_.join(done, [probe_id, "x", "y"], "left_anti")
        span = open_.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        if span[0] is None:
            return inside
    farthest = max(max(extent[2], span[2]) - min(extent[0], span[0]), max(extent[3], span[3]) - min(extent[1], span[1]), 1e-9)
    step = max(size or max(extent[4] or 0, farthest / max(1.0, extent[5] ** 0.5)), farthest / (1 << LEVELS))
    levels = max(0, math.ceil(math.log2(2 * farthest / step))) + 1
    x, y = F.col("x"), F.col("y")

    def at(rows: DataFrame, level: Column) -> DataFrame:
        return rows.withColumn("_level", level).withColumn("_step", F.lit(step) * F.pow(F.lit(2.0), F.col("_level")))

    every = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    reach = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / F.col("_step")).cast("long") - 1, F.floor(F.col(high) / F.col("_step")).cast("long") + 1))
    cell = lambda rows: rows.withColumns({"_cx": F.floor(x / F.col("_step")).cast("long"), "_cy": F.floor(y / F.col("_step")).cast("long")})
    keys = ["_level", "_cx", "_cy"]
    # a box of many cells is left to the levels at which it has few, and to the last
    small = (F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) <= COVER * F.col("_step")) | (F.col("_level") == levels - 1)
    held = at(known, every).where(small).withColumn("_cx", reach("xmin", "xmax")).withColumn("_cy", reach("ymin", "ymax"))
    full = held.groupBy(*keys).agg(F.count("*").alias("_n")).where((F.col("_n") >= k) | (F.col("_level") == levels - 1)).select(*keys)
    first = cell(at(open_, every)).join(full, keys, "left_semi").groupBy(probe_id, "x", "y").agg(F.min("_level").alias("_level"))
    far = F.sqrt(F.pow(F.greatest(F.abs(x - F.col("xmin")), F.abs(x - F.col("xmax"))), 2) + F.pow(F.greatest(F.abs(y - F.col("ymin")), F.abs(y - F.col("ymax"))), 2))
    by_far = Window.partitionBy(probe_id, "x", "y").orderBy("_far")
    nth = cell(at(first, F.col("_level"))).join(held.drop("_step"), keys).select(probe_id, "x", "y", far.alias("_far")).withColumn("_rank", F.row_number().over(by_far))
    bound = nth.where(F.col("_rank") <= k).groupBy(probe_id, "x", "y").agg(F.max("_far").alias("_bound"))
    if within is not None:
        bound = bound.withColumn("_bound", F.least("_bound", F.lit(float(within))))
    wide = F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.ceil(F.log2(F.greatest("_bound", F.lit(step)) / step)))).cast("int")
    cover_all = at(known, every).withColumn("_cx", reach("xmin", "xmax")).withColumn("_cy", reach("ymin", "ymax"))
    near = cell(at(bound, wide)).join(cover_all.drop("_step"), keys)
    d = planar.box_distance(F.struct(*corners), x, y)
    near = near.select(probe_id, "x", "y", box_id, d.alias("d"), "_bound").where(F.col("d") <= F.col("_bound") * (1 + 1e-12))
    best = Window.partitionBy(probe_id, "x", "y").orderBy("d", box_id)
    found = result(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    return found if inside is None else inside.unionByName(found)
