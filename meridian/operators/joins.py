"""Spatial joins as equi-joins on grid cells.

A point lies in one cell, a polygon covers those its box meets, so an equi-join on the cell gives
every candidate once; box and exact tests follow as filters.  Spark chooses broadcast or shuffle by
size and splits crowded cells (AQE skew join).  The payload of either side isn't carried through the
join: ids come out, and attributes are joined to them late.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import planar, relate, strips
from meridian.functions.binding import bind, named

Measure = Callable[[Column, Column], Column]
#: Cells across that a polygon has at most at its own level in a join of points.
ACROSS = 8
#: Cells across that a box may have at a level that is searched for any polygon at all.
COVER = 16
#: Cells of more polygons than this aren't sent to all tasks, whatever the sizes of files suggest.
MANY = 20_000
#: Points of one position that travel as one row.
TOGETHER = 4096
#: Doublings between the smallest cells of a nearest search and all there is.
LEVELS = 20


def cell_size(polygons: DataFrame) -> float:
    """Median extent of the polygons' boxes: one small aggregate, the only job that runs early."""
    row = polygons.agg(F.percentile_approx(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")), 0.5), F.max(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))).first()
    return max(float(row[0] or 0), float(row[1] or 0) / 1024, 1e-9)


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("long")


def with_box(polygons: DataFrame, geometry: str = "polygon") -> DataFrame:
    box = planar.polygon_bbox(F.col(geometry))
    return polygons.withColumn("_b", box).withColumns({c: F.col(f"_b.{c}") for c in ("xmin", "ymin", "xmax", "ymax")}).drop("_b")


def cover(polygons: DataFrame, size: float) -> DataFrame:
    """A row for each cell that a polygon's box meets (columns ``_cx``, ``_cy``)."""
    across = polygons.withColumn("_cx", F.explode(F.sequence(_cell(F.col("xmin"), size), _cell(F.col("xmax"), size))))
    return across.withColumn("_cy", F.explode(F.sequence(_cell(F.col("ymin"), size), _cell(F.col("ymax"), size))))


def _levelled(boxes: DataFrame, size: float) -> DataFrame:
    """``_level`` of each box: at ``size`` doubled so many times it has at most ACROSS cells each way; and that ``_step``."""
    extent = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(size)) / (ACROSS * size)))).cast("int")
    return boxes.withColumn("_level", level).withColumn("_step", F.lit(float(size)) * F.pow(F.lit(2.0), F.col("_level")))


def _in_cells(boxes: DataFrame) -> DataFrame:
    """A row for each cell of its level that a box meets."""
    reach = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / F.col("_step")).cast("long"), F.floor(F.col(high) / F.col("_step")).cast("long")))
    return boxes.withColumn("_cx", reach("xmin", "xmax")).withColumn("_cy", reach("ymin", "ymax"))


def _levels_of(boxes: DataFrame, size: float) -> list[int]:
    """The levels in use: at most some fifty numbers."""
    return sorted(r[0] for r in _levelled(boxes, size).select("_level").distinct().collect())


def _at_levels(points: DataFrame, levels: list[int], size: float) -> DataFrame:
    """``points`` (with x, y) once for each level, with their cell there."""
    known = points.where("x - x = 0 and y - y = 0")  # neither null nor infinite
    probes = known.withColumn("_level", F.lit(levels[0]) if len(levels) == 1 else F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    step = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("_level"))
    return probes.withColumns({"_cx": F.floor(F.col("x") / step).cast("long"), "_cy": F.floor(F.col("y") / step).cast("long")})


def _own_edges(polygon: Column) -> Column:
    """What decides about points of a cell: for each ring the edges that a ray to the right may or may not cross, depending on the
    point, and whether those that it crosses from anywhere in the cell are odd in number."""
    slack = F.col("_step") * 1e-9 + (F.abs(F.col("_cx")) + F.abs(F.col("_cy"))) * F.col("_step") * 1e-15
    left, low = F.col("_cx") * F.col("_step") - slack, F.col("_cy") * F.col("_step") - slack
    right, high = (F.col("_cx") + 1) * F.col("_step") + slack, (F.col("_cy") + 1) * F.col("_step") + slack

    def ring(points: Column) -> Column:
        def reached(e: Column) -> Column:
            return (F.greatest(e["y1"], e["y2"]) > low) & (F.least(e["y1"], e["y2"]) <= high) & (F.greatest(e["x1"], e["x2"]) >= left)

        always = lambda e: (F.least(e["x1"], e["x2"]) > right) & (F.least(e["y1"], e["y2"]) <= low) & (F.greatest(e["y1"], e["y2"]) > high)

        def told(near: Column) -> Column:
            return named(odd=F.size(F.filter(near, always)) % 2 == 1, edges=F.filter(near, lambda e: ~always(e)))

        return bind(F.when(F.size(points) >= 3, F.filter(planar.edges(points), reached)).otherwise(F.filter(planar.edges(points), lambda e: F.lit(False))), told)

    return F.transform(polygon, ring)


def _decided(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point of the cell lies in the polygon: in its first ring and in no other."""
    odd = lambda r: F.aggregate(r["edges"], r["odd"], lambda acc, e: acc != F.coalesce(planar.crosses_ray(x, y, e), F.lit(False)))
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return bind(F.get(rings, F.lit(0)), odd) & ~F.exists(holes, odd)


def _gathered(points: DataFrame, carried: list[str]) -> DataFrame:
    """``points`` with their columns ``carried`` as an array of structs, ``_at``: points of one position are one row where positions repeat.

    An aggregate without a shuffle tells whether they do; streams are left as they are.  A row holds some TOGETHER points.
    """
    known, whole = points.where("x - x = 0 and y - y = 0"), F.struct(*carried)
    if not points.isStreaming:
        n, different = known.agg(F.count("*"), F.approx_count_distinct(F.struct("x", "y"))).first()
        if n > 2 * different:
            most = known.groupBy("x", "y").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
            salt = F.pmod(F.xxhash64(carried[0]), F.lit(math.ceil(most / TOGETHER)))
            return known.groupBy("x", "y", salt.alias("_salt")).agg(F.collect_list(whole).alias("_at")).drop("_salt")
    return known.select("x", "y", F.array(whole).alias("_at"))


def _boxed(polygons: DataFrame, polygon_id: str, also: tuple[str, ...] = ()) -> DataFrame:
    return with_box(polygons.select(polygon_id, "polygon", *also)).where("xmin - xmin = 0 and xmax - xmax = 0 and ymin - ymin = 0 and ymax - ymax = 0")


def _deciding(boxed: DataFrame, size: float, carried: list[str]) -> DataFrame:
    """The cells of each polygon that aren't outside of it, with ``_rings`` to decide by; null for cells inside."""
    cells = _in_cells(_levelled(boxed, size)).withColumn("_rings", _own_edges(F.col("polygon")))
    empty = F.forall("_rings", lambda r: F.size(r["edges"]) == 0)
    inside = F.get("_rings", F.lit(0))["odd"] & ~F.exists(F.slice("_rings", 2, F.greatest(F.size("_rings") - 1, F.lit(0))), lambda r: r["odd"])
    cells = cells.where(~empty | inside).withColumn("_rings", F.when(~empty, F.col("_rings")))
    return cells.select(*carried, "xmin", "ymin", "xmax", "ymax", "_level", "_cx", "_cy", "_rings")


def _inside(rows: DataFrame, polygons: DataFrame, size: float | None, polygon_id: str, also: tuple[str, ...] = (), on: bool = False) -> DataFrame:
    """``rows`` (with x, y) for each polygon part that holds them, with its id and columns ``also``; ``on``: or has an edge through them."""
    boxed = _boxed(polygons, polygon_id, also)
    size = size or cell_size(boxed)
    x, y = F.col("x"), F.col("y")
    counts = {r["_level"]: r["count"] for r in _levelled(boxed, size).groupBy("_level").count().collect()}  # at most some fifty rows
    cells = _deciding(boxed, size, [polygon_id, *also])
    if sum(counts.values()) > MANY:
        cells = cells.hint("merge")
    near = _at_levels(rows, sorted(counts) or [0], size).join(cells, ["_level", "_cx", "_cy"]).where(_in_box(x, y))
    holds = _decided(x, y, F.col("_rings"))
    if on:
        holds = holds | F.exists("_rings", lambda r: F.exists(r["edges"], lambda e: planar.distance_to_segment(x, y, e) == 0))
    return near.where(F.col("_rings").isNull() | holds)


def spatial_join(points: DataFrame, polygons: DataFrame, size: float | None = None, point_id: str = "point_id", polygon_id: str = "zone_id", keep: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """(point, polygon) ids of every point in every polygon, a row for each polygon part.

    ``points``: id, x, y.  ``polygons``: id, polygon.  Half-open boundaries; coordinates that are null or not finite match nothing.
    A polygon becomes at most some hundred cells, of a level that suits its extent, each with the edges that matter there:
    none for a cell that lies inside, and cells outside are left out.  No polygon goes through the exchange.  Points of one position
    are looked up once.  Narrow columns of points (``keep``) and of polygons (``also``) come along, so that results, which may be
    far more than either, needn't be joined again.
    """
    rows = _gathered(points.select(point_id, "x", "y", *(c for c in keep if c not in ("x", "y"))), [point_id, *keep])
    return _inside(rows, polygons, size, polygon_id, also).select(F.inline("_at"), polygon_id, *also).select(point_id, polygon_id, *keep, *also)


def points_in_any(points: DataFrame, polygons: DataFrame, size: float | None = None, point_id: str = "point_id", polygon_id: str = "zone_id") -> DataFrame:
    """The rows of ``points`` (id, x, y and any other columns) that lie in some polygon, each once."""
    places = points.select("x", "y").distinct()
    held = _inside(places, polygons, size, polygon_id).select("x", "y").distinct()
    return points.join(held, ["x", "y"], "left_semi")


def point_counts(points: DataFrame, polygons: DataFrame, size: float | None = None, polygon_id: str = "zone_id") -> DataFrame:
    """(polygon, n): how many points lie in each polygon that holds any.  Points of one position are counted before they meet polygons."""
    places = points.groupBy("x", "y").agg(F.count("*").alias("_n"))
    return _inside(places, polygons, size, polygon_id).groupBy(polygon_id).agg(F.sum("_n").alias("n"))


def _in_box(x: Column, y: Column) -> Column:
    return (x >= F.col("xmin")) & (x <= F.col("xmax")) & (y >= F.col("ymin")) & (y <= F.col("ymax"))


def box_join(points: DataFrame, polygons: DataFrame, size: float | None = None, point_id: str = "point_id", polygon_id: str = "zone_id") -> DataFrame:
    """(point, polygon) ids and the point's x and y for every point in the box of every polygon, borders included."""
    boxed = with_box(polygons.select(polygon_id, "polygon")).drop("polygon").where("xmin is not null")
    size = size or cell_size(boxed)
    near = _at_levels(points.select(point_id, "x", "y"), _levels_of(boxed, size) or [0], size).join(_in_cells(_levelled(boxed, size)), ["_level", "_cx", "_cy"])
    return near.where(_in_box(F.col("x"), F.col("y"))).select(point_id, polygon_id, "x", "y")


def point_relations(points: DataFrame, polygons: DataFrame, size: float | None = None, point_id: str = "point_id", polygon_id: str = "zone_id") -> DataFrame:
    """(point, polygon, ``matrix``): DE-9IM of every point and every polygon whose box holds it; points of one position are related once."""
    boxed = _boxed(polygons, polygon_id)
    size = size or cell_size(boxed)
    counts = {r["_level"]: r["count"] for r in _levelled(boxed, size).groupBy("_level").count().collect()}
    cells = _in_cells(_levelled(boxed, size))
    if sum(counts.values()) > MANY:
        cells = cells.hint("merge")
    x, y = F.col("x"), F.col("y")
    near = _at_levels(_gathered(points, [point_id]), sorted(counts) or [0], size).join(cells, ["_level", "_cx", "_cy"]).where(_in_box(x, y))
    told = near.select("_at", polygon_id, relate.relate_point_polygon(x, y, F.col("polygon")).alias("matrix"))
    return told.select(F.inline("_at"), polygon_id, "matrix").select(point_id, polygon_id, "matrix")


def _box_pairs(sides: dict[str, DataFrame], size: float | None) -> DataFrame:
    """Rows of the sides ``l`` and ``r`` (with boxes; other columns must differ) whose boxes meet, each pair once, boxes with suffixes ``_l`` and ``_r``.

    They meet in cells; a pair is kept in the cell that holds the lower left corner of the boxes' common part only: there one of the
    boxes begins, either way.
    """
    names = ("xmin", "ymin", "xmax", "ymax")
    size = size or cell_size(sides["l"].select(*names).unionByName(sides["r"].select(*names)))
    first = {"_fx": F.col("_cx") == _cell(F.col("xmin"), size), "_fy": F.col("_cy") == _cell(F.col("ymin"), size)}
    covered = {k: cover(rows, size).withColumns(first).withColumnsRenamed({c: f"{c}_{k}" for c in (*names, *first)}) for k, rows in sides.items()}
    corner = (F.col("_fx_l") | F.col("_fx_r")) & (F.col("_fy_l") | F.col("_fy_r"))
    meet = (F.col("xmin_l") <= F.col("xmax_r")) & (F.col("xmin_r") <= F.col("xmax_l")) & (F.col("ymin_l") <= F.col("ymax_r")) & (F.col("ymin_r") <= F.col("ymax_l"))
    # files of polygons are far smaller than the pairs: neither their size nor that of exchanges says how much there is to do
    session = covered["l"].sparkSession
    tasks = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    dealt = covered["l"].repartition(tasks, "_cx", "_cy")
    return dealt.join(covered["r"].hint("merge"), ["_cx", "_cy"]).where(corner & meet).drop("_cx", "_cy", "_fx_l", "_fy_l", "_fx_r", "_fy_r")


def polygon_pairs(left: DataFrame, right: DataFrame, size: float | None = None, left_id: str = "left_id", right_id: str = "right_id", also: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of polygons whose boxes meet, each pair once, with both polygons, boxes and columns ``also`` (suffixes ``_l``, ``_r``).

    Ids and boxes meet in cells.  The polygons join their pairs afterwards, by id and hash.
    """
    keyed = lambda rows, i, k: with_box(rows.select(F.col(i), F.col("polygon"), F.xxhash64("polygon").alias(f"_h_{k}"), *(F.col(c).alias(f"{c}_{k}") for c in also)))
    sides = {"l": (keyed(left, left_id, "l"), left_id), "r": (keyed(right, right_id, "r"), right_id)}
    pairs = _box_pairs({k: rows.drop("polygon") for k, (rows, _) in sides.items()}, size)
    for k, (rows, i) in sides.items():
        own = rows.select(i, f"_h_{k}", F.col("polygon").alias(f"polygon_{k}")).dropDuplicates([i, f"_h_{k}"])
        pairs = pairs.join(own, [i, f"_h_{k}"])
    return pairs.drop("_h_l", "_h_r")


def polygon_measures(left: DataFrame, right: DataFrame, of_boxes: Measure, of_polygons: Measure, name: str, size: float | None = None, left_id: str = "left_id", right_id: str = "right_id", ordered: bool = False) -> DataFrame:
    """(left, right, ``name``) for the pairs of :func:`polygon_pairs`; ``ordered``: only those whose left id is the smaller one.

    Two polygons that are boxes are measured by their sides (``of_boxes`` of the boxes): no polygon joins such a pair and none
    goes to Python.  All other pairs are measured by ``of_polygons``.
    """
    told = lambda rows: rows.withColumn("_box", planar.is_box(F.col("polygon")))
    kept = lambda pairs: pairs.where(F.col(left_id) < F.col(right_id)) if ordered else pairs
    (l_boxes, l_other), (r_boxes, r_other) = ((rows.where("_box").drop("_box"), rows.where("not _box").drop("_box")) for rows in (told(left), told(right)))
    box = lambda k: F.struct(*[F.col(f"{c}_{k}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    boxed = kept(_box_pairs({"l": with_box(l_boxes.select(left_id, "polygon")).drop("polygon"), "r": with_box(r_boxes.select(right_id, "polygon")).drop("polygon")}, size))
    found = boxed.select(left_id, right_id, of_boxes(box("l"), box("r")).alias(name))
    for a, b in ((l_other, right), (l_boxes, r_other)):
        pairs = kept(polygon_pairs(a, b, size, left_id, right_id))
        found = found.unionByName(pairs.select(left_id, right_id, of_polygons(F.col("polygon_l"), F.col("polygon_r")).alias(name)))
    return found


def polygon_overlays(left: DataFrame, right: DataFrame, of_strips: Measure, of_polygons: Measure, name: str, size: float | None = None, left_id: str = "left_id", right_id: str = "right_id", also: tuple[str, ...] = (), where: str | None = None, corners: bool = False) -> DataFrame:
    """(left, right, ``name``) for the pairs of :func:`polygon_pairs`; ``where``: for those of them for which it holds, of ids and of columns ``also`` (suffixes ``_l``, ``_r``).

    Polygons of few corners (:mod:`meridian.functions.strips`) travel as a few numbers with their boxes through the cells, and their
    pairs are measured by ``of_strips`` (of strips with ``corners`` or without): no such pair goes through an exchange.  All other
    pairs are measured by ``of_polygons``.
    """
    kept = lambda pairs: pairs if where is None else pairs.where(where)
    told = lambda rows, i: rows.select(i, "polygon", *also, strips.strips(F.col("polygon"), corners).alias("_s"))
    sides = {"l": told(left, left_id), "r": told(right, right_id)}
    named_apart = lambda rows, k: rows.withColumnsRenamed({c: f"{c}_{k}" for c in also})
    plain = {k: named_apart(with_box(rows.where("_s is not null")).drop("polygon"), k).withColumnRenamed("_s", f"_s_{k}") for k, rows in sides.items()}
    found = kept(_box_pairs(plain, size)).select(left_id, right_id, of_strips(F.col("_s_l"), F.col("_s_r")).alias(name))
    plain_l, other_l, other_r = sides["l"].where("_s is not null"), sides["l"].where("_s is null"), sides["r"].where("_s is null")
    for a, b in ((other_l, right), (plain_l, other_r)):
        pairs = kept(polygon_pairs(a, b, size, left_id, right_id, also))
        found = found.unionByName(pairs.select(left_id, right_id, of_polygons(F.col("polygon_l"), F.col("polygon_r")).alias(name)))
    return found


def polygon_intersection_join(left: DataFrame, right: DataFrame, size: float | None = None, left_id: str = "left_id", right_id: str = "right_id", also: tuple[str, ...] = (), where: str | None = None) -> DataFrame:
    """Ids of polygons that intersect; touching counts.  Polygons of few corners are compared as their doubles are, others within a tolerance.  ``also``, ``where``: as in :func:`polygon_overlays`."""
    pairs = polygon_overlays(left, right, strips.intersect, planar.polygons_intersect, "_meet", size, left_id, right_id, also, where, corners=True)
    return pairs.where("_meet").select(left_id, right_id)


def _passed(parts: DataFrame, size: float) -> DataFrame:
    """A row for each cell that a segment ``_s`` passes, with its ordinates in that column of cells (``_lo``, ``_hi``) and in the one before (``_plo``, ``_phi``; null in the first)."""
    x1, y1, x2, y2 = (F.col(f"_s.{c}") for c in ("x1", "y1", "x2", "y2"))
    slope = F.try_divide(y2 - y1, x2 - x1)
    slack = 1e-8 * (F.abs(x2 - x1) + F.abs(y2 - y1) + size)
    parts = parts.withColumns({"_first": _cell(F.col("xmin"), size), "_slope": slope, "_slack": slack})
    parts = parts.withColumn("_cx", F.explode(F.sequence("_first", _cell(F.col("xmax"), size))))

    def reach(column: Column) -> list[Column]:
        at = [y1 + (F.greatest(F.col("xmin"), F.least(F.col("xmax"), edge * F.lit(float(size)))) - x1) * F.col("_slope") for edge in (column, column + 1)]
        off = F.col("_slack") + F.abs("_slope") * (F.abs(column) + 1) * (size * 1e-15)  # where a steep segment meets a border is known less well
        low, high = F.greatest(F.col("ymin"), F.least(*at) - off), F.least(F.col("ymax"), F.greatest(*at) + off)
        return [F.when(F.col("_slope").isNull(), F.col("ymin")).otherwise(low), F.when(F.col("_slope").isNull(), F.col("ymax")).otherwise(high)]

    own, before = reach(F.col("_cx")), reach(F.col("_cx") - 1)
    earlier = F.col("_cx") > F.col("_first")
    parts = parts.withColumns({"_lo": own[0], "_hi": own[1], "_plo": F.when(earlier, before[0]), "_phi": F.when(earlier, before[1])}).drop("_first", "_slope", "_slack")
    return parts.withColumn("_cy", F.explode(F.sequence(_cell(F.col("_lo"), size), _cell(F.col("_hi"), size))))


def line_polygon_join(lines: DataFrame, polygons: DataFrame, size: float | None = None, line_id: str = "line_id", polygon_id: str = "zone_id") -> DataFrame:
    """(line, polygon) ids of lines that have a vertex in a polygon or a segment that meets one of its rings, each pair once.

    Segments are put into the cells that they pass, not those of their boxes.  A pair is tested in the first column of cells that both
    share, in the lowest cell there.  What lies to one side of a segment drops out by its box; where an outer ring is a box, a
    segment that reaches from outside well into it meets it; only other pairs are tested edge by edge.
    """
    boxed = with_box(polygons.select(polygon_id, "polygon")).where("xmin - xmin = 0 and xmax - xmax = 0 and ymin - ymin = 0 and ymax - ymax = 0")
    size = size or cell_size(boxed)
    vertices = lines.select(line_id, F.inline("line")).select(line_id, "x", "y")
    inside = spatial_join(vertices, polygons, size, line_id, polygon_id)
    names = ("xmin", "ymin", "xmax", "ymax")
    parts = lines.select(line_id, F.explode(planar.segments(F.col("line"))).alias("_s")).where("_s.x1 - _s.x1 = 0 and _s.y1 - _s.y1 = 0 and _s.x2 - _s.x2 = 0 and _s.y2 - _s.y2 = 0")
    low, high = lambda v: F.least(f"_s.{v}1", f"_s.{v}2"), lambda v: F.greatest(f"_s.{v}1", f"_s.{v}2")
    near = 2e-9 + 1e-13 * F.greatest(*[F.abs(f"_s.{c}") for c in ("x1", "y1", "x2", "y2")])  # segments touch within a tolerance
    parts = _passed(parts.withColumns({"xmin": low("x") - near, "ymin": low("y") - near, "xmax": high("x") + near, "ymax": high("y") + near}), size).withColumnsRenamed({c: f"{c}_l" for c in names})
    outer = planar.is_box(F.slice("polygon", 1, 1))
    zones = boxed.select(polygon_id, *names, outer.alias("_plain"), F.flatten(F.transform("polygon", planar.edges)).alias("_edges"))
    zones = cover(zones, size).withColumnsRenamed({c: f"{c}_r" for c in names})
    l, r = ({c: F.col(f"{c}_{k}") for c in names} for k in "lr")  # noqa: E741
    here = (F.col("_lo") <= r["ymax"]) & (F.col("_hi") >= r["ymin"]) & (F.col("_cy") == F.greatest(_cell(F.col("_lo"), size), _cell(r["ymin"], size)))
    before = F.coalesce((F.col("_plo") <= r["ymax"]) & (F.col("_phi") >= r["ymin"]), F.lit(False)) & (_cell(r["xmin"], size) < F.col("_cx"))
    meet = (l["xmin"] <= r["xmax"]) & (r["xmin"] <= l["xmax"]) & (l["ymin"] <= r["ymax"]) & (r["ymin"] <= l["ymax"])
    dx, dy = F.abs(F.col("_s.x2") - F.col("_s.x1")), F.abs(F.col("_s.y2") - F.col("_s.y1"))
    width, height = (r["xmax"] - r["xmin"]) / 2, (r["ymax"] - r["ymin"]) / 2
    off = F.abs((F.col("_s.x2") - F.col("_s.x1")) * ((r["ymin"] + r["ymax"]) / 2 - F.col("_s.y1")) - (F.col("_s.y2") - F.col("_s.y1")) * ((r["xmin"] + r["xmax"]) / 2 - F.col("_s.x1")))
    tol = 1e-8 * (dx + dy) * (dx + dy + width + height)
    pairs = parts.join(zones, ["_cx", "_cy"]).where(meet & here & ~before & (off <= dx * height + dy * width + tol))
    gap = 1e-6 * (dx + dy + width + height)
    beyond = (l["xmin"] < r["xmin"] - gap) | (l["xmax"] > r["xmax"] + gap) | (l["ymin"] < r["ymin"] - gap) | (l["ymax"] > r["ymax"] + gap)
    well = (l["xmin"] <= r["xmax"] - gap) & (r["xmin"] <= l["xmax"] - gap) & (l["ymin"] <= r["ymax"] - gap) & (r["ymin"] <= l["ymax"] - gap)
    sure = F.col("_plain") & beyond & well & (off <= dx * height + dy * width - tol)
    crossing = pairs.where(F.when(sure, True).otherwise(planar.any_segments_meet(F.array("_s"), F.col("_edges")))).select(line_id, polygon_id)
    return inside.unionByName(crossing).distinct()


def nearest_polygon_join(points: DataFrame, polygons: DataFrame, size: float | None = None, point_id: str = "point_id", polygon_id: str = "zone_id") -> DataFrame:
    """For each point the polygon at the smallest distance (0 inside) and that distance; the lowest id wins ties.

    Cells of ``size`` and of its doublings, up to one that spans everything, hold the polygons whose
    boxes come within a cell of them.  A point's first level at which its cell holds a polygon bounds
    its distance: the farthest corner of that box, at most.  What lies within the bound is in the
    point's cell at the first level as wide as the bound; box distances sort out most of it before the
    exact distances.  Two equi-joins, no rounds.  No polygons: no rows.  Points of one position are looked up once, and those
    in a polygon or on an edge are found by :func:`spatial_join`'s cells before the search.
    """
    boxed = with_box(polygons.select(polygon_id, "polygon")).where("xmin is not null")
    open_ = points.select(point_id, "x", "y").where("x is not null and y is not null")
    places = open_.select("x", "y").distinct().withColumn("_place", F.struct("x", "y"))
    held = _inside(places, polygons, size, polygon_id, on=True).groupBy("_place").agg(F.min(polygon_id).alias(polygon_id)).withColumn("distance", F.lit(0.0))
    far_off = _nearest(places.join(held, "_place", "left_anti"), boxed, size, "_place", polygon_id)
    found = held.unionByName(far_off).withColumns({"x": F.col("_place.x"), "y": F.col("_place.y")})
    return open_.join(found, ["x", "y"]).select(point_id, polygon_id, "distance")


def _nearest(open_: DataFrame, boxed: DataFrame, size: float | None, point_id: str, polygon_id: str) -> DataFrame:
    """:func:`nearest_polygon_join` of any points by the search that it describes."""
    corners = [F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")]
    extent, span = boxed.agg(*corners).first(), open_.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if extent[0] is None or span[0] is None:
        return open_.select(point_id, F.lit(None).cast("long").alias(polygon_id), F.lit(0.0).alias("distance")).limit(0)
    farthest = max(max(extent[2], span[2]) - min(extent[0], span[0]), max(extent[3], span[3]) - min(extent[1], span[1]), 1e-9)
    step = max(size or cell_size(boxed), farthest / (1 << LEVELS))
    steps = [step * 2**k for k in range(max(0, math.ceil(math.log2(2 * farthest / step))) + 1)]

    def levelled(rows: DataFrame, levels: Column) -> DataFrame:
        return rows.withColumn("_level", levels).withColumn("_step", F.lit(step) * F.pow(F.lit(2.0), F.col("_level")))

    x, y, box = F.col("x"), F.col("y"), boxed.drop("polygon")
    every = F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))
    reach = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / F.col("_step")).cast("long") - 1, F.floor(F.col(high) / F.col("_step")).cast("long") + 1))
    # a box of many cells is left to the levels at which it has few, and to the last
    small = (F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) <= COVER * F.col("_step")) | (F.col("_level") == len(steps) - 1)
    held = levelled(box, every).where(small).withColumn("_cx", reach("xmin", "xmax")).withColumn("_cy", reach("ymin", "ymax"))
    keys = ["_level", "_cx", "_cy"]
    far = F.sqrt(F.pow(F.greatest(F.abs(x - F.col("xmin")), F.abs(x - F.col("xmax"))), 2) + F.pow(F.greatest(F.abs(y - F.col("ymin")), F.abs(y - F.col("ymax"))), 2))
    cell = lambda rows: rows.withColumns({"_cx": F.floor(x / F.col("_step")).cast("long"), "_cy": F.floor(y / F.col("_step")).cast("long")})
    some = held.select(*keys).distinct()
    first = cell(levelled(open_, every)).join(some, keys, "left_semi").groupBy(point_id, "x", "y").agg(F.min("_level").alias("_level"))
    bound = cell(levelled(first, F.col("_level"))).join(held.drop("_step"), keys).groupBy(point_id, "x", "y").agg(F.min(far).alias("_bound"))
    wide = F.greatest(F.lit(0), F.least(F.lit(len(steps) - 1), F.ceil(F.log2(F.greatest("_bound", F.lit(step)) / step)))).cast("int")
    # all boxes are needed here: those of many cells at a level are put into as many
    cover_all = levelled(box, every).withColumn("_cx", reach("xmin", "xmax")).withColumn("_cy", reach("ymin", "ymax"))
    near = cell(levelled(bound, wide)).join(cover_all.drop("_step"), keys)
    gap = F.pow(F.greatest(F.col("xmin") - x, x - F.col("xmax"), F.lit(0.0)), 2) + F.pow(F.greatest(F.col("ymin") - y, y - F.col("ymax"), F.lit(0.0)), 2)
    near = near.where(gap <= F.col("_bound") * F.col("_bound") * (1 + 1e-12)).select(point_id, "x", "y", polygon_id)
    measured = _distances(near, boxed.select(polygon_id, "polygon"), point_id, polygon_id)
    best = measured.groupBy(point_id).agg(F.min(F.struct("d", polygon_id)).alias("m"))
    return best.select(point_id, F.col(f"m.{polygon_id}").alias(polygon_id), F.col("m.d").alias("distance"))


def _distances(pairs: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str) -> DataFrame:
    """(point, polygon, ``d``) for pairs (point, x, y, polygon), each of which occurs once.

    A row for each edge, so that distances and crossings are generated code; edges of a pair meet in
    the aggregate's map side.  The ray from a point crosses an odd number of edges of the rings around
    it: hashes of ring numbers, combined by exclusive or, leave that of the outer ring if no hole is among them.
    """
    rings = polygons.select(polygon_id, F.posexplode("polygon").alias("_ring", "_points"))
    edges = rings.select(polygon_id, F.xxhash64("_ring").alias("_h"), F.explode(planar.edges(F.col("_points"))).alias("_e")).select(polygon_id, "_h", "_e.*")
    x, y, e = F.col("x"), F.col("y"), {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    square = dx * dx + dy * dy
    at = F.when(square < planar.TINY, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, square))))
    placed = pairs.join(edges, polygon_id).withColumn("_t", at)
    off = placed.withColumns({"_dx": x - (e["x1"] + F.col("_t") * dx), "_dy": y - (e["y1"] + F.col("_t") * dy)})
    crossed = F.when(planar.crosses_ray(x, y, e), F.col("_h")).otherwise(F.lit(0).cast("long"))
    met = off.groupBy(point_id, polygon_id).agg(F.min(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")).alias("_d"), F.bit_xor(crossed).alias("_x"))
    return met.select(point_id, polygon_id, F.when(F.col("_x") == F.xxhash64(F.lit(0)), 0.0).otherwise(F.sqrt("_d")).alias("d"))


def batched(matches: DataFrame, batch_size: int, point_id: str = "point_id", polygon_id: str = "zone_id") -> DataFrame:
    """Matches in the order of their ids with the number of their batch; 0 or less gives no rows."""
    if batch_size <= 0:
        return matches.withColumn("batch", F.lit(0).cast("long")).limit(0)
    # a running number without one task for all rows: rank in a range partition plus the rows of those before it
    dealt = matches.repartitionByRange(point_id, polygon_id).sortWithinPartitions(point_id, polygon_id).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    before = dealt.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = before.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    numbered = dealt.join(F.broadcast(before), "_p").withColumn("_k", F.col("_base") + F.col("_i") - F.col("_first"))
    return numbered.select(point_id, polygon_id, F.floor(F.col("_k") / batch_size).cast("long").alias("batch"))


def spatial_join_batched(points: DataFrame, polygons: DataFrame, batch_size: int, size: float | None = None, point_id: str = "point_id", polygon_id: str = "zone_id") -> DataFrame:
    """The matches of :func:`spatial_join` with the number of their batch, as :func:`batched` gives them; ids of points must differ.

    The polygons of each position are listed and sorted once.  Only points with the number of their matches are put in
    order: the matches, which may be far more, take their numbers from their point's first and their place in the list.
    """
    if batch_size <= 0:
        return batched(points.select(point_id, F.lit(0).alias(polygon_id)), batch_size, point_id, polygon_id)
    places = points.select("x", "y").distinct()
    lists = _inside(places, polygons, size, polygon_id).groupBy("x", "y").agg(F.sort_array(F.collect_list(polygon_id)).alias("_all"))
    counts = points.select(point_id, "x", "y").join(lists.select("x", "y", F.size("_all").cast("long").alias("_n")), ["x", "y"])
    dealt = counts.repartitionByRange(point_id).withColumn("_p", F.spark_partition_id())
    before = dealt.groupBy("_p").agg(F.sum("_n").alias("_m"))
    before = before.withColumn("_base", F.coalesce(F.sum("_m").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy(point_id).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = dealt.withColumn("_i", earlier).join(F.broadcast(before.select("_p", "_base")), "_p").select(point_id, "x", "y", (F.col("_base") + F.col("_i")).alias("_k"))
    placed = first.join(lists, ["x", "y"]).select(point_id, "_k", F.posexplode("_all").alias("_at", polygon_id))
    return placed.select(point_id, polygon_id, F.floor((F.col("_k") + F.col("_at")) / batch_size).cast("long").alias("batch"))
