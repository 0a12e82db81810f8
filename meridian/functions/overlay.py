"""Overlay of polygons and multipolygons of any shape, with holes: shapes, areas and the relations that follow from areas.

Both shapes are cut where they meet and put together again from the pieces that bound the result
(:mod:`.arrangement`), a batch of pairs at a time.  Results are multipolygons (arrays of polygons): outer rings run
counter-clockwise, holes clockwise, rings are open and don't touch themselves.  Rings of the input may run either way; a
point is inside if an odd number of rings is around it.  A null shape gives null, an empty one is the empty set.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import batches, planar
from .arrangement import KEEP, Arrangement, Segments
from .binding import named

MULTIPOLYGON = f"array<{planar.POLYGON}>"
#: Bytes of coordinates that are overlaid together.
AT_ONCE = 8 << 20


def sliced(run: Callable[..., pa.Array], *columns: pa.Array, growth: int = 1) -> pa.Array:
    """``run`` on slices of the columns of at most about AT_ONCE bytes; ``growth``: to how many times its size a shape grows on the way."""
    columns = tuple(batches.whole(c) for c in columns)
    n = len(columns[0])
    step = max(1, int(n * AT_ONCE / growth / max(1, sum(c.nbytes for c in columns))))
    done = [run(*(c.slice(at, step) for c in columns)) for at in range(0, n, step)] or [run(*columns)]
    return pa.concat_arrays(done)


def _null(*columns: pa.Array) -> np.ndarray:
    return np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in columns])


def _clip(operation: str) -> Callable[[Column, Column], Column]:
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        made = Arrangement(Segments.of([batches.multi(a, 0), batches.multi(b, 1)]), len(a))
        return batches.multipolygons(made.polygons(KEEP[operation]), _null(a, b))

    def call(a: pa.Array, b: pa.Array) -> pa.Array:
        return sliced(run, a, b)

    return F.arrow_udf(call, MULTIPOLYGON)


def clip_multi(a: Column, b: Column, operation: str) -> Column:
    """The overlay of two multipolygons: ``union``, ``intersection``, ``difference`` or ``symmetric_difference``."""
    if operation not in KEEP:
        raise ValueError(f"operation must be one of {', '.join(KEEP)}")
    return _clip(operation)(a, b)


def clip(a: Column, b: Column, operation: str) -> Column:
    """The overlay of two polygons."""
    one = lambda p: F.when(p.isNotNull(), F.array(p))
    return clip_multi(one(a), one(b), operation)


def clip_area(a: Column, b: Column, operation: str) -> Column:
    """The area of :func:`clip`, read off the pieces that bound it."""
    if operation not in KEEP:
        raise ValueError(f"operation must be one of {', '.join(KEEP)}")

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        made = Arrangement(Segments.of([batches.rings(a, 0), batches.rings(b, 1)]), len(a))
        return pa.array(made.areas(KEEP[operation]), mask=_null(a, b))

    def call(a: pa.Array, b: pa.Array) -> pa.Array:
        return sliced(run, a, b)

    return F.arrow_udf(call, "double")(a, b)


def union(a: Column, b: Column) -> Column:
    return clip(a, b, "union")


def intersection(a: Column, b: Column) -> Column:
    return clip(a, b, "intersection")


def difference(a: Column, b: Column) -> Column:
    return clip(a, b, "difference")


def symmetric_difference(a: Column, b: Column) -> Column:
    return clip(a, b, "symmetric_difference")


def _turned(column: pa.Array, side: int) -> Segments:
    """Segments of multipolygons with outer rings to the left and holes to the right."""
    polygons, owner = batches.elements(column, np.arange(len(column)))
    parts, of = batches.elements(polygons, np.arange(len(polygons)))
    s = batches.rings(pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1), pa.int32()), parts), side)
    hole = np.ones(len(parts), bool)
    hole[np.searchsorted(of, np.unique(of))] = False
    x1, y1, x2, y2 = s.xy.T
    twice = np.bincount(s.group, x1 * y2 - x2 * y1, len(parts))
    swap = ((twice > 0) == hole)[s.group]
    xy = np.where(swap[:, None], s.xy[:, [2, 3, 0, 1]], s.xy)
    return Segments(owner[of][s.group], s.side, s.kind, xy, s.group)


def union_all(shapes: Column) -> Column:
    """The union of any number of polygons (an array of polygons, which may overlap) as one multipolygon."""
    keep = np.array([[False, False], [True, True]])

    def run(column: pa.Array) -> pa.Array:
        made = Arrangement(_turned(column, 0), len(column), (True, False))
        return batches.multipolygons(made.polygons(keep), _null(column))

    def call(column: pa.Array) -> pa.Array:
        return sliced(run, column)

    return F.arrow_udf(call, MULTIPOLYGON)(shapes)


def intersection_area(a: Column, b: Column) -> Column:
    """0 for null and empty polygons."""
    return F.coalesce(clip_area(a, b, "intersection"), F.lit(0.0))


def areas(a: Column, b: Column) -> Column:
    """Struct of the areas of ``a``, of ``b`` and of their common part."""
    return named(a=planar.polygon_area(a), b=planar.polygon_area(b), both=intersection_area(a, b))


def box_areas(a: Column, b: Column) -> Column:
    """:func:`areas` of two boxes (xmin, ymin, xmax, ymax)."""
    area = lambda c: (c["xmax"] - c["xmin"]) * (c["ymax"] - c["ymin"])
    side = lambda v: F.greatest(F.least(a[f"{v}max"], b[f"{v}max"]) - F.greatest(a[f"{v}min"], b[f"{v}min"]), F.lit(0.0))
    return named(a=area(a), b=area(b), both=side("x") * side("y"))


def union_area(s: Column) -> Column:
    return s["a"] + s["b"] - s["both"]


def difference_area(s: Column) -> Column:
    return s["a"] - s["both"]


def symmetric_difference_area(s: Column) -> Column:
    return s["a"] + s["b"] - 2 * s["both"]


def overlaps(s: Column, relative: float = 1e-9) -> Column:
    """Whether two polygons share some area, but neither holds the other."""
    tol = relative * (s["a"] + s["b"])
    return (s["both"] > tol) & (s["both"] < s["a"] - tol) & (s["both"] < s["b"] - tol)


def contains(s: Column, relative: float = 1e-9) -> Column:
    """Whether the first polygon holds all of the second."""
    return (s["b"] > 0) & (s["both"] >= s["b"] - relative * (s["a"] + s["b"]))


def touches(a: Column, b: Column, s: Column, relative: float = 1e-9) -> Column:
    """Whether boundaries meet and no area is shared."""
    return planar.polygons_intersect(a, b) & (s["both"] <= relative * (s["a"] + s["b"]))
