"""Buffers of points, lines and polygons with round joins and caps: disks and rectangles, dissolved.

A disk is a regular polygon of ``segments`` sides (four at least) with a corner due east, so that results lie
within the true buffer.  Polygons grow or, with a negative distance, shrink; their holes do the opposite.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import batches
from .arrangement import AREA, Arrangement, Segments
from .overlay import MULTIPOLYGON, _null, sliced


def _chain(xy: np.ndarray, group: np.ndarray, ring_size: int) -> Segments:
    """Segments of rings of ``ring_size`` points each, one after another."""
    n = len(xy)
    following = np.arange(n) + 1
    following[ring_size - 1 :: ring_size] -= ring_size
    return Segments(group, np.full(n, 1), np.full(n, AREA), np.column_stack([xy, xy[following]]), np.arange(n) // ring_size)


def _band(s: Segments, alone: np.ndarray, alone_group: np.ndarray, distance: np.ndarray, sides: int) -> list[Segments]:
    """Side 1: rectangles along segments and disks at their ends and at lone points, all to the left."""
    n = max(sides, 4)
    x1, y1, x2, y2 = s.xy.T
    length = np.hypot(x2 - x1, y2 - y1)
    some = length > 0
    r = distance[s.group]
    nx, ny = (-(y2 - y1)[some] / length[some] * r[some], (x2 - x1)[some] / length[some] * r[some])
    a, b = s.xy[some, :2], s.xy[some, 2:]
    off = np.column_stack([nx, ny])
    corners = np.stack([a - off, b - off, b + off, a + off], axis=1).reshape(-1, 2)
    centres, owner = np.concatenate([s.xy[:, :2], s.xy[:, 2:], alone]), np.concatenate([s.group, s.group, alone_group])
    if len(centres):
        both = np.unique(np.column_stack([owner, centres]), axis=0)
        owner, centres = both[:, 0].astype(np.int64), both[:, 1:]
    turn = 2 * np.pi * np.arange(n) / n
    circle = np.column_stack([np.cos(turn), np.sin(turn)])
    disks = (centres[:, None, :] + distance[owner][:, None, None] * circle[None]).reshape(-1, 2)
    return [_chain(corners, np.repeat(s.group[some], 4), 4), _chain(disks, np.repeat(owner, n), n)]


def _growth(sides: int) -> int:
    """How many times the bytes of a shape its bands have: a vertex becomes a disk and a rectangle, and a segment has two ends."""
    return 2 * (max(sides, 4) + 4)


def _capsules(ends: np.ndarray, r: np.ndarray, sides: int) -> pa.Array:
    """The multipolygon within ``r`` of each segment (x1, y1, x2, y2), which is no shorter than that; ``sides`` is even.

    Beyond an end lies half of its disk, so a ring is known without cutting: the sides along the segment, in to where the line across
    the end meets the disk, and the disk's corners beyond.
    """
    half, turn = sides // 2, 2 * np.pi / sides
    a, b = ends[:, :2], ends[:, 2:]
    u = (b - a) / np.hypot(*(b - a).T)[:, None]
    rim = []
    for out in (u, -u):
        k = np.floor(np.arctan2(-out[:, 0], out[:, 1]) / turn)[:, None] + np.arange(half + 2)  # from the last corner not beyond to the next one
        corners = np.stack([np.cos(k * turn), np.sin(k * turn)], axis=2)
        off = (corners * out[:, None, :]).sum(axis=2)
        meets = [corners[:, i] + (off[:, i] / (off[:, i] - off[:, j]))[:, None] * (corners[:, j] - corners[:, i]) for i, j in ((0, 1), (half, half + 1))]
        right = np.column_stack([out[:, 1], -out[:, 0]])
        rim.append(np.concatenate([right[:, None], meets[0][:, None], corners[:, 1:-1], meets[1][:, None], -right[:, None]], axis=1))
    ring = np.concatenate(rim, axis=1)
    apart = np.abs(ring - np.roll(ring, 1, axis=1)).max(axis=2) > 1e-9  # a corner on the line across the end is there three times
    apart[:, [0, half + 4]] = True
    xy = (np.repeat(np.stack([b, a], axis=1), half + 4, axis=1) + r[:, None, None] * ring)[apart]
    flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in (0, 1)], ["x", "y"])
    lists = lambda n, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values)
    one = np.ones(len(ring), np.int64)
    return lists(one, lists(one, lists(apart.sum(axis=1), flat)))


def _plain(lines: pa.Array, r: np.ndarray, sides: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are one segment no shorter than their distance, and those segments."""
    size = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero((size == 2) & (r > 0) & (r < np.inf))
    if sides % 2 or not len(rows):
        return rows[:0], np.empty((0, 4))
    points, _ = batches.elements(lines.take(pa.array(rows)), rows)
    ends = batches.coordinates(points).reshape(-1, 4)
    with np.errstate(invalid="ignore", over="ignore"):
        length = np.hypot(ends[:, 2] - ends[:, 0], ends[:, 3] - ends[:, 1])
    good = np.isfinite(length) & (length >= r[rows])
    return rows[good], ends[good]


def _distance(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = column.to_numpy(zero_copy_only=False).astype(float)
    return values, np.isnan(values)


def buffer_line(line: Column, distance: Column | float, segments: int = 32) -> Column:
    """The multipolygon within ``distance`` of a line (a disk for a line that is one point); empty unless the distance is positive, null for NaN or null."""

    def cut(lines: pa.Array, r: np.ndarray, null: np.ndarray) -> pa.Array:
        parts = batches.lines(pa.ListArray.from_arrays(pa.array(np.arange(len(lines) + 1), pa.int32()), lines), 0)
        points, owner = batches.elements(lines, np.arange(len(lines)))
        xy = batches.coordinates(points)
        good = np.isfinite(xy).all(axis=1) & (r[owner] > 0) if len(owner) else np.empty(0, bool)
        keep = r[parts.group] > 0
        parts = Segments(*(getattr(parts, f)[keep] for f in ("group", "side", "kind", "xy", "part")))
        made = Arrangement(Segments.of(_band(parts, xy[good], owner[good], r, segments)), len(lines), (False, True))
        return batches.multipolygons(made.polygons(np.array([[False, True], [False, True]])), null)

    def run(lines: pa.Array, by: pa.Array) -> pa.Array:
        r, unknown = _distance(by)
        r = np.where(r > 0, r, 0.0)
        rows, ends = _plain(lines, r, max(segments, 4))
        rest = np.setdiff1d(np.arange(len(lines)), rows)
        others = [cut(lines.take(pa.array(rest)), r[rest], (_null(lines) | unknown)[rest])] if len(rest) or not len(rows) else []
        order = np.argsort(np.concatenate([rows, rest]))
        return pa.concat_arrays([*([_capsules(ends, r[rows], max(segments, 4))] if len(rows) else []), *others]).take(pa.array(order))

    def call(lines: pa.Array, by: pa.Array) -> pa.Array:
        return sliced(run, lines, by, growth=_growth(segments))

    return F.arrow_udf(call, MULTIPOLYGON)(line, _column(distance))


def buffer_point(point: Column, distance: Column | float, segments: int = 32) -> Column:
    """A regular polygon around a point, as a multipolygon."""
    return buffer_line(F.when(point.isNotNull(), F.array(point)), distance, segments)


def polygon_buffers(polygons: pa.Array, by: pa.Array, segments: int) -> pa.Array:
    """:func:`buffer_polygon` of a batch, some polygons at a time: what they grow to on the way is bounded, however many come."""

    def run(polygons: pa.Array, by: pa.Array) -> pa.Array:
        r, unknown = _distance(by)
        own = batches.rings(polygons, 0)
        edge = np.where(unknown, 0.0, np.abs(r))
        some = edge[own.group] > 0
        rims = Segments(*(getattr(own, f)[some] for f in ("group", "side", "kind", "xy", "part")))
        made = Arrangement(Segments.of([own, *_band(rims, np.empty((0, 2)), np.empty(0, np.int64), edge, segments)]), len(polygons), (False, True))
        # what is kept depends on the row: one pass for those that grow, one for those that shrink
        nothing: list = [[]] * len(r)
        grown = made.polygons(np.array([[False, True], [True, True]])) if not (r < 0).all() else nothing
        shrunk = made.polygons(np.array([[False, False], [True, False]])) if (r < 0).any() else nothing
        return batches.multipolygons([g if d >= 0 or d != d else s for g, s, d in zip(grown, shrunk, r.tolist(), strict=True)], _null(polygons) | unknown)

    return sliced(run, polygons, by, growth=_growth(segments))


def buffer_polygon(polygon: Column, distance: Column | float, segments: int = 32) -> Column:
    """The multipolygon of all within ``distance`` of a polygon or, if it is negative, of what lies within and no nearer to a ring; null for NaN or null."""

    def call(polygons: pa.Array, by: pa.Array) -> pa.Array:
        return polygon_buffers(polygons, by, segments)

    return F.arrow_udf(call, MULTIPOLYGON)(polygon, _column(distance))


def _column(distance: Column | float) -> Column:
    return (distance if isinstance(distance, Column) else F.lit(float(distance))).cast("double")
