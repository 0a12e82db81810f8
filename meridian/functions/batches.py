"""Columns of shapes as flat numpy arrays and back, for Arrow functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrangement import AREA, LINE, POINT, Segments

POINT_TYPE = pa.struct([("x", pa.float64()), ("y", pa.float64())])
LINE_TYPE = pa.list_(POINT_TYPE)
POLYGON_TYPE = pa.list_(LINE_TYPE)
MULTI_TYPE = pa.list_(POLYGON_TYPE)


def whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def elements(lists: pa.Array, owner: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Elements of lists, and the owner of each; a null list has none."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(owner, n)


def coordinates(points: pa.Array) -> np.ndarray:
    return np.column_stack([np.asarray(pc.struct_field(points, [k]).to_numpy(zero_copy_only=False), float) for k in (0, 1)]) if len(points) else np.empty((0, 2))


def numbers(column: pa.Array) -> np.ndarray:
    """A column of numbers as doubles, NaN for null."""
    return np.array(column.to_numpy(zero_copy_only=False), float)


def _chains(parts: pa.Array, owner: np.ndarray, side: int, kind: int) -> Segments:
    """Segments of rings (closed) or lines; those of no length and with coordinates that aren't finite are left out, but for lines that are one point."""
    points, part = elements(parts, np.arange(len(parts)))
    xy = coordinates(points)
    n = np.bincount(part, minlength=len(parts))
    first = np.cumsum(n) - n
    following = np.arange(len(part)) + 1
    ends = first + n - 1
    if kind == AREA:
        following[ends[n > 0]] = first[n > 0]
        keep = np.ones(len(part), bool)
    else:
        keep = np.ones(len(part), bool)
        keep[ends[n > 0]] = False
        following[ends[n > 0]] = first[n > 0]
    seg = np.column_stack([xy, xy[following]]) if len(xy) else np.empty((0, 4))
    keep &= np.isfinite(seg).all(axis=1)
    long = keep & ((seg[:, 0] != seg[:, 2]) | (seg[:, 1] != seg[:, 3]))
    if kind == LINE:  # a line without length is its first point, kept once
        some = np.bincount(part[long], minlength=len(parts)) > 0
        at = np.zeros(len(part), bool)
        at[first[n > 1]] = True
        long |= keep & at & ~some[part]
    part = part[long]
    return Segments(owner[part], np.full(len(part), side), np.full(len(part), kind), seg[long], part)


def rings(polygons: pa.Array, side: int) -> Segments:
    """Segments of a column of polygons (lists of rings)."""
    parts, owner = elements(polygons, np.arange(len(polygons)))
    return _chains(parts, owner, side, AREA)


def multi(column: pa.Array, side: int) -> Segments:
    """Segments of a column of multipolygons (lists of polygons)."""
    polygons, owner = elements(column, np.arange(len(column)))
    parts, owner = elements(polygons, owner)
    return _chains(parts, owner, side, AREA)


def lines(column: pa.Array, side: int) -> Segments:
    """Segments of a column of lists of lines."""
    parts, owner = elements(column, np.arange(len(column)))
    return _chains(parts, owner, side, LINE)


def points(column: pa.Array, side: int) -> Segments:
    """A column of lists of points, as segments of no length."""
    inner, owner = elements(column, np.arange(len(column)))
    xy = coordinates(inner)
    good = np.isfinite(xy).all(axis=1)
    xy, owner = xy[good], owner[good]
    return Segments(owner, np.full(len(owner), side), np.full(len(owner), POINT), np.column_stack([xy, xy]), np.arange(len(owner)))


def _lists(sizes: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32()), values)


def multipolygons(found: list[list[list[np.ndarray]]], null: np.ndarray | None = None) -> pa.Array:
    """A column of multipolygons from the rings of each; null where ``null`` says so."""
    polygons = [p for row in found for p in row]
    parts = [r for p in polygons for r in p]
    xy = np.concatenate(parts) if parts else np.empty((0, 2))
    flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in (0, 1)], ["x", "y"])
    out = _lists([len(row) for row in found], _lists([len(p) for p in polygons], _lists([len(r) for r in parts], flat)))
    return out if null is None or not null.any() else pc.if_else(pa.array(null), pa.scalar(None, out.type), out)
