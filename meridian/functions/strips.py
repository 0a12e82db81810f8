"""What polygons of few corners have in common, by strips, for Arrow functions.

Between its lowest and its highest corner a convex ring lies between its left and its right sides.  The width that two such rings
share is linear between the ordinates of corners and of crossings of sides, so areas are sums over strips: some forty operations on
whole columns for a batch of pairs, where :mod:`.arrangement` cuts, sorts and labels.  A polygon fits if it is one convex ring, or
one with a convex hole in it, none of which has more than MOST corners; all others are left to the arrangement.

All is computed in doubles, side by side as x = c + m y, and compared as it comes out, without tolerances.  Numbers that follow
from differences of coordinates (slopes, areas of rings) keep no digits that the last digits of the coordinates don't carry.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import coordinates, elements, whole

#: Corners of a ring.
MOST = 8
#: Run over rise of a side that isn't level.
FLAT = 64.0
#: Sine of the least turn at a corner.
TURN = 1e-9
#: Numbers before the rings of a column of :func:`strips`: area, how many rings, and as one number how many left sides, right sides, corners between and corners of each.
HEAD = 3
#: Base of that number's digits.
BASE = 16


@dataclass
class Rings:
    """Rings of a column of polygons.  ``left``, ``right``: for each side's line c and m, padded; ``between``: ordinates of corners that are neither lowest nor highest."""

    fits: np.ndarray  # by polygon
    outer: np.ndarray  # by polygon: its ring
    hole: np.ndarray  # by polygon: its ring, or -1
    area: np.ndarray  # by polygon
    low: np.ndarray
    high: np.ndarray
    left: list[tuple[np.ndarray, np.ndarray]]
    right: list[tuple[np.ndarray, np.ndarray]]
    between: list[np.ndarray]
    corners: list[tuple[np.ndarray, np.ndarray]]


def _known(value: np.ndarray, doubt: np.ndarray) -> np.ndarray:
    """``value`` without the binary digits below ``doubt``."""
    unit = np.exp2(np.ceil(np.log2(doubt)))
    return np.rint(value / unit) * unit


def _padded(rows: int, ring: np.ndarray, values: tuple[np.ndarray, ...], empty: tuple[float, ...]) -> list[tuple[np.ndarray, ...]]:
    """Values by ring (ascending) as columns: the first of each ring, the second, and so on."""
    first = np.searchsorted(ring, ring)
    at = np.arange(len(ring)) - first
    columns = []
    for k in range(int(at.max()) + 1 if len(at) else 0):
        made = []
        for v, fill in zip(values, empty, strict=True):
            column = np.full(rows, fill)
            column[ring[at == k]] = v[at == k]
            made.append(column)
        columns.append(tuple(made))
    return columns


def rings(polygons: pa.Array) -> Rings:
    n = len(polygons)
    parts, owner = elements(polygons, np.arange(n))
    points, ring = elements(parts, np.arange(len(parts)))
    xy = coordinates(points)
    m = len(parts)
    # a last corner that repeats the first one is no corner
    size = np.bincount(ring, minlength=m)
    end = np.cumsum(size)
    some = size > 1
    closing = np.zeros(len(ring), bool)
    closing[end[some] - 1] = (xy[end[some] - 1] == xy[(end - size)[some]]).all(axis=1)
    xy, ring = xy[~closing], ring[~closing]
    size = np.bincount(ring, minlength=m)
    first = np.cumsum(size) - size
    following = np.arange(len(ring)) + 1
    following[(first + size - 1)[size > 0]] = first[size > 0]
    x, y = xy.T
    with np.errstate(all="ignore"):
        dx, dy = x[following] - x, y[following] - y
        ex, ey = dx[following], dy[following]
        cross, along = dx * ey - dy * ex, dx * ex + dy * ey
        turned = np.abs(cross) > TURN * (np.abs(dx) + np.abs(dy)) * (np.abs(ex) + np.abs(ey))
        good = turned & ((dy == 0) | (np.abs(dx) <= FLAT * np.abs(dy))) & np.isfinite(along)
        angle = np.bincount(ring, np.arctan2(cross, along), m)
        count = lambda which: np.bincount(ring[which], minlength=m)
        around = np.where(count(cross > 0) == size, 1, np.where(count(cross < 0) == size, -1, 0))
        fine = (size >= 3) & (size <= MOST) & (count(good) == size) & (around != 0) & (np.abs(angle) < 7)
    use = fine[ring]
    at, a, b = ring[use], np.flatnonzero(use), following[use]
    low, high = np.full(m, np.inf), np.full(m, -np.inf)
    np.minimum.at(low, at, y[a])
    np.maximum.at(high, at, y[a])
    up = dy[a] > 0
    lower, upper = np.where(up, a, b), np.where(up, b, a)
    rise = y[upper] - y[lower]
    side = rise > 0
    lower, upper, rise, of, right = lower[side], upper[side], rise[side], at[side], (up == (around[at] > 0))[side]
    digit = np.spacing(np.maximum(np.abs(x[lower]), np.abs(x[upper]))) + np.spacing(np.maximum(np.abs(y[lower]), np.abs(y[upper])))
    with np.errstate(all="ignore"):
        run = x[upper] - x[lower]
        slope = np.where(run == 0, 0.0, _known(run / rise, 2 * digit * (1 + np.abs(run / rise)) / rise))
    start = x[lower] - slope * y[lower]
    sides = [_padded(m, of[which], (start[which], slope[which]), (inf, 0.0)) for which, inf in ((~right, -np.inf), (right, np.inf))]
    mid = (y[a] > low[at]) & (y[a] < high[at])
    between = [c[0] for c in _padded(m, at[mid], (y[a][mid],), (np.nan,))]
    corners = _padded(m, at, (x[a], y[a]), (np.nan, np.nan))
    # areas around the first corner
    ox, oy = x[a] - x[first[at]], y[a] - y[first[at]]
    px, py = x[b] - x[first[at]], y[b] - y[first[at]]
    twice = np.bincount(at, ox * py - px * oy, m)
    extent = np.bincount(at, np.abs(dx[a]) + np.abs(dy[a]), m)
    digit = np.zeros(m)
    np.maximum.at(digit, at, np.spacing(np.maximum(np.abs(x[a]), np.abs(y[a]))))
    with np.errstate(all="ignore"):
        area = np.where(fine, _known(np.abs(twice) / 2, 2 * extent * digit), 0.0)
    # one ring, or two of which the second lies in the first
    many = np.bincount(owner, minlength=n)
    start = np.cumsum(many) - many
    outer = np.where(many > 0, start, 0)
    hole = np.where(many == 2, start + 1, -1)
    told = Rings(np.zeros(n, bool), outer, hole, np.zeros(n), low, high, *sides, between, corners)
    if m:
        two = hole >= 0
        told.fits = np.isin(many, (1, 2)) & fine[outer] & np.where(two, fine[hole], True)
        told.fits[two] &= _within(told, hole[two], told, outer[two], strict=False)
        told.area = area[outer] - np.where(two, area[hole], 0.0)
    return told


def _bounds(r: Rings, i: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where rings ``i`` begin and end at ordinates ``y``."""
    left = np.full(y.shape, -np.inf)
    right = np.full(y.shape, np.inf)
    for c, m in r.left:
        np.maximum(left, c[i] + m[i] * y, out=left)
    for c, m in r.right:
        np.minimum(right, c[i] + m[i] * y, out=right)
    return left, right


def _within(a: Rings, i: np.ndarray, b: Rings, j: np.ndarray, strict: bool) -> np.ndarray:
    """Whether rings ``i`` of ``a`` lie in rings ``j`` of ``b``; ``strict``: without touching them."""
    inside = np.ones(len(i), bool)
    for x, y in a.corners:
        left, right = _bounds(b, j, y[i])
        if strict:
            held = (x[i] > left) & (x[i] < right) & (y[i] > b.low[j]) & (y[i] < b.high[j])
        else:
            held = (x[i] >= left) & (x[i] <= right) & (y[i] >= b.low[j]) & (y[i] <= b.high[j])
        inside &= held | np.isnan(y[i])
    return inside


def _ordered(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Columns sorted row by row: exchanges of neighbours, as there are few."""
    columns = list(columns)
    for end in range(len(columns) - 1, 0, -1):
        for k in range(end):
            columns[k], columns[k + 1] = np.minimum(columns[k], columns[k + 1]), np.maximum(columns[k], columns[k + 1])
    return columns


def _shared(a: Rings, i: np.ndarray, b: Rings, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common area of rings ``i`` of ``a`` and ``j`` of ``b``, and the largest common width (negative: apart)."""
    low, high = np.maximum(a.low[i], b.low[j]), np.minimum(a.high[i], b.high[j])
    meet = low <= high
    cuts = []
    with np.errstate(all="ignore"):
        lines = [[(c[k], m[k]) for c, m in [*r.left, *r.right]] for r, k in ((a, i), (b, j))]
        for c, m in lines[0]:
            for d, n in lines[1]:
                if m.any() or n.any():
                    cuts.append((d - c) / (m - n))
        cuts += [v[i] for v in a.between] + [v[j] for v in b.between]
        cuts = _ordered([np.where((v >= low) & (v <= high), v, low) for v in cuts])
        area, widest, before = np.zeros(len(i)), np.full(len(i), -np.inf), None
        for y in [low, *cuts, high]:
            (left, right), (other_left, other_right) = _bounds(a, i, y), _bounds(b, j, y)
            width = np.minimum(right, other_right) - np.maximum(left, other_left)
            widest = np.maximum(widest, width)
            wide = np.maximum(width, 0)
            if before is not None:
                area += (before[1] + wide) / 2 * (y - before[0])
            before = (y, wide)
    return np.where(meet, area, 0.0), np.where(meet, widest, -np.inf)


def _pairs(a: Rings, b: Rings) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Sign, rows and rings of ``a`` and of ``b`` that make up common areas."""
    both = a.fits & b.fits
    found = []
    for sign, i, j in ((1, a.outer, b.outer), (-1, a.outer, b.hole), (-1, a.hole, b.outer), (1, a.hole, b.hole)):
        rows = np.flatnonzero(both & (i >= 0) & (j >= 0))
        found.append((sign, rows, i[rows], j[rows]))
    return found


def common_areas(a: Rings, b: Rings) -> np.ndarray:
    """For each row with polygons that fit the area of their common part; 0 for others."""
    out = np.zeros(len(a.fits))
    for sign, rows, i, j in _pairs(a, b):
        if len(rows):
            out[rows] += sign * _shared(a, i, b, j)[0]
    return out


def meet(a: Rings, b: Rings) -> np.ndarray:
    """For each row with polygons that fit whether they have a point in common: outer rings do, and neither lies in the other's hole without touching it."""
    out = np.zeros(len(a.fits), bool)
    _, rows, i, j = _pairs(a, b)[0]
    if len(rows):
        out[rows] = _shared(a, i, b, j)[1] >= 0
    for inner, outer in ((a, b), (b, a)):
        rows = np.flatnonzero(out & (outer.hole >= 0))
        out[rows[_within(inner, inner.outer[rows], outer, outer.hole[rows], strict=True)]] = False
    return out


def _flat(r: Rings) -> pa.Array:
    """Polygons that fit as lists of numbers, null for others: all that :class:`Rings` says, with columns that no ring of the batch needs left out."""
    make = 0
    for columns in (r.left, r.right, r.between, r.corners):
        make = make * BASE + len(columns)
    of_ring = [r.low, r.high, *(v for side in (r.left, r.right) for line in side for v in line), *r.between, *(v for corner in r.corners for v in corner)]
    block = np.column_stack(of_ring) if len(r.low) else np.empty((0, len(of_ring)))
    width, n = block.shape[1], len(r.fits)
    rings_of = np.where(r.fits, np.where(r.hole >= 0, 2, 1), 0)
    length = np.where(r.fits, HEAD + rings_of * width, 0)
    start = np.cumsum(length) - length
    values = np.empty(int(length.sum()))
    rows = np.flatnonzero(r.fits)
    for k, v in enumerate((r.area[rows], rings_of[rows], make)):
        values[start[rows] + k] = v
    for at, ring in ((HEAD, r.outer), (HEAD + width, r.hole)):
        some = rows if ring is r.outer else rows[r.hole[rows] >= 0]
        values[(start[some] + at)[:, None] + np.arange(width)] = block[ring[some]]
    offsets = np.concatenate([start, [len(values)]])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=pa.array(~r.fits)) if n else pa.array([], pa.list_(pa.float64()))


def _read(column: pa.Array) -> Rings:
    """:func:`_flat` read back; nulls don't fit."""
    n = len(column)
    fits = column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(fits)
    values = column.values.to_numpy(zero_copy_only=False)
    start = column.offsets.to_numpy()[:-1].astype(np.int64)[rows]
    head = values[start[:, None] + np.arange(HEAD)] if len(rows) else np.empty((0, HEAD))
    count = head[:, 1].astype(np.int64)
    outer, hole = np.zeros(n, np.int64), np.full(n, -1)
    outer[rows] = np.cumsum(count) - count
    hole[rows[count == 2]] = outer[rows[count == 2]] + 1
    area = np.zeros(n)
    area[rows] = head[:, 0]
    total = int(count.sum())
    make = head[:, 2].astype(np.int64)
    makes = {int(k): [int(k) // BASE**e % BASE for e in (3, 2, 1, 0)] for k in np.flatnonzero(np.bincount(make))}
    most = [max(sizes[kind] for sizes in makes.values()) if makes else 0 for kind in range(4)]
    fill = [(-np.inf, 0.0), (np.inf, 0.0), (np.nan,), (np.nan, np.nan)]
    low, high = np.empty(total), np.empty(total)
    columns = [[tuple(np.full(total, v) for v in fill[kind]) for _ in range(most[kind])] for kind in range(4)]
    # batches differ in how many columns they need: lists of one make are read together
    for code, sizes in makes.items():
        width = 2 + sum(len(fill[kind]) * sizes[kind] for kind in range(4))
        alike = np.flatnonzero(make == code)
        for ring, which in ((0, alike), (1, alike[count[alike] == 2])):
            to, at = outer[rows[which]] + ring, start[which] + HEAD + ring * width
            low[to], high[to] = values[at], values[at + 1]
            at = at + 2
            for kind in range(4):
                for column_ in columns[kind][: sizes[kind]]:
                    for v in column_:
                        v[to] = values[at]
                        at = at + 1
    left, right, between, corners = columns
    return Rings(fits, outer, hole, area, low, high, left, right, [c[0] for c in between], corners)


def strips(polygon: Column, corners: bool = True) -> Column:
    """What the other functions take: all that they need of a polygon that fits, null for others.  Worth computing before polygons are paired.

    ``corners``: with corners, which are more than half of the numbers and which only :func:`intersect` needs.
    """

    def run(column: pa.Array) -> pa.Array:
        told = rings(whole(column))
        return _flat(told if corners else replace(told, corners=[]))

    return F.arrow_udf(run, "array<double>")(polygon)


#: Areas of overlays from the areas of both polygons and of their common part.
OVERLAYS = {
    "intersection": lambda a, b, both: both,
    "union": lambda a, b, both: a + b - both,
    "difference": lambda a, b, both: a - both,
    "symmetric_difference": lambda a, b, both: a + b - 2 * both,
}


def clip_area(a: Column, b: Column, operation: str) -> Column:
    """The area of an overlay of two polygons from their :func:`strips`; null if either has none."""
    if operation not in OVERLAYS:
        raise ValueError(f"operation must be one of {', '.join(OVERLAYS)}")

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        p, q = _read(whole(a)), _read(whole(b))
        return pa.array(OVERLAYS[operation](p.area, q.area, common_areas(p, q)), mask=~(p.fits & q.fits))

    return F.arrow_udf(run, "double")(a, b)


def areas(a: Column, b: Column) -> Column:
    """Struct of the areas of ``a``, of ``b`` and of their common part, from their :func:`strips`."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        p, q = _read(whole(a)), _read(whole(b))
        return pa.StructArray.from_arrays([pa.array(v) for v in (p.area, q.area, common_areas(p, q))], ["a", "b", "both"], mask=pa.array(~(p.fits & q.fits)))

    return F.arrow_udf(run, "a double, b double, both double")(a, b)


def intersect(a: Column, b: Column) -> Column:
    """Whether two polygons have a point in common, from their :func:`strips`; null if either has none."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        p, q = _read(whole(a)), _read(whole(b))
        return pa.array(meet(p, q), mask=~(p.fits & q.fits))

    return F.arrow_udf(run, "boolean")(a, b)
