"""Planar arrangements of many small groups of shapes at once, in numpy, for Arrow functions.

A group (one row of a batch) has two sides, each with areas, lines and points.  All segments are cut where they
meet, ends that lie within a tolerance become one node, and each *piece* between two nodes is kept once
with what it is to either side.  A ray from its middle says what lies left and right of it.  Overlays, relations,
validity and buffers are read off these labels.  Rows never meet: Spark deals out the pairs, a batch is one call.

Candidates come from ranges of ordinates: sorted once, each segment looks only at those that start within its
own range, so that long boundaries don't compare all edges with all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Distance up to which points are one, relative to the largest coordinate of a group.
RELATIVE = 1e-11
#: Candidates looked at together.
AT_ONCE = 2_000_000

AREA, LINE, POINT = 0, 1, 2
INTERIOR, BOUNDARY, EXTERIOR = 0, 1, 2


@dataclass
class Segments:
    """Segments by group, side and kind; points have no length.  ``part`` numbers rings and lines within the batch."""

    group: np.ndarray
    side: np.ndarray
    kind: np.ndarray
    xy: np.ndarray  # x1, y1, x2, y2
    part: np.ndarray

    @staticmethod
    def of(pieces: list[Segments]) -> Segments:
        if not pieces:
            none = np.empty(0, np.int64)
            return Segments(none, none, none, np.empty((0, 4)), none)
        offset = np.cumsum([0] + [int(p.part.max()) + 1 if len(p.part) else 0 for p in pieces])
        joined = [np.concatenate([getattr(p, name) for p in pieces]) for name in ("group", "side", "kind", "xy")]
        return Segments(*joined, np.concatenate([p.part + o for p, o in zip(pieces, offset, strict=False)]))


def ranges(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, k) for all k in low[i] .. high[i] - 1, some at a time."""
    n = np.maximum(high - low, 0)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
        i = np.repeat(np.arange(at, stop), n[at:stop])
        if len(i):
            yield i, np.arange(len(i)) - np.repeat(ends[at:stop] - n[at:stop] - before, n[at:stop]) + low[i]
        at = stop


def places(group: np.ndarray, key: np.ndarray, of_group: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """How many (group, key), which are sorted, lie before each wanted one (``right``: or are equal)."""
    n = len(key)
    tie = np.concatenate([np.full(n, 0 if right else 1), np.full(len(wanted), 1 if right else 0)])
    order = np.lexsort((tie, np.concatenate([key, wanted]), np.concatenate([group, of_group])))
    is_key = order < n
    count = np.cumsum(is_key)
    out = np.empty(len(wanted), np.int64)
    out[order[~is_key] - n] = count[~is_key]
    return out


def _cuts(s: Segments, tol: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where segments meet others: segment, place along it in length, x, y, whether the point was computed, and what x and y lack of it."""
    x1, y1, x2, y2 = s.xy.T
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    left, right = np.minimum(x1, x2), np.maximum(x1, x2)
    order = np.lexsort((low, s.group))
    last = places(s.group[order], low[order], s.group, high + 2 * tol, True)
    first = np.empty(len(order), np.int64)
    first[order] = np.arange(len(order)) + 1
    out = []
    for i, k in ranges(first, last):
        j = order[k]
        meet = (left[i] <= right[j] + 2 * tol[i]) & (left[j] <= right[i] + 2 * tol[i])
        i, j = i[meet], j[meet]
        t = tol[i]
        touched = np.zeros(len(i), bool)
        for a, b in ((i, j), (j, i)):  # ends of b on a
            dx, dy = x2[a] - x1[a], y2[a] - y1[a]
            length = np.hypot(dx, dy)
            safe = np.where(length > 0, length, 1.0)
            for px, py in ((x1[b], y1[b]), (x2[b], y2[b])):
                along = ((px - x1[a]) * dx + (py - y1[a]) * dy) / safe
                off = np.abs((px - x1[a]) * dy - (py - y1[a]) * dx) / safe
                on = (length > t) & (off <= t) & (along >= -t) & (along <= length + t)
                touched |= on
                none = np.zeros(on.sum())
                out.append((a[on], along[on], px[on], py[on], none > 0, none, none))
        dx, dy, ex, ey = x2[i] - x1[i], y2[i] - y1[i], x2[j] - x1[j], y2[j] - y1[j]
        den = dx * ey - dy * ex
        safe = np.where(den != 0, den, 1.0)
        t = ((x1[j] - x1[i]) * ey - (y1[j] - y1[i]) * ex) / safe
        u = ((x1[j] - x1[i]) * dy - (y1[j] - y1[i]) * dx) / safe
        cross = (den != 0) & ~touched & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        i, j, t, u, dx, dy, ex, ey = (v[cross] for v in (i, j, t, u, dx, dy, ex, ey))
        x, y, rest_x, rest_y = _crossings(s.xy[i], s.xy[j], t)
        made = np.ones(len(i), bool)
        out += [(i, t * np.hypot(dx, dy), x, y, made, rest_x, rest_y), (j, u * np.hypot(ex, ey), x, y, made, rest_x, rest_y)]
    every = np.arange(len(x1))
    none = np.zeros(len(every))
    out += [(every, np.full(len(every), -np.inf), x1, y1, none > 0, none, none), (every, np.full(len(every), np.inf), x2, y2, none > 0, none, none)]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _crossings(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where segments that cross do so, about ``near`` of the way along ``a``: x, y, and what these doubles lack, by the longest numbers at hand; a side along an axis says one ordinate."""
    (x1, y1, x2, y2), (x3, y3, x4, y4) = a.T.astype(np.longdouble), b.T.astype(np.longdouble)
    dx, dy, ex, ey = x2 - x1, y2 - y1, x4 - x3, y4 - y3
    den = dx * ey - dy * ex
    t = ((x3 - x1) * ey - (y3 - y1) * ex) / np.where(den != 0, den, 1)
    t = np.where((den != 0) & (np.abs(t - near) < 1e-3), t, near)  # all but parallel: as doubles say
    x = np.where(dx == 0, x1, np.where(ex == 0, x3, x1 + t * dx))
    y = np.where(dy == 0, y1, np.where(ey == 0, y3, y1 + t * dy))
    short_x, short_y = x.astype(float), y.astype(float)
    return short_x, short_y, (x - short_x).astype(float), (y - short_y).astype(float)


def _merge(group: np.ndarray, x: np.ndarray, y: np.ndarray, made: np.ndarray, tol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node of each point, and the point that stands for each node (a given vertex before a computed one)."""

    def runs(major: np.ndarray, v: np.ndarray) -> np.ndarray:
        order = np.lexsort((v, major))
        new = np.ones(len(v), bool)
        new[1:] = (major[order][1:] != major[order][:-1]) | (np.diff(v[order]) > tol[order][1:])
        out = np.empty(len(v), np.int64)
        out[order] = np.cumsum(new) - 1
        return out

    node = runs(runs(group, x), y)
    order = np.lexsort((y, x, made, node))
    first = np.ones(len(order), bool)
    first[1:] = node[order][1:] != node[order][:-1]
    return node, order[first]


class Arrangement:
    """Nodes and labelled pieces of ``groups`` groups.  ``nonzero``: for each side, whether its area is where rings wind around, not where they do so an odd number of times."""

    def __init__(self, s: Segments, groups: int, nonzero: tuple[bool, bool] = (False, False)):
        self.groups, self.segments = groups, s
        size = np.zeros(groups)
        np.maximum.at(size, s.group, np.abs(s.xy).max(axis=1) if len(s.xy) else np.empty(0))
        self.tol = np.maximum(size * RELATIVE, 1e-300)
        tol = self.tol[s.group]
        seg, along, x, y, made, rest_x, rest_y = _cuts(s, tol)
        node, stands = _merge(s.group[seg], x, y, made, 2 * tol[seg])
        self.x, self.y = x[stands], y[stands]
        self.rest_x, self.rest_y = rest_x[stands], rest_y[stands]
        self.node_group = s.group[seg][stands]
        order = np.lexsort((along, seg))
        a, b = order[:-1], order[1:]
        part = (seg[a] == seg[b]) & (node[a] != node[b])
        owner, u, v = seg[a[part]], node[a[part]], node[b[part]]
        lo, hi = np.minimum(u, v), np.maximum(u, v)
        keys, which = np.unique(lo * len(self.x) + hi, return_inverse=True)
        self.lo, self.hi = keys // max(len(self.x), 1), keys % max(len(self.x), 1)
        n = len(keys)
        self.group = self.node_group[self.lo]
        self.piece_of, self.piece_segment = which, owner
        side, kind = s.side[owner], s.kind[owner]
        tally = lambda chosen, w=None: np.bincount(which[chosen], None if w is None else w[chosen], n).astype(np.int64)
        self.area = [tally((side == k) & (kind == AREA), np.where(u < v, 1, -1) if nonzero[k] else None) for k in (0, 1)]
        self.line = [tally((side == k) & (kind == LINE)) > 0 for k in (0, 1)]
        self.of_segment = node[np.flatnonzero(along == -np.inf)][np.argsort(seg[along == -np.inf])], node[np.flatnonzero(along == np.inf)][np.argsort(seg[along == np.inf])]
        self.nonzero = nonzero
        self._label()

    def _label(self) -> None:
        x1, y1, x2, y2 = self.x[self.lo], self.y[self.lo], self.x[self.hi], self.y[self.hi]
        self.lone = np.setdiff1d(np.arange(len(self.x)), np.concatenate([self.lo, self.hi]))
        middle = (y1 + y2) / 2
        # a piece without a height that numbers can halve is asked about from just above
        flat = ~((np.minimum(y1, y2) < middle) & (middle < np.maximum(y1, y2)))
        qx, qy = np.concatenate([(x1 + x2) / 2, self.x[self.lone]]), np.concatenate([np.where(flat, np.maximum(y1, y2), middle), self.y[self.lone]])
        own = np.concatenate([np.arange(len(x1)), np.full(len(self.lone), -1)])
        of = np.concatenate([self.group, self.node_group[self.lone]])
        order = np.lexsort((qy, of))
        counts = []
        for weights, winds in zip(self.area, self.nonzero, strict=True):
            total = np.zeros(len(qx))
            p = np.flatnonzero((weights != 0) & (y1 != y2))
            bottom, top = np.minimum(y1[p], y2[p]), np.maximum(y1[p], y2[p])
            first = places(of[order], qy[order], self.group[p], bottom, False)
            last = places(of[order], qy[order], self.group[p], top, False)
            for i, k in ranges(first, last):
                q, i = order[k], p[i]
                at = x1[i] + (qy[q] - y1[i]) * ((x2[i] - x1[i]) / (y2[i] - y1[i]))
                hit = (at > qx[q]) & (own[q] != i)
                q, i = q[hit], i[hit]
                total += np.bincount(q, np.where(y2[i] > y1[i], weights[i], -weights[i]) if winds else weights[i], len(qx))
            counts.append(total.astype(np.int64))
        inside = lambda w, winds: w != 0 if winds else w % 2 == 1
        n = len(x1)
        right_known = np.where(flat, x2 < x1, y2 > y1)
        sides = list(zip(counts, self.area, self.nonzero, strict=True))
        self.left = [inside(np.where(right_known, c[:n] + w, c[:n]), winds) for c, w, winds in sides]
        self.right = [inside(np.where(right_known, c[:n], c[:n] - w), winds) for c, w, winds in sides]
        self.lone_inside = [inside(c[n:], winds) for c, _, winds in sides]

    # relations

    def _locations(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces and nodes lie in a side's shape."""
        s = self.segments
        border = self.left[side] != self.right[side]
        pieces = np.where(border, BOUNDARY, np.where(self.left[side], INTERIOR, EXTERIOR))
        pieces = np.where(self.line[side], INTERIOR, pieces)
        nodes = np.full(len(self.x), EXTERIOR)
        nodes[self.lone] = np.where(self.lone_inside[side], INTERIOR, EXTERIOR)
        for end in (self.lo, self.hi):
            nodes[end[self.left[side] & self.right[side]]] = INTERIOR
        for end in (self.lo, self.hi):
            nodes[end[border]] = BOUNDARY
        for end in (self.lo, self.hi):
            nodes[end[self.line[side]]] = INTERIOR
        mine = (s.side == side) & (s.kind == LINE)
        first, last = self.of_segment
        nodes[first[mine & (first == last)]] = INTERIOR
        # ends of lines, an odd number of them at a node: its first and last vertex
        ends = np.zeros(len(self.x), np.int64)
        if mine.any():
            k = np.flatnonzero(mine)
            head, tail = np.ones(len(k), bool), np.ones(len(k), bool)
            head[1:] = tail[:-1] = s.part[k][1:] != s.part[k][:-1]
            np.add.at(ends, first[k[head]], 1)
            np.add.at(ends, last[k[tail]], 1)
        nodes[ends % 2 == 1] = BOUNDARY
        nodes[first[(s.side == side) & (s.kind == POINT)]] = INTERIOR
        return pieces, nodes

    def matrices(self) -> np.ndarray:
        """Dimensions (-1 for none) of the common parts of interiors, boundaries and exteriors: groups x 3 x 3."""
        out = np.full((self.groups, 3, 3), -1)
        out[:, EXTERIOR, EXTERIOR] = 2
        (pa, na), (pb, nb) = self._locations(0), self._locations(1)
        np.maximum.at(out, (self.node_group, na, nb), 0)
        np.maximum.at(out, (self.group, pa, pb), 1)
        for face in (self.left, self.right):
            np.maximum.at(out, (self.group, np.where(face[0], INTERIOR, EXTERIOR), np.where(face[1], INTERIOR, EXTERIOR)), 2)
        return out

    def simple(self) -> np.ndarray:
        """Whether no segment of a group was cut or repeated and every node has two pieces: one ring that doesn't meet itself."""
        s = self.segments
        pieces, segments = np.bincount(self.group, minlength=self.groups), np.bincount(s.group, minlength=self.groups)
        degree = np.bincount(self.lo, minlength=len(self.x)) + np.bincount(self.hi, minlength=len(self.x))
        odd = np.bincount(self.node_group[degree != 2], minlength=self.groups)
        return (pieces == segments) & (odd == 0) & (pieces > 2)

    # overlays

    def rings(self, keep: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Group and nodes of the rings around the area where ``keep[a, b]`` holds (a, b: whether in side 0 and 1), which lies on their left."""
        in_left = keep[self.left[0].astype(int), self.left[1].astype(int)]
        in_right = keep[self.right[0].astype(int), self.right[1].astype(int)]
        edge = np.flatnonzero(in_left != in_right)
        start = np.where(in_left[edge], self.lo[edge], self.hi[edge])
        end = np.where(in_left[edge], self.hi[edge], self.lo[edge])
        angle = np.arctan2(self.y[end] - self.y[start], self.x[end] - self.x[start])
        order = np.lexsort((angle, start))
        start, end, angle = start[order], end[order], angle[order]
        back = np.arctan2(self.y[start] - self.y[end], self.x[start] - self.x[end])
        # the first way out, turning clockwise from where the edge came from
        way = places(start, angle, end, back, False) - 1
        first, last = np.searchsorted(start, end, side="left"), np.searchsorted(start, end, side="right")
        way = np.where(way < first, last - 1, way)
        following, tail = way.tolist(), start.tolist()
        seen = bytearray(len(tail))
        found: list[list[int]] = []
        for e in range(len(tail)):
            if seen[e]:
                continue
            path: list[int] = []
            at: dict[int, int] = {}
            while not seen[e]:
                seen[e] = 1
                node = tail[e]
                if node in at:  # a ring that is touched by itself comes apart
                    cut = at[node]
                    found.append(path[cut:])
                    for gone in path[cut + 1 :]:
                        at.pop(gone, None)
                    del path[cut + 1 :]
                else:
                    at[node] = len(path)
                    path.append(node)
                e = following[e]
            found.append(path)
        found = [self._straightened(r) for r in found if len(r) > 2]
        found = [r for r in found if len(r) > 2]
        return np.array([self.node_group[r[0]] for r in found], np.int64), found

    def _straightened(self, ring: list[int]) -> list[int]:
        """Without nodes between two edges of one direction."""
        x, y = self.x[ring], self.y[ring]
        ax, ay, bx, by = x - np.roll(x, 1), y - np.roll(y, 1), np.roll(x, -1) - x, np.roll(y, -1) - y
        bent = np.abs(ax * by - ay * bx) > 4 * self.tol[self.node_group[ring[0]]] * np.maximum(np.hypot(ax, ay), np.hypot(bx, by))
        return ring if bent.all() else [r for r, b in zip(ring, bent.tolist(), strict=True) if b]

    def areas(self, keep: np.ndarray) -> np.ndarray:
        """For each group the area of what :meth:`rings` run around, without putting rings together; summed in the longest numbers at hand, so that it is right to its last digit."""
        in_left = keep[self.left[0].astype(int), self.left[1].astype(int)]
        in_right = keep[self.right[0].astype(int), self.right[1].astype(int)]
        edge = np.flatnonzero(in_left != in_right)
        g = self.group[edge]  # ascending, as nodes are
        origin = np.zeros((2, self.groups), np.longdouble)
        origin[0, self.node_group], origin[1, self.node_group] = self.x, self.y
        lo, hi = self.lo[edge], self.hi[edge]
        x1, x2 = self.x[lo] - origin[0, g] + self.rest_x[lo], self.x[hi] - origin[0, g] + self.rest_x[hi]
        y1, y2 = self.y[lo] - origin[1, g] + self.rest_y[lo], self.y[hi] - origin[1, g] + self.rest_y[hi]
        out = np.zeros(self.groups)
        if len(g):
            found, first = np.unique(g, return_index=True)
            out[found] = np.add.reduceat(np.where(in_left[edge], 0.5, -0.5) * (x1 * y2 - x2 * y1), first)
        return out

    def polygons(self, keep: np.ndarray) -> list[list[list[np.ndarray]]]:
        """For each group the polygons of :meth:`rings`: an outer ring, counter-clockwise, and the holes in it, clockwise."""
        groups, rings = self.rings(keep)
        points = [np.column_stack([self.x[r], self.y[r]]) for r in rings]
        area = [_area(p) for p in points]
        out: list[list[list[np.ndarray]]] = [[] for _ in range(self.groups)]
        outer: list[list[tuple[float, int, np.ndarray]]] = [[] for _ in range(self.groups)]
        for g, p, a in zip(groups.tolist(), points, area, strict=True):
            if a > 0:
                outer[g].append((a, len(out[g]), p))
                out[g].append([p])
        for g in {g for g, a in zip(groups.tolist(), area, strict=True) if a < 0}:
            outer[g].sort(key=lambda o: o[0])
        for g, p, a in zip(groups.tolist(), points, area, strict=True):
            if a < 0:
                middle = (p[0] + p[1]) / 2
                home = next((k for size, k, o in outer[g] if size >= -a and _holds(o, middle)), None)
                if home is not None:
                    out[g][home].append(p)
        return out


def _area(p: np.ndarray) -> float:
    q = p - p[0]
    return float(np.dot(q[:, 0], np.roll(q[:, 1], -1)) - np.dot(np.roll(q[:, 0], -1), q[:, 1])) / 2


def _holds(ring: np.ndarray, p: np.ndarray) -> bool:
    x1, y1 = ring.T
    x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
    across = (y1 > p[1]) != (y2 > p[1])
    x = x1[across] + (p[1] - y1[across]) * (x2[across] - x1[across]) / (y2[across] - y1[across])
    return bool(np.count_nonzero(x > p[0]) % 2)


# For each overlay, whether an area stays that lies (outside, inside) of the first and of the second shape.
KEEP = {
    "intersection": np.array([[False, False], [False, True]]),
    "union": np.array([[False, True], [True, True]]),
    "difference": np.array([[False, False], [True, False]]),
    "symmetric_difference": np.array([[False, True], [True, False]]),
}
