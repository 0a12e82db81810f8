"""Convex hulls and simplified lines of many rows at once, in numpy, for Arrow functions.

Rows are points one after another with the number of their row, which doesn't fall.
"""

from __future__ import annotations

import numpy as np


def _chains(x: np.ndarray, y: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which points, sorted by row and x, belong to the lower boundary of their row.

    In rounds, points on or above the line between their neighbours go.  Of neighbours that could go at once, every other one
    does, so that each goes by points that stay.
    """
    left = np.arange(len(x))
    while True:
        xs, ys, rs = x[left], y[left], row[left]
        bad = np.zeros(len(left), bool)
        if len(left) > 2:
            turn = (xs[1:-1] - xs[:-2]) * (ys[2:] - ys[:-2]) - (ys[1:-1] - ys[:-2]) * (xs[2:] - xs[:-2])
            bad[1:-1] = (turn <= 0) & (rs[:-2] == rs[2:])
        if not bad.any():
            return left
        begins = bad & ~np.append(False, bad[:-1])
        run = np.arange(len(bad)) - np.maximum.accumulate(np.where(begins, np.arange(len(bad)), 0))
        left = left[~(bad & (run % 2 == 0))]


def convex_hulls(xy: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the hull of each row's points, counter-clockwise, open and without collinear ones, and their rows.

    Repeated points count once; rows of one or two points come back sorted.
    """
    order = np.lexsort((xy[:, 1], xy[:, 0], row))
    xy, row = xy[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (xy[1:] != xy[:-1]).any(axis=1)
    xy, row = xy[new], row[new]
    below = _chains(xy[:, 0], xy[:, 1], row)
    back = np.arange(len(row))[::-1]
    above = back[_chains(-xy[back, 0], -xy[back, 1], -row[back])]
    first, last = np.ones(len(row), bool), np.ones(len(row), bool)
    first[1:] = last[:-1] = row[1:] != row[:-1]
    above = above[~first[above] & ~last[above]]
    place = np.concatenate([below, above])
    rank = np.concatenate([np.arange(len(below)), len(below) + np.arange(len(above))])
    place = place[np.lexsort((rank, row[place]))]
    return xy[place], row[place]


def simplified(xy: np.ndarray, row: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points stay when lines are simplified by the distance to the segment between points that stay (Douglas and Peucker).

    All open stretches of all rows are split together, so there are as many rounds as the deepest line has splits.
    """
    keep = np.ones(len(row), bool)
    keep[1:-1] = (row[1:-1] != row[:-2]) | (row[1:-1] != row[2:])
    ends = np.flatnonzero(keep)
    a, b = ends[:-1], ends[1:]
    inner = (row[a] == row[b]) & (b - a > 1)
    a, b = a[inner], b[inner]
    while len(a):
        n = b - a - 1
        start = np.cumsum(n) - n
        which = np.repeat(np.arange(len(a)), n)
        k = np.arange(len(which)) - start[which] + a[which] + 1
        d = xy[b] - xy[a]
        square = (d * d).sum(axis=1)
        off = xy[k] - xy[a][which]
        t = np.clip((off * d[which]).sum(axis=1) / np.where(square > 0, square, 1.0)[which], 0.0, 1.0)
        far = np.hypot(*(off - t[:, None] * d[which]).T)
        most = np.maximum.reduceat(far, start)
        at = np.flatnonzero(far == most[which])
        at = k[at[np.unique(which[at], return_index=True)[1]]]  # the first of equals
        split = most > tolerance
        keep[at[split]] = True
        a, b = np.concatenate([a[split], at[split]]), np.concatenate([at[split], b[split]])
        wide = b - a > 1
        a, b = a[wide], b[wide]
    return keep
