"""Areas of overlays against exact fractions of the doubles that are given."""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pytest

from meridian.functions.arrangement import AREA, KEEP, Arrangement, Segments


def exact(p):
    return [(Fraction(x), Fraction(y)) for x, y in p]


def area(p):
    return sum((x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1])), Fraction(0)) / 2


def common(p, q):
    for (ax, ay), (bx, by) in zip(q, q[1:] + q[:1]):
        side = lambda v: (bx - ax) * (v[1] - ay) - (by - ay) * (v[0] - ax)  # noqa: B023, E731
        kept = []
        for u, v in zip(p, p[1:] + p[:1]):
            fu, fv = side(u), side(v)
            kept += [u] if fu >= 0 else []
            if fu * fv < 0:
                t = fu / (fu - fv)
                kept.append((u[0] + t * (v[0] - u[0]), u[1] + t * (v[1] - u[1])))
        p = kept
    return area(p)


def shape(rng):
    x, y, h = rng.randrange(-90000, 90000) % 6000 / 100 + 800, rng.randrange(6000) / 100 - 900, float(rng.randrange(10, 100))
    top = [(x, y + h)] if rng.random() < 0.4 else [(x + h, y + h), (x - h, y + h)]
    return [(x - h, y - h), (x + h, y - h), *top]


@pytest.mark.parametrize("operation", sorted(KEEP))
def test_areas_are_right_to_the_last_digit(operation):
    rng = random.Random(7)
    pairs = [(shape(rng), shape(rng)) for _ in range(600)]
    pieces = []
    for side in (0, 1):
        rows = [(g, *a, *b) for g, pair in enumerate(pairs) for a, b in zip(pair[side], pair[side][1:] + pair[side][:1])]
        table = np.array(rows)
        group = table[:, 0].astype(np.int64)
        pieces.append(Segments(group, np.full(len(rows), side), np.full(len(rows), AREA), table[:, 1:], group))
    got = Arrangement(Segments.of(pieces), len(pairs)).areas(KEEP[operation])
    for (p, q), g in zip(pairs, got.tolist()):
        a, b, both = area(exact(p)), area(exact(q)), common(exact(p), exact(q))
        want = {"intersection": both, "union": a + b - both, "difference": a - both, "symmetric_difference": a + b - 2 * both}[operation]
        assert abs(Fraction(g) - want) <= np.spacing(float(want)) * 0.51 + 2e-14
