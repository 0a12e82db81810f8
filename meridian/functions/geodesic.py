"""Geodesics on an ellipsoid, to within rounding for any pair of points, and areas of polygons whose edges they are.

On the auxiliary sphere, distance, longitude, reduced length and area along a geodesic are integrals of smooth functions
of the arc length; twelve Gauss-Legendre nodes give all digits of a double.  The inverse problem is solved for the
azimuth at the first point by Newton steps that are kept within a shrinking bracket, so that near antipodes, where the
longitude barely determines the azimuth, it ends as surely as elsewhere.

Columns go through Arrow batches as numpy arrays.  Null where a coordinate isn't finite or a latitude passes 90 degrees.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from meridian.crs.ellipsoid import WGS84, Ellipsoid

from .binding import named

_X, _W = np.polynomial.legendre.leggauss(12)
#: More steps than halving a bracket down to neighbouring doubles takes: a bound of the arithmetic, not of the method.
STEPS = 200
TINY = 1e-150


def _integral(function, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of a function of sin(sigma), over arcs of at most half a turn."""
    middle, half = (start + end) / 2, (end - start) / 2
    total = np.zeros_like(middle)
    for x, w in zip(_X, _W, strict=True):
        total += w * function(np.sin(middle + half * x))
    return total * half


class Geodesics:
    """The integrals of one ellipsoid."""

    def __init__(self, e: Ellipsoid):
        self.a, self.b, self.f = e.a, e.b, e.f
        self.e2, self.ep2 = e.f * (2 - e.f), e.f * (2 - e.f) / (1 - e.f) ** 2
        root = math.sqrt(self.e2)
        #: A quarter of the area over 2 pi: the square of the authalic radius.
        self.c2 = self.a**2 / 2 + self.b**2 / 2 * (math.atanh(root) / root if root else 1.0)
        # t(x) = x + sqrt(1/x + 1) asinh(sqrt(x)) as a power series, then (t(ep2) - t(x)) / (ep2 - x) as one
        n = 24
        a = [(-4.0) ** k * math.factorial(k) ** 2 / math.factorial(2 * k + 1) for k in range(n)]
        t = [a[0], *[a[k] + a[k - 1] for k in range(1, n)]]
        t[1] += 1
        self.d = [sum(t[m] * self.ep2 ** (m - 1 - k) for m in range(k + 1, n)) for k in range(n - 1)]

    def length(self, k2: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
        return self.b * _integral(lambda s: np.sqrt(1 + k2 * s * s), s1, s2)

    def turn(self, k2: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
        """What longitude lags behind that of the sphere, over f sin(alpha0)."""
        return _integral(lambda s: (2 - self.f) / (1 + (1 - self.f) * np.sqrt(1 + k2 * s * s)), s1, s2)

    def reduced(self, k2: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
        """Reduced length over b."""
        j = _integral(lambda s: k2 * s * s / np.sqrt(1 + k2 * s * s), s1, s2)
        w = lambda s: np.sqrt(1 + k2 * np.sin(s) ** 2)
        return w(s2) * np.cos(s1) * np.sin(s2) - w(s1) * np.sin(s1) * np.cos(s2) - np.cos(s1) * np.cos(s2) * j

    def lune(self, k2: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
        """The area integral, over e2 a2 cos(alpha0) sin(alpha0)."""

        def inner(s: np.ndarray) -> np.ndarray:
            x, total = k2 * s * s, np.zeros_like(s)
            for c in reversed(self.d):
                total = total * x + c
            return total * s

        return -_integral(inner, s1, s2) / 2

    def _along(self, alpha: tuple[np.ndarray, np.ndarray], beta1: tuple, beta2: tuple) -> dict[str, np.ndarray]:
        """The geodesic that leaves the lower point at (sin, cos) ``alpha`` until it reaches the other latitude going north."""
        (sa, ca), (sb1, cb1), (sb2, cb2) = alpha, beta1, beta2
        s0, c0 = sa * cb1, np.hypot(ca, sa * sb1)
        across = np.where(cb2 > cb1, (ca * cb1) ** 2 + (cb2 - cb1) * (cb2 + cb1), (ca * cb1) ** 2 + (sb1 - sb2) * (sb1 + sb2))
        same = (cb1 == cb2) & (np.abs(sb1) == np.abs(sb2))
        c2b = np.where(same, np.abs(ca * cb1), np.sqrt(np.maximum(across, 0.0)))  # cos(alpha2) cos(beta2)
        sigma1, sigma2 = np.arctan2(sb1, ca * cb1), np.arctan2(sb2, c2b)
        omega1, omega2 = np.arctan2(s0 * sb1, ca * cb1), np.arctan2(s0 * sb2, c2b)
        k2 = self.ep2 * c0 * c0
        omega = omega2 - omega1
        omega = np.where(omega < 0, omega + 2 * np.pi, omega)
        sigma1 = np.where(sigma1 > sigma2, sigma1 - 2 * np.pi, sigma1)
        lam = omega - self.f * s0 * self.turn(k2, sigma1, sigma2)
        return {"s0": s0, "c0": c0, "k2": k2, "sigma1": sigma1, "sigma2": sigma2, "omega": omega, "lam": lam, "c2b": c2b}

    def inverse(self, lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> dict[str, np.ndarray]:
        """``distance``, azimuths ``initial`` and ``final`` (degrees) and the ``area`` between the geodesic and the equator."""
        lon = np.remainder(lon2 - lon1 + 180.0, 360.0) - 180.0
        lon = np.where((lon == -180.0) & (lon2 > lon1), 180.0, lon)
        east = np.where((lon < 0) | ((lon == 0) & np.signbit(lon)), -1.0, 1.0)
        lon = np.abs(lon)
        swap = np.where(np.abs(lat1) < np.abs(lat2), -1.0, 1.0)
        east = east * swap
        low, high = np.where(swap < 0, lat2, lat1), np.where(swap < 0, lat1, lat2)
        north = np.where((low < 0) | ((low == 0) & np.signbit(low)), 1.0, -1.0)
        beta1, beta2 = self._beta(low * north), self._beta(high * north)
        beta1 = (np.where(beta1[0] == 0, -TINY, beta1[0]), beta1[1])
        even = np.abs(high) == np.abs(low)
        beta2 = (np.where(even, np.where(high * north < 0, beta1[0], -beta1[0]), beta2[0]), np.where(even, beta1[1], beta2[1]))
        lam = np.radians(lon)
        meridian = (lon == 0) | (lon == 180.0) | (np.abs(low) == 90)
        equator = (low == 0) & (high == 0) & (lam <= (1 - self.f) * np.pi) & ~meridian
        sa, ca = np.where(meridian, np.where(lon == 180.0, 0.0, np.sin(lam)), 1.0), np.where(meridian, np.where(lon == 180.0, -1.0, np.cos(lam)), 0.0)
        rest = np.flatnonzero(~meridian & ~equator)
        if len(rest):
            sa[rest], ca[rest] = self._solve(tuple(v[rest] for v in beta1), tuple(v[rest] for v in beta2), lam[rest])
        g = self._along((sa, ca), beta1, beta2)
        s12 = np.where(equator, self.a * lam, self.length(g["k2"], g["sigma1"], g["sigma2"]))
        cb2 = np.maximum(beta2[1], TINY)
        sa2, ca2 = g["s0"] / cb2, g["c2b"] / cb2
        size = np.hypot(sa2, ca2)
        sa2, ca2 = np.where(size > 0, sa2 / size, 0.0), np.where(size > 0, ca2 / size, 1.0)
        pole2 = np.abs(high) == 90
        sa2, ca2 = np.where(meridian, 0.0, sa2), np.where(meridian, 1.0, ca2)
        sa2, ca2 = np.where(equator, 1.0, sa2), np.where(equator, 0.0, ca2)
        if pole2.any() and (~meridian & pole2).any():
            raise AssertionError("a pole lies on a meridian")
        # how much the azimuth turns, by half angles where that is exact
        somg, comg = np.sin(g["omega"]), np.cos(g["omega"])
        near = ~meridian & (comg > -0.7071) & (beta2[0] - beta1[0] < 1.75)
        d1, d2 = 1 + beta1[1], 1 + beta2[1]
        half = 2 * np.arctan2(somg * (beta1[0] * d2 + beta2[0] * d1), (1 + comg) * (beta1[0] * beta2[0] + d1 * d2))
        s12a, c12a = sa2 * ca - ca2 * sa, ca2 * ca + sa2 * sa
        s12a = np.where((s12a == 0) & (c12a < 0), TINY * ca, s12a)
        turned = np.where(near, half, np.arctan2(s12a, c12a))
        turned = np.where(equator, 0.0, turned)
        area = self.c2 * turned + self.e2 * self.a**2 * g["c0"] * g["s0"] * self.lune(g["k2"], g["sigma1"], g["sigma2"])
        area = np.where(equator, 0.0, area) * swap * east * north
        first = (np.where(swap < 0, sa2, sa) * swap * east, np.where(swap < 0, ca2, ca) * swap * north)
        last = (np.where(swap < 0, sa, sa2) * swap * east, np.where(swap < 0, ca, ca2) * swap * north)
        return {"distance": s12, "initial": _bearing(*first), "final": _bearing(*last), "area": area + 0.0, "first": first, "last": last}

    def _beta(self, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sin, cos) of the reduced latitude; the cosine of a pole is tiny, not zero."""
        s, c = (1 - self.f) * np.sin(np.radians(lat)), np.where(np.abs(lat) == 90, 0.0, np.cos(np.radians(lat)))
        r = np.hypot(s, c)
        return s / r, np.maximum(c / r, TINY)

    def _solve(self, beta1: tuple, beta2: tuple, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Azimuth at the lower point from which longitude grows by ``lam``."""
        mean = np.sqrt(1 - self.e2 * ((beta1[1] + beta2[1]) / 2) ** 2)
        omega = np.minimum(lam / mean, np.pi * (1 - 1e-9))
        alpha = np.arctan2(beta2[1] * np.sin(omega), beta1[1] * beta2[0] - beta1[0] * beta2[1] * np.cos(omega))
        low, high = np.zeros_like(lam), np.full_like(lam, np.pi)
        open_ = np.arange(len(lam))
        for _ in range(STEPS):
            b1, b2 = tuple(v[open_] for v in beta1), tuple(v[open_] for v in beta2)
            now = alpha[open_]
            g = self._along((np.sin(now), np.cos(now)), b1, b2)
            miss = g["lam"] - lam[open_]
            low[open_] = np.where(miss <= 0, now, low[open_])
            high[open_] = np.where(miss > 0, now, high[open_])
            slope = self.reduced(g["k2"], g["sigma1"], g["sigma2"]) / np.maximum(g["c2b"], TINY)
            step = now - miss / np.where(slope > 0, slope, np.inf)
            inside = (slope > 0) & np.isfinite(step) & (step >= low[open_]) & (step <= high[open_])
            following = np.where(miss == 0, now, np.where(inside, step, (low[open_] + high[open_]) / 2))
            alpha[open_] = following
            moved = np.abs(following - now)
            going = (moved > 4e-16 * np.maximum(now, 1e-3)) & (miss != 0)
            open_ = open_[going]
            if not len(open_):
                break
        return np.sin(alpha), np.cos(alpha)

    def direct(self, lat: np.ndarray, lon: np.ndarray, azimuth: np.ndarray, distance: np.ndarray) -> dict[str, np.ndarray]:
        sb, cb = self._beta(lat)
        turn = np.remainder(azimuth, 360.0)
        sa, ca = np.sin(np.radians(turn)), np.cos(np.radians(turn))
        sa, ca = np.where(turn % 180 == 0, 0.0, sa), np.where(turn % 180 == 90, 0.0, ca)
        s0, c0 = sa * cb, np.hypot(ca, sa * sb)
        sigma1, omega1 = np.where((sb == 0) & (ca == 0), 0.0, np.arctan2(sb, ca * cb)), np.arctan2(s0 * sb, ca * cb)
        omega1 = np.where((sb == 0) & (ca == 0), 0.0, omega1)
        k2 = self.ep2 * c0 * c0
        zero = np.zeros_like(sigma1)
        whole = self.length(k2, zero, zero + np.pi)
        rounds = np.floor(distance / whole)
        rest = distance - rounds * whole
        arc = rest / whole * np.pi
        for _ in range(8):  # Newton on a function that is nearly straight: three steps reach the last digit
            arc = arc - (self.length(k2, sigma1, sigma1 + arc) - rest) / (self.b * np.sqrt(1 + k2 * np.sin(sigma1 + arc) ** 2))
        sigma2 = sigma1 + arc
        half = np.where(rounds % 2 == 0, 1.0, -1.0)
        s2, c2 = np.sin(sigma2) * half, np.cos(sigma2) * half
        sb2, cb2 = c0 * s2, np.hypot(s0, c0 * c2)
        # longitude turns with the arc: whole half turns, then the difference of angles within one
        omega2 = np.arctan2(s0 * s2, c2)
        way = np.where(s0 < 0, -1.0, 1.0)
        total = sigma2 + np.pi * rounds - sigma1
        omega = way * (total - (np.arctan2(s2, c2) - np.arctan2(np.sin(sigma1), np.cos(sigma1))) + np.arctan2(way * s0 * s2, c2) - np.arctan2(way * s0 * np.sin(sigma1), np.cos(sigma1)))
        lam = omega - self.f * s0 * (self.turn(k2, sigma1, sigma2) + rounds * self.turn(k2, zero, zero + np.pi))
        del omega1, omega2
        lat2 = np.degrees(np.arctan2(sb2, (1 - self.f) * cb2))
        lon2 = np.remainder(lon + np.degrees(lam) + 180.0, 360.0) - 180.0
        return {"lat": lat2, "lon": lon2, "final": _bearing(s0, c0 * c2)}


def _bearing(s: np.ndarray, c: np.ndarray) -> np.ndarray:
    b = np.degrees(np.arctan2(s, c))
    return np.where(b < 0, b + 360.0, b) % 360.0


@functools.lru_cache(maxsize=16)
def solver(e: Ellipsoid) -> Geodesics:
    return Geodesics(e)


def _numbers(column: pa.Array, fields: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The fields of a struct column and which rows have them all, finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = [np.array(pc.struct_field(column, [k]).to_numpy(zero_copy_only=False), float) for k in range(fields)]
    good = np.logical_and.reduce([np.isfinite(v) for v in values])
    return values, good & column.is_valid().to_numpy(zero_copy_only=False)


def _table(found: dict[str, np.ndarray], names: tuple[str, ...], good: np.ndarray) -> pa.Array:
    columns = []
    for n in names:
        full = np.full(len(good), np.nan)
        full[good] = found[n]
        columns.append(pa.array(full))
    return pa.StructArray.from_arrays(columns, list(names), mask=pa.array(~good))


def inverse(lat1: Column, lon1: Column, lat2: Column, lon2: Column, e: Ellipsoid = WGS84) -> Column:
    """Struct (distance in metres, initial and final bearing in degrees from north, in the direction of travel)."""

    def call(ends: pa.Array) -> pa.Array:
        values, good = _numbers(ends, 4)
        good &= (np.abs(values[0]) <= 90) & (np.abs(values[2]) <= 90)
        return _table(solver(e).inverse(*(v[good] for v in values)), ("distance", "initial", "final"), good)

    return F.arrow_udf(call, "distance double, initial double, final double")(named(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2))


def direct(lat: Column, lon: Column, bearing: Column, distance: Column, e: Ellipsoid = WGS84) -> Column:
    """Struct (lat, lon, final bearing) at ``distance`` metres along a geodesic."""

    def call(start: pa.Array) -> pa.Array:
        values, good = _numbers(start, 4)
        good &= np.abs(values[0]) <= 90
        return _table(solver(e).direct(*(v[good] for v in values)), ("lat", "lon", "final"), good)

    return F.arrow_udf(call, "lat double, lon double, final double")(named(lat=lat, lon=lon, bearing=bearing, distance=distance))


def sample(lat1: Column, lon1: Column, lat2: Column, lon2: Column, parts: int, e: Ellipsoid = WGS84) -> Column:
    """``parts + 1`` points at equal distances from the first to the second, both included."""
    if parts < 1:
        raise ValueError("parts must be 1 or more")

    def call(ends: pa.Array) -> pa.Array:
        values, good = _numbers(ends, 4)
        good &= (np.abs(values[0]) <= 90) & (np.abs(values[2]) <= 90)
        a, b, c, d = (v[good] for v in values)
        way = solver(e).inverse(a, b, c, d)
        share = np.tile(np.arange(parts + 1) / parts, len(a))
        again = lambda v: np.repeat(v, parts + 1)
        p = solver(e).direct(again(a), again(b), again(way["initial"]), again(way["distance"]) * share)
        for ends_at, (lat, lon) in ((0, (a, b)), (parts, (c, d))):
            p["lat"][ends_at :: parts + 1], p["lon"][ends_at :: parts + 1] = lat, lon
        points = pa.StructArray.from_arrays([pa.array(p["lat"]), pa.array(p["lon"])], ["lat", "lon"])
        size = np.where(good, parts + 1, 0)
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), points)
        return pc.if_else(pa.array(good), out, pa.scalar(None, out.type))

    return F.arrow_udf(call, "array<struct<lat: double, lon: double>>")(named(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2))


def ring_measures(g: Geodesics, ring: np.ndarray, lat: np.ndarray, lon: np.ndarray, rings: int) -> tuple[np.ndarray, np.ndarray]:
    """Perimeter and signed area (counter-clockwise positive, the smaller side of the ring) of rings of vertices one after another."""
    n = np.bincount(ring, minlength=rings)
    first = np.cumsum(n) - n
    following = np.arange(len(ring)) + 1
    following[(first + n - 1)[n > 0]] = first[n > 0]
    edge = g.inverse(lat, lon, lat[following], lon[following])
    # an edge that passes the antimeridian's opposite, longitude 0, changes on which side of the pole the area lies
    a, b = (np.remainder(v + 180.0, 360.0) - 180.0 for v in (lon, lon[following]))
    step = np.remainder(b - a + 180.0, 360.0) - 180.0
    eastward, westward = (a < 0) & (b >= 0) & (step > 0), (a >= 0) & (b < 0) & (step < 0)
    passes = np.bincount(ring, eastward.astype(int) - westward.astype(int), rings).astype(np.int64)
    total = np.zeros(rings)
    for k in np.unique(ring):  # sums of large terms of either sign: exactly
        total[k] = math.fsum(edge["area"][first[k] : first[k] + n[k]])
    whole = 4 * np.pi * g.c2
    total = np.where(passes % 2 != 0, total + np.where(total < 0, 0.5, -0.5) * whole, total)
    area = -total  # clockwise areas are positive above
    area = np.where(area > whole / 2, area - whole, np.where(area <= -whole / 2, area + whole, area))
    return np.bincount(ring, edge["distance"], rings), area


def polygon_measure(ring: Column, e: Ellipsoid = WGS84) -> Column:
    """Struct (perimeter in metres, area in square metres) of a ring (x: longitude, y: latitude) with geodesic edges.

    Counter-clockwise areas are positive; of the two sides of a ring, the smaller one counts.  Fewer than three vertices
    have no area.  Null for null and where a vertex isn't valid.
    """

    def call(column: pa.Array) -> pa.Array:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        points, owner = column.flatten(), np.repeat(np.arange(len(column)), size)
        (lon, lat), good = _numbers(points, 2)
        good &= np.abs(lat) <= 90
        known = column.is_valid().to_numpy(zero_copy_only=False)
        known[owner[~good]] = False
        use = known[owner]
        closed = np.ones(len(owner), bool)  # a last vertex that repeats the first is no other vertex
        ends = np.cumsum(size)
        some = size > 1
        closed[ends[some] - 1] = (lat[ends[some] - 1] != lat[(ends - size)[some]]) | (lon[ends[some] - 1] != lon[(ends - size)[some]])
        use &= closed
        perimeter, area = ring_measures(solver(e), owner[use], lat[use], lon[use], len(column))
        left = np.bincount(owner[use], minlength=len(column))
        area = np.where(left < 3, 0.0, area)
        return pa.StructArray.from_arrays([pa.array(perimeter), pa.array(area)], ["perimeter", "area"], mask=pa.array(~known))

    return F.arrow_udf(call, "perimeter double, area double")(ring)
