"""Ellipsoids, Helmert parameters and datum shifts as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridian.functions.binding import bind, named


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float

    @classmethod
    def from_inverse_flattening(cls, a: float, inverse: float) -> Ellipsoid:
        return cls(a, 1 / inverse)

    @property
    def b(self) -> float:
        return self.a * (1 - self.f)

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def second_e2(self) -> float:
        return self.e2 / (1 - self.e2)


# Published defining constants.
WGS84 = Ellipsoid.from_inverse_flattening(6378137.0, 298.257223563)
GRS80 = Ellipsoid.from_inverse_flattening(6378137.0, 298.257222101)
AIRY = Ellipsoid.from_inverse_flattening(6377563.396, 299.3249646)


@dataclass(frozen=True)
class Helmert:
    """Seven parameters, position vector convention: metres, radians, scale difference."""

    tx: float
    ty: float
    tz: float
    rx: float
    ry: float
    rz: float
    s: float

    @classmethod
    def from_arcsec_ppm(cls, tx: float, ty: float, tz: float, rx: float, ry: float, rz: float, ppm: float) -> Helmert:
        unit = math.pi / 180 / 3600
        return cls(tx, ty, tz, rx * unit, ry * unit, rz * unit, ppm * 1e-6)


# The published parameters from OSGB36 to WGS84.
OSGB36_TO_WGS84 = Helmert.from_arcsec_ppm(446.448, -125.157, 542.060, 0.1502, 0.2470, 0.8421, -20.4894)


def to_geocentric(e: Ellipsoid, lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    """Degrees and metres to earth-centred x, y, z."""
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(e.a) / F.sqrt(1 - e.e2 * F.sin(phi) * F.sin(phi))
    return (n + h) * F.cos(phi) * F.cos(lam), (n + h) * F.cos(phi) * F.sin(lam), (n * (1 - e.e2) + h) * F.sin(phi)


def to_geodetic(e: Ellipsoid, x: Column, y: Column, z: Column, rounds: int = 10) -> tuple[Column, Column, Column]:
    """Latitude by fixed-point iteration, safe at the poles; degrees and metres."""
    p = F.sqrt(x * x + y * y)
    start = F.atan2(z, p * (1 - e.e2))

    def step(phi: Column, _: Column) -> Column:
        n = F.lit(e.a) / F.sqrt(1 - e.e2 * F.sin(phi) * F.sin(phi))
        return F.atan2(z + e.e2 * n * F.sin(phi), p)

    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    n = F.lit(e.a) / F.sqrt(1 - e.e2 * F.sin(phi) * F.sin(phi))
    h = p * F.cos(phi) + z * F.sin(phi) - n * (1 - e.e2 * F.sin(phi) * F.sin(phi))
    return F.degrees(phi), F.degrees(F.atan2(y, x)), h


def helmert(t: Helmert, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    m = 1 + t.s
    return (
        t.tx + m * (x - t.rz * y + t.ry * z),
        t.ty + m * (t.rz * x + y - t.rx * z),
        t.tz + m * (-t.ry * x + t.rx * y + z),
    )


def inverse_helmert(t: Helmert, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The exact inverse: the rotation's 3 x 3 matrix is inverted once, on the driver."""
    m = 1 + t.s
    a = [[m, -m * t.rz, m * t.ry], [m * t.rz, m, -m * t.rx], [-m * t.ry, m * t.rx, m]]
    det = sum(a[0][i] * (a[1][(i + 1) % 3] * a[2][(i + 2) % 3] - a[1][(i + 2) % 3] * a[2][(i + 1) % 3]) for i in range(3))
    inv = [[(a[(j + 1) % 3][(i + 1) % 3] * a[(j + 2) % 3][(i + 2) % 3] - a[(j + 1) % 3][(i + 2) % 3] * a[(j + 2) % 3][(i + 1) % 3]) / det for j in range(3)] for i in range(3)]
    dx, dy, dz = x - t.tx, y - t.ty, z - t.tz
    return tuple(row[0] * dx + row[1] * dy + row[2] * dz for row in inv)


def _shifted(lat: Column, lon: Column, source: Ellipsoid, target: Ellipsoid, shift: Callable) -> tuple[Column, Column]:
    """Degrees on another ellipsoid, at height 0; the resulting height is dropped.  Each step's values are bound once."""
    start = bind(named(lat=lat, lon=lon), lambda p: named(**dict(zip("xyz", to_geocentric(source, p["lat"], p["lon"], F.lit(0.0)), strict=True))))
    moved = bind(start, lambda g: named(**dict(zip("xyz", shift(OSGB36_TO_WGS84, g["x"], g["y"], g["z"]), strict=True))))
    there = bind(moved, lambda g: named(**dict(zip(("lat", "lon"), to_geodetic(target, g["x"], g["y"], g["z"])[:2], strict=True))))
    return there["lat"], there["lon"]


def osgb36_to_wgs84(lat: Column, lon: Column) -> tuple[Column, Column]:
    return _shifted(lat, lon, AIRY, WGS84, helmert)


def wgs84_to_osgb36(lat: Column, lon: Column) -> tuple[Column, Column]:
    return _shifted(lat, lon, WGS84, AIRY, inverse_helmert)
