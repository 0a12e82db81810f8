"""Map projections as column expressions; their constants are folded on the driver.

Angles are degrees, distances metres.  Formulas: J. P. Snyder, Map Projections: A Working Manual
(USGS Professional Paper 1395).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ellipsoid import AIRY, GRS80, WGS84, Ellipsoid

#: The sphere and the latitude limit of Web Mercator.
RADIUS = 6378137.0
MERCATOR_LIMIT = 85.05112878


def wrap(lon: Column) -> Column:
    """To [-180, 180): 180 becomes -180."""
    return (((lon + 180) % 360) + 360) % 360 - 180


class WebMercator:
    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        phi = F.radians(F.greatest(F.lit(-MERCATOR_LIMIT), F.least(F.lit(MERCATOR_LIMIT), lat)))
        return RADIUS * F.radians(wrap(lon)), RADIUS * F.log(F.tan(math.pi / 4 + phi / 2))

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(lat, lon); the longitude isn't wrapped."""
        return F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2), F.degrees(x / RADIUS)


class TransverseMercator:
    """Ellipsoidal series (Snyder 8-9 to 8-25)."""

    def __init__(self, e: Ellipsoid, lat0: float, lon0: float | Column, k0: float, false_easting: float, false_northing: float | Column):
        self.e, self.lat0, self.lon0, self.k0 = e, lat0, lon0, k0
        self.false_easting, self.false_northing = false_easting, false_northing
        e2 = e.e2
        #: coefficients of the meridional arc
        self.arc = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)
        phi = math.radians(lat0)
        c = self.arc
        self.m0 = e.a * (c[0] * phi - c[1] * math.sin(2 * phi) + c[2] * math.sin(4 * phi) - c[3] * math.sin(6 * phi))

    def _arc(self, phi: Column) -> Column:
        c = self.arc
        return self.e.a * (c[0] * phi - c[1] * F.sin(2 * phi) + c[2] * F.sin(4 * phi) - c[3] * F.sin(6 * phi))

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        e2, es = self.e.e2, self.e.second_e2
        phi = F.radians(lat)
        a = F.radians(wrap(lon - self.lon0)) * F.cos(phi)
        n = self.e.a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
        t, c = F.tan(phi) * F.tan(phi), es * F.cos(phi) * F.cos(phi)
        a2 = a * a
        x = self.k0 * n * (a + (1 - t + c) * a * a2 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * es) * a * a2 * a2 / 120)
        y = self.k0 * (self._arc(phi) - self.m0 + n * F.tan(phi) * (a2 / 2 + (5 - t + 9 * c + 4 * c * c) * a2 * a2 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * es) * a2 * a2 * a2 / 720))
        return x + self.false_easting, y + self.false_northing

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(lat, lon) by the footpoint latitude; the longitude is wrapped."""
        e2, es = self.e.e2, self.e.second_e2
        mu = (self.m0 + (y - self.false_northing) / self.k0) / (self.e.a * self.arc[0])
        e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
        foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
        c, t = es * F.cos(foot) * F.cos(foot), F.tan(foot) * F.tan(foot)
        w = 1 - e2 * F.sin(foot) * F.sin(foot)
        n, rho = self.e.a / F.sqrt(w), self.e.a * (1 - e2) / (w * F.sqrt(w))
        d = (x - self.false_easting) / (n * self.k0)
        d2 = d * d
        lat = foot - (n * F.tan(foot) / rho) * (d2 / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * es) * d2 * d2 / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * es - 3 * c * c) * d2 * d2 * d2 / 720)
        lon = (d - (1 + 2 * t + c) * d * d2 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * es + 24 * t * t) * d * d2 * d2 / 120) / F.cos(foot)
        return F.degrees(lat), wrap(self.lon0 + F.degrees(lon))


def british_national_grid() -> TransverseMercator:
    return TransverseMercator(AIRY, 49.0, -2.0, 0.9996012717, 400000.0, -100000.0)


def utm_zone(lat: Column, lon: Column) -> Column:
    """1 to 60, with the exceptions for Norway and Svalbard; null where the position isn't one."""
    w = wrap(lon)
    plain = F.least(F.floor((w + 180) / 6) + 1, F.lit(60)).cast("int")
    norway = (lat >= 56) & (lat < 64) & (w >= 3) & (w < 12)
    svalbard = (lat >= 72) & (lat < 84)
    zone = F.when(norway, 32).when(svalbard & (w >= 0) & (w < 9), 31).when(svalbard & (w >= 9) & (w < 21), 33).when(svalbard & (w >= 21) & (w < 33), 35).when(svalbard & (w >= 33) & (w < 42), 37).otherwise(plain)
    return F.when((F.abs(lat) <= 90) & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lon) < float("inf")), zone)


def utm(zone: Column | int, north: Column | bool, e: Ellipsoid = WGS84) -> TransverseMercator:
    """Of a zone given by number or per row."""
    if isinstance(zone, int) and isinstance(north, bool):
        return TransverseMercator(e, 0.0, zone * 6.0 - 183, 0.9996, 500000.0, 0.0 if north else 10000000.0)
    zone, north = (F.lit(v) if not isinstance(v, Column) else v for v in (zone, north))
    return TransverseMercator(e, 0.0, zone * 6.0 - 183, 0.9996, 500000.0, F.when(north, 0.0).otherwise(10000000.0))


def utm_epsg(zone: Column, north: Column) -> Column:
    return F.when(north, 32600).otherwise(32700) + zone


class LambertConformalConic:
    """Two parallels, or one if both are equal.  The longitude difference isn't wrapped."""

    def __init__(self, e: Ellipsoid, lat0: float, lon0: float, lat1: float, lat2: float, false_easting: float, false_northing: float):
        self.e, self.lon0, self.false_easting, self.false_northing = e, lon0, false_easting, false_northing
        ecc = math.sqrt(e.e2)

        def m(phi: float) -> float:
            return math.cos(phi) / math.sqrt(1 - e.e2 * math.sin(phi) ** 2)

        def t(phi: float) -> float:
            s = ecc * math.sin(phi)
            return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (ecc / 2)

        p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
        self.n = math.sin(p1) if abs(p1 - p2) < 1e-12 else math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
        self.af = e.a * m(p1) / (self.n * t(p1) ** self.n)
        self.rho0 = self.af * t(p0) ** self.n

    @property
    def cone_constant(self) -> float:
        return self.n

    def _rho(self, phi: Column) -> Column:
        ecc = math.sqrt(self.e.e2)
        s = ecc * F.sin(phi)
        return self.af * F.pow(F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(ecc / 2)), F.lit(self.n))

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        rho, theta = self._rho(F.radians(lat)), self.n * F.radians(lon - self.lon0)
        return self.false_easting + rho * F.sin(theta), self.false_northing + self.rho0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        sign = math.copysign(1.0, self.n)
        dx, dy = x - self.false_easting, self.rho0 - (y - self.false_northing)
        rho = sign * F.sqrt(dx * dx + dy * dy)
        t = F.pow(rho / self.af, F.lit(1 / self.n))
        ecc = math.sqrt(self.e.e2)

        def step(phi: Column, _: Column) -> Column:
            s = ecc * F.sin(phi)
            return math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(ecc / 2)))

        phi = F.aggregate(F.sequence(F.lit(1), F.lit(8)), math.pi / 2 - 2 * F.atan(t), step)
        return F.degrees(phi), self.lon0 + F.degrees(F.atan2(sign * dx, sign * dy) / self.n)

    def parallel_scale(self, lat: Column) -> Column:
        phi = F.radians(lat)
        return self.n * self._rho(phi) * F.sqrt(1 - self.e.e2 * F.sin(phi) * F.sin(phi)) / (self.e.a * F.cos(phi))


def lambert93() -> LambertConformalConic:
    return LambertConformalConic(GRS80, 46.5, 3.0, 49.0, 44.0, 700000.0, 6600000.0)


class AlbersEqualArea:
    """The longitude difference isn't wrapped."""

    def __init__(self, e: Ellipsoid, lat0: float, lon0: float, lat1: float, lat2: float, false_easting: float, false_northing: float):
        self.e, self.lon0, self.false_easting, self.false_northing = e, lon0, false_easting, false_northing
        ecc = math.sqrt(e.e2)

        def m2(phi: float) -> float:
            return math.cos(phi) ** 2 / (1 - e.e2 * math.sin(phi) ** 2)

        def q(phi: float) -> float:
            s = math.sin(phi)
            return (1 - e.e2) * (s / (1 - e.e2 * s * s) - math.log((1 - ecc * s) / (1 + ecc * s)) / (2 * ecc))

        p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
        self.n = math.sin(p1) if abs(p1 - p2) < 1e-12 else (m2(p1) - m2(p2)) / (q(p2) - q(p1))
        self.c = m2(p1) + self.n * q(p1)
        self.rho0 = e.a * math.sqrt(self.c - self.n * q(p0)) / self.n

    @property
    def cone_constant(self) -> float:
        return self.n

    def _q(self, phi: Column) -> Column:
        ecc, s = math.sqrt(self.e.e2), F.sin(phi)
        return (1 - self.e.e2) * (s / (1 - self.e.e2 * s * s) - F.log((1 - ecc * s) / (1 + ecc * s)) / (2 * ecc))

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        rho = self.e.a * F.sqrt(self.c - self.n * self._q(F.radians(lat))) / self.n
        theta = self.n * F.radians(lon - self.lon0)
        return self.false_easting + rho * F.sin(theta), self.false_northing + self.rho0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        sign = math.copysign(1.0, self.n)
        dx, dy = x - self.false_easting, self.rho0 - (y - self.false_northing)
        rho2 = dx * dx + dy * dy
        q = (self.c - rho2 * self.n * self.n / self.e.a**2) / self.n
        ecc = math.sqrt(self.e.e2)

        def step(phi: Column, _: Column) -> Column:
            s = F.sin(phi)
            w = 1 - self.e.e2 * s * s
            return phi + w * w / (2 * F.cos(phi)) * (q / (1 - self.e.e2) - s / w + F.log((1 - ecc * s) / (1 + ecc * s)) / (2 * ecc))

        start = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / 2)))
        phi = F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step)
        return F.degrees(phi), self.lon0 + F.degrees(F.atan2(sign * dx, sign * dy) / self.n)

    def parallel_scale(self, lat: Column) -> Column:
        phi = F.radians(lat)
        return F.sqrt(self.c - self.n * self._q(phi)) * F.sqrt(1 - self.e.e2 * F.sin(phi) * F.sin(phi)) / F.cos(phi)


def conus_albers() -> AlbersEqualArea:
    return AlbersEqualArea(GRS80, 23.0, -96.0, 29.5, 45.5, 0.0, 0.0)


class LocalTangentPlane:
    """East and north metres around an origin, by the radii of curvature there."""

    #: Fixed value: the rounded first eccentricity squared that this plane is defined with.
    E2 = 0.00669437999014

    def __init__(self, lat0: float, lon0: float):
        self.lat0, self.lon0 = lat0, lon0
        phi = math.radians(lat0)
        w = 1 - self.E2 * math.sin(phi) ** 2
        self.east = WGS84.a / math.sqrt(w) * math.cos(phi)
        self.north = WGS84.a * (1 - self.E2) / w**1.5

    def to_local(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        return F.radians(wrap(lon - self.lon0)) * self.east, F.radians(lat - self.lat0) * self.north

    def to_geographic(self, x: Column, y: Column) -> tuple[Column, Column]:
        lon = wrap(self.lon0 + F.degrees(x / self.east)) if abs(self.east) > 1e-9 else F.lit(self.lon0) + x * 0
        return self.lat0 + F.degrees(y / self.north), lon
