"""Coordinate reference systems by EPSG code, and transforms between them through WGS84."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridian.functions.binding import bind, named

from . import ellipsoid, projections

KNOWN = (4326, 3857, 2154, 5070, 4277, 27700)


def is_known(epsg: int) -> bool:
    return epsg in KNOWN or 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760


def lookup(epsg: Column) -> Column:
    """The name of a code's system, null if it isn't known."""
    zone = epsg % 100
    utm = ((epsg >= 32601) & (epsg <= 32660)) | ((epsg >= 32701) & (epsg <= 32760))
    names = {4326: "WGS 84", 3857: "Web Mercator", 2154: "Lambert-93", 5070: "Conus Albers", 4277: "OSGB36", 27700: "British National Grid"}
    found = F.when(utm, F.concat(F.lit("UTM "), zone.cast("string"), F.when(epsg < 32700, "N").otherwise("S")))
    for code, name in names.items():
        found = found.when(epsg == code, name)
    return found


def parse_crs(text: str) -> int:
    """``web-mercator``, ``epsg:n``, ``utm-<n>n`` or ``utm-<n>s``, in any case."""
    t = text.strip().lower()
    if t == "web-mercator":
        return 3857
    if m := re.fullmatch(r"epsg:(\d+)", t):
        if is_known(code := int(m[1])):
            return code
    if m := re.fullmatch(r"utm-(\d+)([ns])", t):
        if 1 <= int(m[1]) <= 60:
            return (32600 if m[2] == "n" else 32700) + int(m[1])
    raise ValueError(f"unknown coordinate system {text!r}")


def _projection(epsg: int):
    if epsg == 3857:
        return projections.WebMercator()
    if epsg == 2154:
        return projections.lambert93()
    if epsg == 5070:
        return projections.conus_albers()
    if epsg == 27700:
        return projections.british_national_grid()
    if is_known(epsg) and epsg > 32600:
        return projections.utm(epsg % 100, epsg < 32700)
    raise ValueError(f"unknown EPSG code {epsg}")


def from_geographic(epsg: int, lat: Column, lon: Column) -> tuple[Column, Column]:
    """WGS84 degrees to (x, y); of a geographic system x is the longitude."""
    if epsg == 4326:
        return lon, lat
    if epsg in (4277, 27700):
        lat, lon = ellipsoid.wgs84_to_osgb36(lat, lon)
        if epsg == 4277:
            return lon, lat
    there = bind(named(lat=lat, lon=lon), lambda p: named(**dict(zip("xy", _projection(epsg).forward(p["lat"], p["lon"]), strict=True))))
    return there["x"], there["y"]


def to_geographic(epsg: int, x: Column, y: Column) -> tuple[Column, Column]:
    """(x, y) to WGS84 (lat, lon)."""
    if epsg == 4326:
        return y, x
    if epsg == 4277:
        return ellipsoid.osgb36_to_wgs84(y, x)
    there = bind(named(x=x, y=y), lambda p: named(**dict(zip(("lat", "lon"), _projection(epsg).inverse(p["x"], p["y"]), strict=True))))
    lat, lon = there["lat"], there["lon"]
    return ellipsoid.osgb36_to_wgs84(lat, lon) if epsg == 27700 else (lat, lon)


def transform(source: int, target: int, x: Column, y: Column) -> tuple[Column, Column]:
    """Always through WGS84, also between equal systems."""
    lat, lon = to_geographic(source, x, y)
    return from_geographic(target, lat, lon)


def reproject(geometry: Column, source: int, target: int, depth: int) -> Column:
    """A nested array of points, ``depth`` levels deep (0: one point), with every coordinate transformed."""
    if depth:
        return F.transform(geometry, lambda g: reproject(g, source, target, depth - 1))
    x, y = transform(source, target, geometry["x"], geometry["y"])
    return F.struct(x.alias("x"), y.alias("y"))
