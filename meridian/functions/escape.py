"""Geofence checks of positions on the ellipsoid: is a zone breached, and which way leads out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from meridian.crs.ellipsoid import WGS84

from . import batches, geodesic
from .binding import named


def _turn(degrees: np.ndarray) -> np.ndarray:
    return np.remainder(degrees + 180.0, 360.0) - 180.0


def _ways_out(lat: np.ndarray, lon: np.ndarray, owner: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each position lies in its ring (vertices of x: longitude, y: latitude, one ring after another), and the latitude and longitude of the ring's nearest point."""
    n = np.bincount(owner, minlength=len(lat))
    w = 1 - WGS84.e2 * np.sin(np.radians(lat)) ** 2
    east, north = WGS84.a / np.sqrt(w) * np.cos(np.radians(lat)), WGS84.a * (1 - WGS84.e2) / (w * np.sqrt(w))
    x = np.radians(_turn(ring[:, 0] - lon[owner])) * east[owner]
    y = np.radians(ring[:, 1] - lat[owner]) * north[owner]
    first = np.cumsum(n) - n
    following = np.arange(len(x)) + 1
    following[(first + n - 1)[n > 0]] = first[n > 0]
    x2, y2 = x[following], y[following]
    across = (y > 0) != (y2 > 0)
    rise = np.where(y == y2, 1.0, y - y2)
    right = across & (0 < (x - x2) * (0 - y2) / rise + x2)
    inside = (np.bincount(owner, right, len(lat)) % 2 == 1) & (n >= 3)
    dx, dy = x2 - x, y2 - y
    square = dx * dx + dy * dy
    t = np.clip(-(x * dx + y * dy) / np.where(square > 0, square, 1.0), 0.0, 1.0)
    nx, ny = x + t * dx, y + t * dy
    order = np.lexsort((np.arange(len(x)), nx * nx + ny * ny, owner))  # the first edge wins ties
    best = order[first[n > 0]]
    to_lat, to_lon = np.full(len(lat), np.nan), np.full(len(lat), np.nan)
    some = owner[best]
    to_lat[some] = lat[some] + np.degrees(ny[best] / north[some])
    to_lon[some] = _turn(lon[some] + np.degrees(nx[best] / east[some]))
    return inside, to_lat, to_lon


def check_position(lat: Column, lon: Column, ring: Column) -> Column:
    """Struct (breached, bearing in degrees, distance in metres) of a position against a ring of (x: longitude, y: latitude).

    The ring is taken to the plane that touches the ellipsoid at the position; bearing and distance
    are those of the geodesic to the nearest point of the ring there, null outside the zone.  A position that is null or not
    finite, a null ring and one with a vertex that isn't finite give null for breached.
    """

    def call(rows: pa.Array) -> pa.Array:
        rows = batches.whole(rows)
        at, known = batches.numbers(pc.struct_field(rows, [0])), batches.numbers(pc.struct_field(rows, [1]))
        rings = pc.struct_field(rows, [2])
        points, owner = batches.elements(rings, np.arange(len(rows)))
        xy = batches.coordinates(points)
        good = np.isfinite(at) & np.isfinite(known) & rings.is_valid().to_numpy(zero_copy_only=False)
        good[owner[~np.isfinite(xy).all(axis=1)]] = False
        use = good[owner]
        row = np.cumsum(good) - 1
        inside, to_lat, to_lon = _ways_out(at[good], known[good], row[owner[use]], xy[use])
        breached = np.zeros(len(rows), bool)
        breached[good] = inside
        way = geodesic.solver(WGS84).inverse(at[good][inside], known[good][inside], to_lat[inside], to_lon[inside])
        out = {"bearing": np.zeros(len(rows)), "distance": np.zeros(len(rows))}
        out["bearing"][breached], out["distance"][breached] = way["initial"], way["distance"]
        columns = [pa.array(breached, mask=~good), *[pa.array(v, mask=~breached) for v in out.values()]]
        return pa.StructArray.from_arrays(columns, ["breached", *out])

    return F.arrow_udf(call, "breached boolean, bearing double, distance double")(named(lat=lat, lon=lon, ring=ring))
