"""Hierarchical cell ids on the faces of a cube, as native 64-bit arithmetic.

A face is split into 2**level x 2**level cells; an id holds the face, the interleaved cell position
(Morton order) and a marker bit that tells the level.  Ids are unsigned 64-bit numbers held in a
signed long, so faces 4 and 5 are negative; :func:`order_key` sorts as unsigned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import bind

MAX_LEVEL = 30
# Masks that spread the lower 32 bits of a number to even places.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def spread(v: Column) -> Column:
    for shift, mask in _SPREAD:
        v = bind(v, lambda x: x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(_long(mask)))  # noqa: B023  used at once
    return v


def gather(v: Column) -> Column:
    v = v.bitwiseAND(_long(_SPREAD[-1][1]))
    for (shift, _), (_, mask) in zip(reversed(_SPREAD), [*reversed(_SPREAD[:-1]), (0, 0x00000000FFFFFFFF)], strict=True):
        v = bind(v, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(_long(mask)))  # noqa: B023  used at once
    return v


def _st(u: Column) -> Column:
    return F.when(u >= 0, 0.5 * F.sqrt(1 + 3 * F.greatest(u, F.lit(0.0)))).otherwise(1 - 0.5 * F.sqrt(1 - 3 * F.least(u, F.lit(0.0))))


def _uv(s: Column) -> Column:
    return F.when(s >= 0.5, (4 * s * s - 1) / 3).otherwise((1 - 4 * (1 - s) * (1 - s)) / 3)


def face_uv(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """(face, u, v) of degrees."""
    phi, lam = F.radians(lat), F.radians(lon)
    return _face_uv(F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))


def _face_uv(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    along_x, along_y = (ax >= ay) & (ax >= az), ay >= az
    face = F.when(along_x, F.when(x >= 0, 0).otherwise(3)).when(along_y, F.when(y >= 0, 1).otherwise(4)).otherwise(F.when(z >= 0, 2).otherwise(5))
    pick = lambda cases: F.coalesce(*[F.when(face == i, F.try_divide(*c)) for i, c in enumerate(cases)])
    u = pick([(y, x), (-x, y), (-x, z)] * 2)
    v = pick([(z, x), (z, y), (-y, z)] * 2)
    return face, u, v


def from_face_ij(face: Column, i: Column, j: Column, level: int) -> Column:
    position = spread(i.cast("long")).bitwiseOR(F.shiftleft(spread(j.cast("long")), 1))
    lowest = 2 * (MAX_LEVEL - level)
    return F.shiftleft(face.cast("long"), 61).bitwiseOR(F.shiftleft(position, lowest + 1)).bitwiseOR(_long(1 << lowest))


def cell_at(lat: Column, lon: Column, level: int = MAX_LEVEL) -> Column:
    """The id of the cell that holds a position; null if it isn't finite or lies past 90 or 180 degrees.

    u and v of opposite faces are the same quotients, so faces 3, 4 and 5 aren't turned as in other cell schemes.
    """
    if not 0 <= level <= MAX_LEVEL:
        raise ValueError("levels run from 0 to 30")
    size = 1 << MAX_LEVEL

    def index(w: Column) -> Column:
        return F.shiftright(F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor(_st(w) * float(size)))).cast("long"), MAX_LEVEL - level)

    finite = ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    phi, lam = F.radians(lat), F.radians(lon)
    xyz = F.struct((F.cos(phi) * F.cos(lam)).alias("x"), (F.cos(phi) * F.sin(lam)).alias("y"), F.sin(phi).alias("z"))
    fuv = bind(xyz, lambda p: F.struct(*[c.alias(n) for c, n in zip(_face_uv(p["x"], p["y"], p["z"]), "fuv", strict=True)]))
    return F.when(finite, bind(fuv, lambda q: from_face_ij(q["f"], index(q["u"]), index(q["v"]), level)))


def marker(cell: Column) -> Column:
    """The lowest set bit; the bottom id is left alone, as it has no negation."""
    flipped = F.bitwise_not(cell)
    return F.when(flipped == _long(9223372036854775807), F.lit(None)).otherwise(cell.bitwiseAND(flipped + 1))


def level(cell: Column) -> Column:
    return (MAX_LEVEL - F.floor(F.log2(marker(cell).cast("double")) / 2)).cast("int")


def face(cell: Column) -> Column:
    return F.shiftrightunsigned(cell, 61).cast("int")


def parent(cell: Column, to: int) -> Column:
    """The ancestor at level ``to``, which mustn't be deeper than the cell."""
    bit = 1 << (2 * (MAX_LEVEL - to))
    keep = ~((bit << 1) - 1) & 0xFFFFFFFFFFFFFFFF
    return cell.bitwiseAND(_long(keep - (1 << 64) if keep >> 63 else keep)).bitwiseOR(_long(bit))


def children(cell: Column) -> Column:
    """The four children in (i, j) order."""
    m = marker(cell)
    low = F.shiftrightunsigned(m, 2)
    base = cell.bitwiseXOR(m)
    return F.array(*[base.bitwiseOR(F.shiftleft(low, 1) * k).bitwiseOR(low) for k in range(4)])


def ij(cell: Column, at_level: Column) -> tuple[Column, Column]:
    position = F.call_function("shiftrightunsigned", cell.bitwiseAND(_long((1 << 61) - 1)), (2 * (MAX_LEVEL - at_level) + 1).cast("int"))
    return gather(position), gather(F.shiftrightunsigned(position, 1))


def with_center(df: DataFrame, cell: str = "cell") -> DataFrame:
    """Adds ``lat`` and ``lon`` of the cells' centres in degrees.  Steps are columns: one expression would be too long to compile."""
    c = F.col(cell)
    out = df.withColumn("_level", level(c))
    i, j = ij(c, F.col("_level"))
    out = out.withColumns({"_i": i, "_j": j, "_f": face(c)})
    side = F.pow(F.lit(2.0), F.col("_level"))
    out = out.withColumns({"_u": _uv((F.col("_i") + 0.5) / side), "_v": _uv((F.col("_j") + 0.5) / side)})
    out = out.withColumns(dict(zip(("_x", "_y", "_z"), _axes(F.col("_f"), F.col("_u"), F.col("_v")), strict=True)))
    x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
    out = out.withColumns({"lat": F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), "lon": F.degrees(F.atan2(y, x))})
    return out.drop("_level", "_i", "_j", "_f", "_u", "_v", "_x", "_y", "_z")


def token(cell: Column) -> Column:
    """Sixteen lower-case hexadecimal digits, zeros kept."""
    return F.lower(F.lpad(F.hex(cell), 16, "0"))


def from_token(text: Column) -> Column:
    """The id, null unless the text is a token of a valid cell."""
    high, low = F.conv(F.substring(text, 1, 8), 16, 10).cast("long"), F.conv(F.substring(text, 9, 8), 16, 10).cast("long")
    cell = F.when(text.rlike(r"\A[0-9a-fA-F]{16}\z"), F.shiftleft(high, 32).bitwiseOR(low))
    return F.when(is_valid(cell), cell)


def is_valid(cell: Column) -> Column:
    m = marker(cell)
    even = m.bitwiseAND(_long(0x1555555555555555)) != 0
    return F.coalesce((face(cell) < 6) & even, F.lit(False))


def order_key(cell: Column) -> Column:
    """Sorts as the unsigned id."""
    return cell.bitwiseXOR(_long(-(1 << 63)))


def quadkey(x: Column, y: Column, bounds: tuple[float, float, float, float], depth: int) -> Column:
    """The path of quadrants (0 to 3, y before x) that holds a point of a fixed universe; null outside."""
    x0, y0, x1, y1 = bounds
    n = 1 << depth

    def index(v: Column, lo: float, hi: float) -> Column:
        return F.least(F.floor((v - lo) / (hi - lo) * n), F.lit(n - 1)).cast("long")

    code = spread(index(x, x0, x1)).bitwiseOR(F.shiftleft(spread(index(y, y0, y1)), 1))
    digits = F.transform(F.sequence(F.lit(depth - 1), F.lit(0), F.lit(-1)), lambda d: F.call_function("shiftright", code, (2 * d).cast("int")).bitwiseAND(_long(3)).cast("string"))
    return F.when((x >= x0) & (x <= x1) & (y >= y0) & (y <= y1), F.array_join(digits, ""))


def neighbour(cell: Column, di: Column | int, dj: Column | int) -> Column:
    """The cell of the same level whose centre is ``di`` and ``dj`` cells away, across edges of the cube too; at its corners steps aren't each other's inverses."""

    def placed(c: Column) -> Column:
        return bind(F.struct(level(c).alias("l"), face(c).alias("f"), c.alias("c")), located)

    def located(q: Column) -> Column:
        i, j = ij(q["c"], q["l"])
        side = F.pow(F.lit(2.0), q["l"])
        return bind(F.struct(q["l"].alias("l"), q["f"].alias("f"), _uv((i + (0.5 + di)) / side).alias("u"), _uv((j + (0.5 + dj)) / side).alias("v")), turned)

    def turned(q: Column) -> Column:
        axes = _axes(q["f"], q["u"], q["v"])
        back = lambda p: F.struct(*[c.alias(n) for c, n in zip(_face_uv(p["x"], p["y"], p["z"]), "fuv", strict=True)])
        landed = lambda p: F.struct(back(p).alias("at"), q["l"].alias("l"))
        return bind(bind(F.struct(*[a.alias(n) for a, n in zip(axes, "xyz", strict=True)]), landed), named_id)

    def named_id(q: Column) -> Column:
        index = lambda w: F.greatest(F.lit(0), F.least(F.lit((1 << MAX_LEVEL) - 1), F.floor(_st(w) * float(1 << MAX_LEVEL)))).cast("long")
        drop = F.lit(MAX_LEVEL) - q["l"]
        i, j = (F.call_function("shiftright", index(q["at"][k]), drop) for k in "uv")
        lowest = 2 * drop
        position = F.call_function("shiftleft", spread(i).bitwiseOR(F.shiftleft(spread(j), 1)), lowest + 1)
        return F.shiftleft(q["at"]["f"].cast("long"), 61).bitwiseOR(position).bitwiseOR(F.call_function("shiftleft", _long(1), lowest))

    return bind(cell, placed)


def _axes(f: Column, u: Column, v: Column) -> list[Column]:
    """The direction (x, y, z) of a place on a face."""
    one = F.lit(1.0)
    xyz = [(one, u, v), (-u, one, v), (-u, -v, one), (-one, -u, -v), (u, -one, -v), (u, v, -one)]
    return [F.coalesce(*[F.when(f == n, p[k]) for n, p in enumerate(xyz)]) for k in range(3)]


#: No cell of a level reaches farther from its centre than this over 2**level, in radians.
REACH = 1.3
#: Cells of one polygon that are looked at together.
CELLS_AT_ONCE = 200_000


def _centres(face: np.ndarray, i: np.ndarray, j: np.ndarray, at_level: int) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude of cells' centres in degrees."""
    back = lambda s: np.where(s >= 0.5, 4 * s * s - 1, 1 - 4 * (1 - s) * (1 - s)) / 3
    u, v = back((i + 0.5) / (1 << at_level)), back((j + 0.5) / (1 << at_level))
    one = np.ones_like(u)
    x, y, z = (np.choose(face, c) for c in ([one, -u, -u, -one, u, u], [u, one, -v, -u, -one, v], [v, v, one, -v, -v, -one]))
    return np.degrees(np.arctan2(z, np.hypot(x, y))), np.degrees(np.arctan2(y, x))


def _ids(face: np.ndarray, i: np.ndarray, j: np.ndarray, at_level: int) -> np.ndarray:
    def spread_bits(v: np.ndarray) -> np.ndarray:
        v = v.astype(np.uint64)
        for shift, mask in _SPREAD:
            v = (v | v << np.uint64(shift)) & np.uint64(mask)
        return v

    lowest = 2 * (MAX_LEVEL - at_level)
    position = spread_bits(i) | spread_bits(j) << np.uint64(1)
    return (face.astype(np.uint64) << np.uint64(61) | position << np.uint64(lowest + 1) | np.uint64(1 << lowest)).view(np.int64)


def _walk(rings: list[np.ndarray], to_level: int) -> Iterator[np.ndarray]:
    """Ids of the cells whose centres lie in the first ring and in no other (of x, y), some at a time."""
    (x0, y0), (x1, y1) = rings[0].min(axis=0), rings[0].max(axis=0)
    stack = [(0, np.arange(6), np.zeros(6, np.int64), np.zeros(6, np.int64))]
    while stack:
        n, face, i, j = stack.pop()
        lat, lon = _centres(face, i, j, n)
        if n == to_level:
            odd = [_odd(lon, lat, r) for r in rings]
            inside = odd[0] & ~np.logical_or.reduce([np.zeros(len(lat), bool), *odd[1:]])
            if inside.any():
                yield _ids(face[inside], i[inside], j[inside], n)
            continue
        r = REACH / 2**n
        room = np.cos(np.radians(lat))
        wide = np.where(np.abs(np.radians(lat)) + r >= np.pi / 2, 360.0, np.degrees(np.arcsin(np.minimum(1.0, math.sin(min(r, math.pi / 2)) / np.maximum(room, 1e-300)))))
        near = (lat - math.degrees(r) <= y1) & (lat + math.degrees(r) >= y0)
        near &= np.logical_or.reduce([(lon + d - wide <= x1) & (lon + d + wide >= x0) for d in (-360.0, 0.0, 360.0)])
        face, i, j = face[near], i[near], j[near]
        for at in range(0, len(face), CELLS_AT_ONCE // 4):  # deepest first: what waits stays small
            f, p, q = (v[at : at + CELLS_AT_ONCE // 4] for v in (face, i, j))
            step = np.arange(4)
            stack.append((n + 1, np.repeat(f, 4), (2 * p[:, None] + (step & 1)).ravel(), (2 * q[:, None] + (step >> 1)).ravel()))


def _odd(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether an odd number of edges lies to the right of each point (half-open), a block of edges at a time."""
    count = np.zeros(len(x), np.int64)
    if len(ring) < 3:
        return count > 0
    a, b = ring, np.roll(ring, -1, axis=0)
    block = max(1, 4_000_000 // max(1, len(x)))
    for at in range(0, len(ring), block):
        (x1, y1), (x2, y2) = (v[at : at + block].T[:, None, :] for v in (a, b))
        across = (y1 > y[:, None]) != (y2 > y[:, None])
        rise = np.where(y1 == y2, 1.0, y1 - y2)
        count += (across & (x[:, None] < (x1 - x2) * (y[:, None] - y2) / rise + x2)).sum(axis=1)
    return count % 2 == 1


def cover(polygons: DataFrame, to_level: int, polygon_id: str = "zone_id") -> DataFrame:
    """(id, ``cell``) for the cells of a level whose centres lie in a polygon (id, ``polygon`` of x: longitude, y: latitude), a row for each.

    The tree of cells is walked down from the six faces: children of what is left, less those that can't reach the polygon's
    box, in blocks, so that memory is bounded whatever the cells of a polygon.  Polygons with a coordinate that isn't finite or
    out of range have no cells.  Edges are straight in degrees, so none crosses the antimeridian.  Ids with several
    polygons have the cells of each.
    """
    if not 0 <= to_level <= MAX_LEVEL:
        raise ValueError("levels run from 0 to 30")

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for row in range(batch.num_rows):
                shape = batch.column(1)[row].as_py() or []
                rings = [np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2) for r in shape if r is not None]
                if not rings or len(rings[0]) < 3 or not all((np.abs(r[:, 0]) <= 180).all() and (np.abs(r[:, 1]) <= 90).all() for r in rings):
                    continue
                for ids in _walk(rings, to_level):
                    again = pa.array(np.full(len(ids), row), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(again), pa.array(ids)], [polygon_id, "cell"])

    return polygons.select(polygon_id, "polygon").mapInArrow(run, f"{polygon_id} {dict(polygons.dtypes)[polygon_id]}, cell long")
