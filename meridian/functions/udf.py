"""Arrow functions for what native expressions can't say: parsers, writers, hulls, simplification."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from meridian.sources import codecs

from . import batches, shapes


def _each(function: Callable, kind: pa.DataType, strict: bool) -> Callable[[pa.Array], pa.Array]:
    def run(column: pa.Array) -> pa.Array:
        out = []
        for v in column.to_pylist():
            try:
                out.append(None if v is None else function(v))
            except (ValueError, KeyError, TypeError):
                if strict:
                    raise
                out.append(None)
        return pa.array(out, kind)

    return run


def _udf(function: Callable, spark_type: str, kind: pa.DataType, strict: bool = True):
    run = _each(function, kind, strict)

    def call(column: pa.Array) -> pa.Array:
        return run(column)

    return F.arrow_udf(call, spark_type)


_LINE = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_LINE_SQL = "array<struct<x:double,y:double>>"


def st_geomfromtext(wkt: Column, strict: bool = True) -> Column:
    """WKT to WKB; malformed text raises, or gives null if not strict."""
    return _udf(lambda t: codecs.to_wkb(codecs.from_wkt(t)), "binary", pa.binary(), strict)(wkt)


def st_astext(wkb: Column, strict: bool = True) -> Column:
    return _udf(lambda b: codecs.to_wkt(codecs.from_wkb(b)), "string", pa.string(), strict)(wkb)


def st_geomfromgeojson(text: Column, strict: bool = True) -> Column:
    return _udf(lambda t: codecs.to_wkb(codecs.from_geojson(t)), "binary", pa.binary(), strict)(text)


def st_asgeojson(wkb: Column, strict: bool = True) -> Column:
    return _udf(lambda b: codecs.to_geojson(codecs.from_wkb(b)), "string", pa.string(), strict)(wkb)


def st_geometrytype(wkb: Column, strict: bool = True) -> Column:
    return _udf(lambda b: codecs.from_wkb(b)[0], "string", pa.string(), strict)(wkb)


def st_points(wkb: Column, strict: bool = True) -> Column:
    """All coordinates."""
    return _udf(lambda b: [{"x": x, "y": y} for x, y in codecs.positions(codecs.from_wkb(b))], _LINE_SQL, _LINE, strict)(wkb)


def _lines(xy: np.ndarray, row: np.ndarray, like: pa.Array) -> pa.Array:
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in (0, 1)], ["x", "y"])
    out = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(like) + 1)), pa.int32()), points)
    return pc.if_else(like.is_valid(), out, pa.scalar(None, out.type))


def st_convexhull(points: Column) -> Column:
    """The convex hull of a line's vertices as an open, counter-clockwise ring."""

    def call(lines: pa.Array) -> pa.Array:
        lines = batches.whole(lines)
        flat, row = batches.elements(lines, np.arange(len(lines)))
        return _lines(*shapes.convex_hulls(batches.coordinates(flat), row), lines)

    return F.arrow_udf(call, _LINE_SQL)(points)


def st_simplify(line: Column, tolerance: float) -> Column:
    """A line less the vertices within ``tolerance`` of what is left; both ends stay."""

    def call(lines: pa.Array) -> pa.Array:
        lines = batches.whole(lines)
        flat, row = batches.elements(lines, np.arange(len(lines)))
        xy = batches.coordinates(flat)
        keep = shapes.simplified(xy, row, tolerance)
        return _lines(xy[keep], row[keep], lines)

    return F.arrow_udf(call, _LINE_SQL)(line)


def _measured(b: bytes) -> dict:
    """Area, length and corners of a geometry of any kind; collections and multi-geometries sum up."""
    kind, c = codecs.from_wkb(b)
    at = codecs.positions((kind, c))
    members = c if kind == "GeometryCollection" else [(kind.removeprefix("Multi"), m) for m in c] if kind.startswith("Multi") else [(kind, c)]
    area = length = 0.0
    for name, m in members:
        if name in ("GeometryCollection",) or name.startswith("Multi"):
            inner = _measured(codecs.to_wkb((name, m)))
            area, length = area + inner["area"], length + inner["length"]
        elif name == "Polygon":
            sizes = [abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1], strict=True))) / 2 for r in m]
            area += sizes[0] - sum(sizes[1:]) if sizes else 0.0
        elif name == "LineString":
            length += sum(math.dist(p, q) for p, q in zip(m, m[1:], strict=False))
    box = {"xmin": min(p[0] for p in at), "ymin": min(p[1] for p in at), "xmax": max(p[0] for p in at), "ymax": max(p[1] for p in at)} if at else dict.fromkeys(("xmin", "ymin", "xmax", "ymax"))
    return {"area": area, "length": length, **box}


def st_measures(wkb: Column, strict: bool = True) -> Column:
    """Struct (area of polygons less holes, length of lines, xmin, ymin, xmax, ymax) of a geometry of any kind in the plane."""
    names = ("area", "length", "xmin", "ymin", "xmax", "ymax")
    return _udf(_measured, ", ".join(f"{n} double" for n in names), pa.struct([(n, pa.float64()) for n in names]), strict)(wkb)


def register_all(spark: SparkSession) -> None:
    """The codecs by name, for SQL."""
    for name, function, spark_type, kind in (
        ("st_geomfromtext", lambda t: codecs.to_wkb(codecs.from_wkt(t)), "binary", pa.binary()),
        ("st_astext", lambda b: codecs.to_wkt(codecs.from_wkb(b)), "string", pa.string()),
        ("st_geomfromgeojson", lambda t: codecs.to_wkb(codecs.from_geojson(t)), "binary", pa.binary()),
        ("st_asgeojson", lambda b: codecs.to_geojson(codecs.from_wkb(b)), "string", pa.string()),
    ):
        spark.udf.register(name, _udf(function, spark_type, kind))
