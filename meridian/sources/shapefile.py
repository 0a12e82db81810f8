"""Shapefiles: records of ``.shp`` and ``.dbf`` by byte ranges in parallel, joined by their number.

Z and M ordinates are dropped, the first ring of a polygon is its outer one and all others are holes.
Numbers are doubles, blank ones 0; deleted rows are left out.  A ``.dbf`` with more or fewer rows than
its ``.shp`` has records is an error; without a ``.dbf`` features have no properties.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codecs
from .files import listing, read_range, read_sibling, save_parts

#: Bytes of records that one piece of work reads.
PIECE = 32 << 20
# Shape codes, with the codes of their Z and M forms.
POINT, POLYLINE, POLYGON, MULTIPOINT = 1, 3, 5, 8
FLAT = {11: POINT, 21: POINT, 13: POLYLINE, 23: POLYLINE, 15: POLYGON, 25: POLYGON, 18: MULTIPOINT, 28: MULTIPOINT}
SHAPES = {"Point": POINT, "LineString": POLYLINE, "MultiLineString": POLYLINE, "Polygon": POLYGON, "MultiPolygon": POLYGON, "MultiPoint": MULTIPOINT}
# Names of code pages.
CODE_PAGES = {"UTF-8": "utf-8", "UTF8": "utf-8", "65001": "utf-8", "ISO-8859-1": "latin-1", "ISO8859-1": "latin-1", "LATIN1": "latin-1", "28591": "latin-1", "88591": "latin-1", "ISO-8859-15": "latin-1", "1252": "cp1252", "CP1252": "cp1252", "WINDOWS-1252": "cp1252", "ANSI 1252": "cp1252"}


def encoding_from_cpg(text: str) -> str | None:
    return CODE_PAGES.get(text.strip().upper())


def _decode(raw: bytes, encoding: str) -> str:
    if encoding != "cp1252":
        return raw.decode(encoding, "replace")
    return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw)


def geometry_of(content: bytes) -> codecs.Geometry | None:
    """A record's content without its header; None for a null shape."""
    code = struct.unpack_from("<i", content)[0]
    kind = FLAT.get(code, code)
    if kind == 0:
        return None
    if kind == POINT:
        return "Point", struct.unpack_from("<dd", content, 4)
    points = lambda at, n: [tuple(p) for p in np.frombuffer(content, "<f8", 2 * n, at).reshape(-1, 2).tolist()]
    if kind == MULTIPOINT:
        return "MultiPoint", tuple(points(40, struct.unpack_from("<i", content, 36)[0]))
    if kind not in (POLYLINE, POLYGON):
        raise ValueError(f"unknown shape code {code}")
    n_parts, n = struct.unpack_from("<ii", content, 36)
    starts = np.frombuffer(content, "<i4", n_parts, 44).tolist()
    flat = points(44 + 4 * n_parts, n)
    parts = tuple(tuple(flat[a:b]) for a, b in zip(starts, [*starts[1:], n], strict=True))
    if kind == POLYGON:
        return ("Polygon", parts) if parts else None
    return ("LineString", parts[0]) if n_parts == 1 else ("MultiLineString", parts)


def _shp_pieces(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(base, path, length) to runs of whole records (base, path, start, size, first record), by the index if there is one."""
    for batch in incoming:
        for base, path, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            index = read_sibling(base, [".shx", ".SHX"])
            at = np.frombuffer(index, ">i4", offset=100)[::2].astype(np.int64) * 2 if index and len(index) > 100 else np.array([100])
            new = np.flatnonzero(np.diff(at // PIECE, prepend=-1))
            ends = [*at[new[1:]].tolist(), length]
            yield pa.RecordBatch.from_arrays([pa.array([base] * len(new)), pa.array([path] * len(new)), pa.array(at[new]), pa.array(np.array(ends, np.int64) - at[new]), pa.array(new)], ["base", "path", "start", "size", "first"])


def _shp_records(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        for base, path, start, size, first in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            raw, at, out = read_range(path, start, size), 0, []
            while at + 12 <= len(raw):
                words = struct.unpack_from(">i", raw, at + 4)[0]
                if words < 2 or at + 8 + 2 * words > len(raw):
                    raise ValueError(f"{path}: a record is cut short")
                g = geometry_of(raw[at + 8 : at + 8 + 2 * words])
                out.append(None if g is None else codecs.to_wkb(g))
                at += 8 + 2 * words
            yield pa.RecordBatch.from_arrays([pa.array([base] * len(out), pa.string()), pa.array(range(first, first + len(out)), pa.int64()), pa.array(out, pa.binary())], ["base", "feature_id", "geom"])


def read_shp(spark: SparkSession, path: str) -> DataFrame:
    """(base, feature_id, geom) of every record, null shapes too."""
    pieces = listing(spark, path, ".shp").select("base", "path", "length").mapInArrow(_shp_pieces, "base string, path string, start long, size long, first long")
    return pieces.repartition(F.col("path"), F.col("start")).mapInArrow(_shp_records, "base string, feature_id long, geom binary")


def parse_value(kind: str, raw: bytes, encoding: str) -> object:
    text = _decode(raw, encoding).strip(" \0")
    if kind == "C":
        return text
    if kind in "NF":
        return float(text) if text else 0.0
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    if kind == "D":
        if text and not (len(text) == 8 and text.isdigit()):
            raise ValueError(f"malformed date {text!r}")
        return text or None
    raise ValueError(f"unknown field type {kind!r}")


def _header(path: str) -> tuple[int, int, int, list[tuple[str, str, int]]]:
    """(rows, header bytes, row bytes, fields: name, type, width)."""
    rows, head, width = struct.unpack_from("<IHH", read_range(path, 0, 32), 4)
    raw, fields = read_range(path, 32, head - 32), []
    for k in range(0, len(raw) - 31, 32):
        if raw[k] == 0x0D:
            break
        fields.append((raw[k : k + 11].split(b"\0")[0].decode("ascii", "replace"), chr(raw[k + 11]), raw[k + 16]))
    return rows, head, width, fields


def _dbf_pieces(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        for base, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, _, width, _ = _header(path)
            firsts = list(range(0, rows, max(PIECE // max(width, 1), 1)))
            yield pa.RecordBatch.from_arrays([pa.array([base] * len(firsts), pa.string()), pa.array([path] * len(firsts), pa.string()), pa.array(firsts, pa.int64())], ["base", "path", "first"])


def _dbf_rows(encoding: str | None, incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        for base, path, first in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            rows, head, width, fields = _header(path)
            page = encoding or encoding_from_cpg((read_sibling(base, [".cpg", ".CPG"]) or b"").decode("ascii", "replace")) or "utf-8"
            n = min(max(PIECE // max(width, 1), 1), rows - first)
            raw = read_range(path, head + first * width, n * width)
            if len(raw) < n * width:
                raise ValueError(f"{path} is cut short")
            props = []
            for k in range(n):
                at, row = k * width + 1, {}
                for name, kind, size in fields:
                    row[name] = parse_value(kind, raw[at : at + size], page)
                    at += size
                props.append(json.dumps(row, sort_keys=True))
            gone = [raw[k * width] == 0x2A for k in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([base] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(props, pa.string()), pa.array(gone, pa.bool_())], ["base", "feature_id", "props", "deleted"])


def read_dbf(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(base, feature_id, props: JSON, deleted); the encoding is that of the ``.cpg`` beside it, else UTF-8."""
    pieces = listing(spark, path, ".dbf").select("base", "path").mapInArrow(_dbf_pieces, "base string, path string, first long")
    return pieces.repartition(F.col("path"), F.col("first")).mapInArrow(lambda batches: _dbf_rows(encoding, batches), "base string, feature_id long, props string, deleted boolean")


def read_shapefile(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Features (path, feature_id, geom, props) of every shapefile under ``path``, a file or a folder."""
    stem = path[: -len(".shp")] if path.lower().endswith(".shp") else None
    shapes = read_shp(spark, path)
    tables = listing(spark, stem + ".*" if stem else path, ".dbf").select("base", F.lit(True).alias("has"))
    rows = read_dbf(spark, stem + ".*" if stem else path, encoding)
    both = shapes.withColumn("shape", F.lit(True)).join(rows, ["base", "feature_id"], "full").join(tables, "base", "left")
    odd = F.col("shape").isNull() | (F.col("deleted").isNull() & F.col("has").isNotNull())
    checked = both.withColumn("props", F.when(odd, F.raise_error(F.concat("base", F.lit(": records and rows differ")))).otherwise(F.coalesce("props", F.lit("{}"))))
    return checked.where(F.coalesce("deleted", F.lit(False)) == F.lit(False)).select(F.concat("base", F.lit(".shp")).alias("path"), "feature_id", "geom", "props")


def _field_kinds(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every property name: whether a value isn't logical, whole or a number, and the widest text."""
    for batch in incoming:
        found: dict[str, list] = {}
        for text in batch.column(0).to_pylist():
            for name, v in json.loads(text or "{}").items():
                f = found.setdefault(name, [False, False, False, 0, 0, 0])
                if v is not None:
                    logical, whole, number = isinstance(v, bool), isinstance(v, int) and not isinstance(v, bool), isinstance(v, (int, float)) and not isinstance(v, bool)
                    f[0] |= not logical
                    f[1] |= not whole
                    f[2] |= not number
                    f[3] = 1
                    f[4] = max(f[4], len(_text(v).encode()))
                    f[5] = max(f[5], len(f"{v:.8f}") if number else 0)
        names = ["name", "not_logical", "not_whole", "not_number", "any", "width", "decimal_width"]
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), *[pa.array([f[k] for f in found.values()], pa.bool_() if k < 3 else pa.int32()) for k in range(6)]], names)


def _text(v: object) -> str:
    return v if isinstance(v, str) else json.dumps(v, sort_keys=True)


def fields_of(features: DataFrame) -> list[tuple[str, str, int, int]]:
    """(name, type, width, decimals) for all property names, by name, from all rows."""
    kinds = features.select("props").mapInArrow(_field_kinds, "name string, not_logical boolean, not_whole boolean, not_number boolean, any int, width int, decimal_width int")
    rows = kinds.groupBy("name").agg(*[F.max(c).alias(c) for c in kinds.columns[1:]]).orderBy("name").collect()  # a row for each column of the file
    fields = []
    for r in rows:
        if len(r.name.encode()) > 10 or not r.name.isascii():
            raise ValueError(f"{r.name!r} isn't a name of at most ten ASCII letters")
        if not r.any:
            fields.append((r.name, "C", 1, 0))
        elif not r.not_logical:
            fields.append((r.name, "L", 1, 0))
        elif not r.not_whole:
            fields.append((r.name, "N", r.width, 0))
        elif not r.not_number:
            fields.append((r.name, "N", r.decimal_width, 8))
        else:
            fields.append((r.name, "C", max(r.width, 1), 0))
        if fields[-1][2] > (20 if fields[-1][1] == "N" else 254):
            raise ValueError(f"values of {r.name!r} are too wide")
    if len(fields) > 128:
        raise ValueError("more than 128 fields")
    return fields


def _turned(ring: tuple, left: bool) -> tuple:
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    return ring if not area or (area > 0) == left else ring[::-1]


def _record(g: codecs.Geometry | None) -> bytes:
    if g is None:
        return struct.pack("<i", 0)
    kind, c = g
    if kind == "Point":
        return struct.pack("<idd", POINT, *c)
    if kind == "MultiPoint":
        parts = [c]
    elif kind == "LineString":
        parts = [c]
    elif kind == "MultiLineString":
        parts = list(c)
    else:
        parts = [_turned(ring, k > 0) for rings in ([c] if kind == "Polygon" else c) for k, ring in enumerate(rings)]
    flat = np.array([p for part in parts for p in part], "<f8").reshape(-1, 2)
    box = np.concatenate([flat.min(0), flat.max(0)]).astype("<f8").tobytes() if len(flat) else bytes(32)
    if kind == "MultiPoint":
        return struct.pack("<i", MULTIPOINT) + box + struct.pack("<i", len(flat)) + flat.tobytes()
    starts = np.cumsum([0, *map(len, parts)])[:-1].astype("<i4").tobytes()
    return struct.pack("<i", SHAPES[kind]) + box + struct.pack("<ii", len(parts), len(flat)) + starts + flat.tobytes()


def _encode(shape: int, fields: list[tuple[str, str, int, int]], members: list[dict]) -> dict[str, bytes]:
    shapes = [None if m["geom"] is None else codecs.from_wkb(m["geom"]) for m in members]
    contents = [_record(g) for g in shapes]
    flat = np.array([p for g in shapes if g for p in codecs.positions(g)], float).reshape(-1, 2)
    box = struct.pack("<8d", *(flat.min(0).tolist() + flat.max(0).tolist() if len(flat) else [0.0] * 4), 0, 0, 0, 0)
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<ii", 1000, shape) + box
    shp, shx, at = [], [], 50
    for k, content in enumerate(contents):
        shp.append(struct.pack(">ii", k + 1, len(content) // 2) + content)
        shx.append(struct.pack(">ii", at, len(content) // 2))
        at += 4 + len(content) // 2
    width = 1 + sum(f[2] for f in fields)
    dbf = struct.pack("<4BIHH20x", 3, 95, 1, 1, len(members), 33 + 32 * len(fields), width)
    dbf += b"".join(struct.pack("<11sc4xBB14x", n.encode(), t.encode(), w, d) for n, t, w, d in fields) + b"\r"
    rows = []
    for m in members:
        props, row = json.loads(m["props"] or "{}"), [b" "]
        for name, kind, size, decimals in fields:
            v = props.get(name)
            if kind == "C":
                row.append((b"" if v is None else _text(v).encode()).ljust(size))
            elif kind == "L":
                row.append(b"?" if v is None else b"T" if v else b"F")
            else:
                row.append((b"" if v is None else f"{v:.{decimals}f}".encode() if decimals else str(v).encode()).rjust(size))
        rows.append(b"".join(row))
    return {".shp": head(at * 2) + b"".join(shp), ".shx": head(100 + 8 * len(shx)) + b"".join(shx), ".dbf": dbf + b"".join(rows) + b"\x1a", ".cpg": b"UTF-8"}


def shape_code(features: DataFrame) -> int:
    """The shape code that all features share, 0 if none has a geometry."""
    from meridian.functions.udf import st_geometrytype

    kinds = [k for (k,) in features.where("geom is not null").select(st_geometrytype(F.col("geom"))).distinct().collect()]
    codes = {SHAPES.get(k) for k in kinds}
    if None in codes or len(codes) > 1:
        raise ValueError(f"a shapefile can't hold {sorted(kinds)} together")
    return codes.pop() if codes else 0


def write_shapefile(features: DataFrame, folder: str) -> DataFrame:
    """A shapefile for each partition of ``features`` (geom, props), all of one shape and with the same fields; see :func:`.files.save_parts`."""
    shape, fields = shape_code(features), fields_of(features)
    return save_parts(features.select("geom", "props"), folder, lambda members: _encode(shape, fields, members))
