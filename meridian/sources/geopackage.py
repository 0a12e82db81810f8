"""GeoPackages by the standard library's SQLite, in memory: a task for each file, a file for each partition."""

from __future__ import annotations

import base64
import json
import math
import sqlite3
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codecs
from .files import save_parts
from .vector import FEATURES

#: Rows of a table that are handed on together.
ROWS = 1000
# The tables every GeoPackage has, its application id and version.
APPLICATION, VERSION = 0x47504B47, 10300
SCHEMA = """CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER NOT NULL PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT '1970-01-01T00:00:00.000Z', min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, CONSTRAINT pk_geom_cols PRIMARY KEY (table_name, column_name));"""


def encode_blob(geometry: codecs.Geometry, srs_id: int) -> bytes:
    """Header without an envelope, then the geometry."""
    return b"GP" + struct.pack("<BBi", 0, 1, srs_id) + codecs.to_wkb(geometry)


def decode_blob(blob: bytes) -> tuple[codecs.Geometry, int] | None:
    """(geometry, srs id); None for an empty geometry."""
    if len(blob) < 8 or blob[:2] != b"GP" or blob[2] != 0:
        raise ValueError("not a geometry blob")
    flags = blob[3]
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}.get(flags >> 1 & 7)
    if envelope is None or flags & 0x20:
        raise ValueError("unknown envelope or an extended geometry")
    if flags & 0x10:
        return None
    return codecs.from_wkb(blob[8 + envelope :]), struct.unpack_from("<i" if flags & 1 else ">i", blob, 4)[0]


def cell_to_json(v: object) -> object:
    """Bytes as base 64, a number that isn't finite as 0."""
    if isinstance(v, bytes):
        return base64.b64encode(v).decode()
    return 0.0 if isinstance(v, float) and not math.isfinite(v) else v


def json_to_cell(v: object) -> object:
    return int(v) if isinstance(v, bool) else json.dumps(v, sort_keys=True) if isinstance(v, (dict, list)) else v


def _name(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def _rows(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    n = 0
    for table, column in con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall():
        info = con.execute(f"PRAGMA table_info({_name(table)})").fetchall()
        # a single integer key is the row's id and no property
        key = {i[1] for i in info if i[5] and i[2].upper() == "INTEGER" and sum(bool(j[5]) for j in info) == 1}
        cursor = con.execute(f"SELECT * FROM {_name(table)}")
        names = [d[0] for d in cursor.description]
        while rows := cursor.fetchmany(ROWS):
            shapes = [r[names.index(column)] for r in rows]
            shapes = [None if s is None else decode_blob(s) for s in shapes]
            props = [json.dumps({k: cell_to_json(v) for k, v in zip(names, r, strict=True) if k != column and k not in key}, sort_keys=True) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(range(n, n + len(rows)), pa.int64()), pa.array([None if s is None else codecs.to_wkb(s[0]) for s in shapes], pa.binary()), pa.array(props)], ["path", "feature_id", "geom", "props"])
            n += len(rows)


def read_gpkg(spark: SparkSession, path: str) -> DataFrame:
    """Features of every table with geometries, of every file under ``path``."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".gpkg")).select("path", "content")

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for k in range(batch.num_rows):
                yield from _rows(batch.column(0)[k].as_py(), batch.column(1)[k].as_py())

    return files.mapInArrow(run, FEATURES)


def _encode(table: str, srs_id: int, members: list[dict]) -> dict[str, bytes]:
    shapes = [None if m["geom"] is None else codecs.from_wkb(m["geom"]) for m in members]
    props = [json.loads(m["props"] or "{}") for m in members]
    kinds: dict[str, str] = {}
    for name in sorted({k for p in props for k in p}):
        first = next((p[name] for p in props if p.get(name) is not None), "")
        kinds[name] = "INTEGER" if isinstance(first, int) else "REAL" if isinstance(first, float) else "TEXT"
    if {k.lower() for k in kinds} & {"fid", "geom"}:
        raise ValueError("properties can't be named fid or geom")
    con = sqlite3.connect(":memory:")
    con.executescript(SCHEMA)
    con.execute(f"PRAGMA application_id = {APPLICATION}")
    con.execute(f"PRAGMA user_version = {VERSION}")
    systems = [("Undefined cartesian", -1, "NONE", -1, "undefined", None), ("Undefined geographic", 0, "NONE", 0, "undefined", None), ("WGS 84", 4326, "EPSG", 4326, "undefined", None)]
    if srs_id not in (-1, 0, 4326):
        systems.append((f"EPSG:{srs_id}", srs_id, "EPSG", srs_id, "undefined", None))
    con.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, ?)", systems)
    columns = "".join(f", {_name(k)} {t}" for k, t in kinds.items())
    con.execute(f"CREATE TABLE {_name(table)} (fid INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, geom BLOB{columns})")
    rows = ((None if g is None else encode_blob(g, srs_id), *[json_to_cell(p.get(k)) for k in kinds]) for g, p in zip(shapes, props, strict=True))
    con.executemany(f"INSERT INTO {_name(table)} (geom{''.join(', ' + _name(k) for k in kinds)}) VALUES (?{', ?' * len(kinds)})", rows)
    xy = [p for g in shapes if g for p in codecs.positions(g)]
    box = [f(p[i] for p in xy) if xy else None for f in (min, max) for i in (0, 1)]
    found = {g[0].upper() for g in shapes if g}
    con.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", (table, table, *box, srs_id))
    con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (table, found.pop() if len(found) == 1 else "GEOMETRY", srs_id))
    con.commit()
    return {".gpkg": con.serialize()}


def write_gpkg(features: DataFrame, folder: str, table: str = "features", srs_id: int = 4326) -> DataFrame:
    """A GeoPackage for each partition of ``features`` (geom, props); see :func:`.files.save_parts`.  Without a spatial index."""
    return save_parts(features.select("geom", "props"), folder, lambda members: _encode(table, srs_id, members))
