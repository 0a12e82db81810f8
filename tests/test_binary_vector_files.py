"""Shapefiles and GeoPackages: bytes made by hand, round trips, and errors."""

import json
import sqlite3
import struct

import pytest

from meridian.sources import codecs, geopackage, shapefile, vector

SHAPES = {
    "points": ["POINT (1 2)", None, "POINT (-3.5 4)"],
    "lines": ["LINESTRING (0 0, 1 1, 2 0)", "MULTILINESTRING ((0 0, 1 1), (5 5, 6 6, 7 5))"],
    "polygons": ["POLYGON ((0 0, 0 9, 9 9, 9 0, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))", "POLYGON ((20 20, 20 21, 21 21, 20 20))"],
    "multipoints": ["MULTIPOINT ((1 1), (2 2), (3 3))"],
}


def made(spark, texts, props=None):
    rows = [(None if t is None else bytearray(codecs.to_wkb(codecs.from_wkt(t))), json.dumps(props[k] if props else {"n": k, "name": f"é{k}"})) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "geom binary, props string").coalesce(1)


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("fmt", ["shp", "gpkg"])
def test_round_trip(spark, tmp_path, name, fmt):
    vector.write(made(spark, SHAPES[name]), str(tmp_path), fmt)
    back = vector.read(spark, str(tmp_path), fmt).orderBy("feature_id").collect()
    assert [None if r.geom is None else codecs.to_wkt(codecs.from_wkb(bytes(r.geom))) for r in back] == [None if t is None else codecs.to_wkt(codecs.from_wkt(t)) for t in SHAPES[name]]
    assert [json.loads(r.props) for r in back] == [{"n": k, "name": f"é{k}"} for k in range(len(back))]


def test_one_file_of_a_folder_and_pieces(spark, tmp_path, monkeypatch):
    texts = [f"LINESTRING (0 0, {k} 1)" for k in range(50)]
    vector.write(made(spark, texts), str(tmp_path), "shp")
    one = next(tmp_path.glob("*.shp"))
    rows = shapefile._shp_pieces(iter([__import__("pyarrow").RecordBatch.from_pylist([{"base": str(one)[:-4], "path": str(one), "length": one.stat().st_size}])]))
    monkeypatch.setattr(shapefile, "PIECE", 300)
    pieces = [p for b in rows for p in b.to_pylist()]
    assert len(pieces) > 5 and sum(p["size"] for p in pieces) == one.stat().st_size - 100
    records = [r for b in shapefile._shp_records(iter([__import__("pyarrow").RecordBatch.from_pylist(pieces)])) for r in b.to_pylist()]
    assert [codecs.from_wkb(r["geom"])[1][1][0] for r in records] == list(range(50)) and [r["feature_id"] for r in records] == list(range(50))
    next(tmp_path.glob("*.shx")).unlink()
    assert vector.read(spark, str(one)).count() == 50


def test_records_with_z_deleted_rows_and_code_pages(spark, tmp_path):
    box = bytes(32)
    line_z = struct.pack("<i", 13) + box + struct.pack("<iii", 1, 2, 0) + struct.pack("<4d", 1, 2, 3, 4) + struct.pack("<4d", 0, 9, 7, 8)
    contents = [line_z, struct.pack("<i", 0), line_z]
    (tmp_path / "a.shp").write_bytes(bytes(100) + b"".join(struct.pack(">ii", k + 1, len(c) // 2) + c for k, c in enumerate(contents)))
    fields = [(b"T", b"C", 6), (b"N", b"N", 5), (b"L", b"L", 1), (b"D", b"D", 8)]
    width = 1 + sum(f[2] for f in fields)
    head = struct.pack("<4BIHH20x", 3, 95, 1, 1, 3, 33 + 32 * len(fields), width) + b"".join(struct.pack("<11sc4xBB14x", n, t, w, 0) for n, t, w in fields) + b"\r"
    row = lambda flag, *values: flag + b"".join(v.ljust(w) for v, (_, _, w) in zip(values, fields, strict=True))
    rows = row(b" ", b"\x80uro", b" 12.5", b"Y", b"20240131") + row(b"*", b"x", b"", b"?", b"") + row(b" ", b"\x81", b"", b"N", b"")
    (tmp_path / "a.dbf").write_bytes(head + rows)
    (tmp_path / "a.cpg").write_text("windows-1252\n")
    got = vector.read(spark, str(tmp_path), "shapefile").orderBy("feature_id").collect()
    assert [r.feature_id for r in got] == [0, 2]
    assert codecs.from_wkb(bytes(got[0].geom)) == ("LineString", ((1.0, 2.0), (3.0, 4.0)))
    assert [json.loads(r.props) for r in got] == [{"T": "€uro", "N": 12.5, "L": True, "D": "20240131"}, {"T": "\x81", "N": 0.0, "L": False, "D": None}]
    (tmp_path / "a.dbf").write_bytes(head.replace(struct.pack("<I", 3), struct.pack("<I", 2), 1) + rows)
    with pytest.raises(Exception, match="differ"):
        vector.read(spark, str(tmp_path), "shapefile").collect()
    (tmp_path / "a.dbf").unlink()
    assert vector.read(spark, str(tmp_path), "shapefile").count() == 3


def test_what_a_shapefile_cannot_hold(spark, tmp_path):
    for texts, props in ((["POINT (1 1)", "LINESTRING (0 0, 1 1)"], None), (["GEOMETRYCOLLECTION (POINT (1 1))"], None), (["POINT (1 1)"], [{"a name too long": 1}]), (["POINT (1 1)"], [{"a": "x" * 300}])):
        with pytest.raises(ValueError):
            vector.write(made(spark, texts, props), str(tmp_path), "shp")
    mixed = [{"a": True, "b": 1, "c": 1.5, "d": None, "e": [1]}, {"a": None, "b": 22, "c": 3, "d": None, "e": "x"}]
    assert shapefile.fields_of(made(spark, ["POINT (1 1)"] * 2, mixed)) == [("a", "L", 1, 0), ("b", "N", 2, 0), ("c", "N", 10, 8), ("d", "C", 1, 0), ("e", "C", 3, 0)]


def test_multipolygons_as_one_record(spark, tmp_path):
    text = "MULTIPOLYGON (((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1)), ((9 9, 10 9, 10 10, 9 9)))"
    vector.write(made(spark, [text, "POLYGON ((0 0, 1 0, 1 1, 0 0))"]).coalesce(1), str(tmp_path), "shp")
    kind, rings = codecs.from_wkb(bytes(vector.read(spark, str(tmp_path), "shapefile").orderBy("feature_id").first().geom))
    area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False)) / 2
    assert kind == "Polygon" and [area(r) for r in rings] == [-16, 1, -0.5]  # a record's parts: outer rings run clockwise


def test_geopackage_tables(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.gpkg")
    con.executescript(geopackage.SCHEMA)
    con.execute("CREATE TABLE t (k TEXT PRIMARY KEY, g BLOB, b BLOB, r REAL) WITHOUT ROWID")
    point = codecs.to_wkb(("Point", (1.0, 2.0)))
    envelope = b"GP" + struct.pack(">BBi", 0, 2, 27700) + struct.pack(">4d", 1, 1, 2, 2) + point
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [("a", envelope, b"\1\2", float("inf")), ("b", b"GP\0\x11" + struct.pack("<i", 0), None, 1.5), ("c", None, None, None)])
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('t', 'g', 'POINT', 27700, 0, 0)")
    con.commit()
    con.close()
    got = vector.read(spark, str(tmp_path / "a.gpkg")).orderBy("feature_id").collect()
    assert [r.geom and codecs.from_wkb(bytes(r.geom)) for r in got] == [("Point", (1.0, 2.0)), None, None]
    assert [json.loads(r.props) for r in got] == [{"k": "a", "b": "AQI=", "r": 0.0}, {"k": "b", "b": None, "r": 1.5}, {"k": "c", "b": None, "r": None}]
    assert geopackage.decode_blob(envelope) == (("Point", (1.0, 2.0)), 27700)
    assert geopackage.decode_blob(geopackage.encode_blob(("Point", (3.0, 4.0)), 4326)) == (("Point", (3.0, 4.0)), 4326)
    with pytest.raises(ValueError):
        geopackage.decode_blob(b"XX" + envelope[2:])
