"""GeoJSON read by byte ranges, written as one collection; summaries and problems of whole files."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridian.sources import geojson, vector


def features(n, rng):
    odd = ["plain", 'a "quote"', "back\\slash", "\\\\\\", "{[", "}]", '\\"}', "é日👍", "\n\t"]
    out = []
    for k in range(n):
        coordinates = [rng.uniform(-90, 90), rng.uniform(-90, 90)]
        props = {rng.choice(odd): rng.choice(odd) for _ in range(rng.randint(0, 3))} | {"k": k, "deep": {"a": [{"b": ["]", {"c": "}"}]}]}}
        geometry = None if k % 7 == 3 else {"type": "Point", "coordinates": coordinates}
        out.append({"type": "Feature", "geometry": geometry, "properties": props})
    return out


def collection(members, rng, indent=None):
    """With other arrays and objects before and behind the features."""
    value = {"type": "FeatureCollection", "note": 'says "features": [', "bbox": [1, 2], "other": [{"type": "Feature"}, [{"x": 1}]], "features": members, "links": [{"type": "Feature", "geometry": None}], "crs": {"features": [{"no": 1}]}}
    return json.dumps(value, indent=indent, ensure_ascii=rng.random() < 0.5)


def wanted(members):
    return [json.dumps(m["properties"], sort_keys=True) for m in members]


@pytest.mark.parametrize("chunk", [7, 64, 1000, 1 << 20])
def test_collections_in_chunks_of_any_size(spark, tmp_path, chunk):
    rng = random.Random(chunk)
    n = 4 if chunk == 7 else 60
    sets = {"a.geojson": features(n, rng), "b.json": features(3, rng), "c.geojson": []}
    for name, members in sets.items():
        (tmp_path / name).write_text(collection(members, rng, rng.choice([None, 1])), encoding="utf-8")
    lines = features(5, rng)
    (tmp_path / "d.geojson").write_text("\n".join(json.dumps(m) for m in lines), encoding="utf-8")
    (tmp_path / "e.geojson").write_text(json.dumps({"type": "Point", "coordinates": [1, 2]}))
    (tmp_path / "f.geojson").write_text("")
    rows = vector.read_geojson(spark, str(tmp_path), chunk).orderBy("path", "feature_id").collect()
    got = {}
    for r in rows:
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.feature_id, r.props, r.geom is None))
    for name, members in (*sets.items(), ("d.geojson", lines)):
        assert got.get(name, []) == [(k, p, m["geometry"] is None) for k, (p, m) in enumerate(zip(wanted(members), members, strict=True))]
    assert got["e.geojson"] == [(0, "{}", False)] and "f.geojson" not in got


def test_one_file_is_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    members = features(4000, rng)
    (tmp_path / "big.geojson").write_text(collection(members, rng), encoding="utf-8")
    read = vector.read_geojson(spark, str(tmp_path), 50_000)
    assert [r.props for r in read.orderBy("feature_id").collect()] == wanted(members)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = vector.read_geojson(spark, str(tmp_path), 50_000).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1


@pytest.mark.parametrize("files", [1, 3])
def test_one_collection_from_many_partitions(spark, tmp_path, files):
    rng = random.Random(2)
    members = features(40, rng)
    (tmp_path / "in.geojson").write_text(collection(members, rng), encoding="utf-8")
    read = vector.read_geojson(spark, str(tmp_path / "in.geojson")).repartition(5).sortWithinPartitions("feature_id")
    vector.write_feature_collection(read, str(tmp_path / "out"), files)
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert len(parts) == files
    value = json.loads("".join(p.read_text(encoding="utf-8") for p in parts))
    assert value["type"] == "FeatureCollection" and sorted(map(json.dumps, (f["properties"]["k"] for f in value["features"]))) == sorted(map(json.dumps, range(40)))
    vector.write_feature_collection(read.limit(0), str(tmp_path / "none"))
    assert json.loads(next((tmp_path / "none").glob("part-*")).read_text()) == {"type": "FeatureCollection", "features": []}


def test_summaries_and_problems(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    bow = [[0, 0], [4, 4], [4, 0], [0, 4], [0, 0]]
    shapes = [
        {"type": "Polygon", "coordinates": [square]},
        {"type": "MultiPolygon", "coordinates": [[square], [bow]]},
        {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [9, 9]}, {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[5, 5]]]}, {"type": "Polygon", "coordinates": [bow]}]},
        None,
        {"type": "LineString", "coordinates": [[1, 1]]},
        {"type": "MultiPoint", "coordinates": []},
    ]
    members = [{"type": "Feature", "geometry": g, "properties": {"a": k} if k % 2 else {"b": k, "c": 1}} for k, g in enumerate(shapes)]
    (tmp_path / "x.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": members}))
    read = vector.read_geojson(spark, str(tmp_path))
    problems = sorted((r.feature_id, r.part, r.problem) for r in vector.validate(read).collect())
    line, ring = "a line needs two vertices", "not a valid polygon"
    assert problems == [(1, "1", ring), (2, "1/1", line), (2, "2", ring), (3, "", "no geometry"), (4, "", line), (5, "", "no parts")]
    got = {r.kind: (r.features, r.xmax, r.properties) for r in vector.summarize(read, total=True).collect()}
    assert got["*"] == (6, 9.0, ["a", "b", "c"]) and got["Polygon"] == (1, 4.0, ["b", "c"]) and got[None] == (1, None, ["a"])


def test_small_chunks_do_not_read_a_file_many_times(tmp_path, monkeypatch):
    members = features(3000, random.Random(5))
    text = collection(members, random.Random(6)).encode()
    path = str(tmp_path / "x.geojson")
    (tmp_path / "x.geojson").write_bytes(text)
    low = text.index(b'"features": [{"type"') + 12
    asked = []
    real = geojson.read_range
    monkeypatch.setattr(geojson, "read_range", lambda p, start, length: asked.append(length) or real(p, start, length))
    starts = range(0, len(text), 4096)
    tallies = pa.Table.from_batches(geojson._tallies(iter([pa.RecordBatch.from_pydict({"path": [path] * len(starts), "k": list(range(len(starts))), "start": list(starts), "stop": [min(s + 4096, len(text)) for s in starts]})]))).to_pylist()
    inside, depth, rows = 0, 0, []
    for t in tallies:
        rows.append({"path": path, "start": t["start"], "stop": t["stop"], "inside": inside, "depth": depth, "level": 2, "low": low - 1, "high": text.rindex(b'], "links"'), "number": 0})
        depth += t["within"] if inside else t["out"]
        inside = (inside + t["odd"]) % 2
    found = [json.loads(v) for b in geojson._objects(iter([pa.RecordBatch.from_pylist(rows)])) for v in b.column(2).to_pylist()]
    assert found == members
    assert sum(asked) < 3 * len(text)  # two scans
