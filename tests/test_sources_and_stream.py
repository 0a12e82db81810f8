import json

from meridian.plans.fixtures import view
from meridian.plans.planar_queries import polygons
from meridian.sources import vector
from meridian.streaming import geofence

SF = "/root/testdata/sf0.001"


def test_geojson_in_and_out(spark, tmp_path):
    features = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2, 9]}, "properties": {"b": 1, "a": "x"}}, {"type": "Feature", "geometry": None, "properties": None}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "LineString", "coordinates": [[0, 0], [3, 4]]}))
    df = vector.read(spark, str(tmp_path), "geojson")
    assert {(r.feature_id, r.props, r.geom is None) for r in df.collect()} == {(0, "{}", False), (0, '{"a": "x", "b": 1}', False), (1, "{}", True)}
    vector.to_geojson_lines(df).write.text(str(tmp_path / "out"))
    again = vector.features_of(json.dumps({"type": "FeatureCollection", "features": [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]}))
    assert sorted(again, key=str) == sorted(((bytes(r.geom) if r.geom else None, r.props) for r in df.collect()), key=str)
    got = {r.kind: (r.features, r.xmin, r.ymax) for r in vector.summarize(df).collect()}
    assert got == {"Point": (1, 1.0, 2.0), "LineString": (1, 0.0, 4.0), None: (1, None, None)}


def test_wkt_lines(spark, tmp_path):
    (tmp_path / "a.wkt").write_text("POINT (1 2)\n\n  linestring (0 0, 1 1)\n")
    assert vector.read(spark, str(tmp_path / "a.wkt")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    fixes = view(spark, SF, "pts").withColumnRenamed("point_id", "fix_id")
    fixes.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fixes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    zones = polygons(spark, SF)
    query = geofence.geofence(stream, zones, 100.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, geofence.geofence(fixes, zones, 100.0).collect()))
