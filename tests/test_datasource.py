"""The registered formats: rows as from the readers, and fewer partitions, chunks and records under a filter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions.udf import st_geomfromtext
from meridian.raster.band import BandMeta, GeoTransform
from meridian.sources import codecs, datasource, geotiff, vector


def test_cells_of_a_window(spark, tmp_path):
    y, x = np.mgrid[0:200, 0:300]
    cells = np.stack([(x + y) % 251, (x * 3 + y) % 241]).astype(float)
    (tmp_path / "a.tif").write_bytes(geotiff.encode(cells, BandMeta(300, 200, "u8", None, GeoTransform()), 64, False, 1))
    datasource.register(spark)
    read = spark.read.format("meridian_geotiff").option("band", 1).option("partitionBytes", 1).load(str(tmp_path))
    whole = read.collect()
    assert len(whole) == 60_000 and all(r.v == cells[1, r.y, r.x] for r in whole)
    assert read.rdd.getNumPartitions() == 20
    window = read.where("x >= 100 and x < 130 and y > 60 and y <= 70 and v >= 0")
    assert window.rdd.getNumPartitions() == 4  # two chunks across, two down
    assert sorted((r.x, r.y, r.v) for r in window.collect()) == [(i, j, cells[1, j, i]) for i in range(100, 130) for j in range(61, 71)]
    assert read.where("x = 5 and y = 6").select("v").first().v == cells[1, 6, 5]
    assert read.where("x > 1000").count() == 0
    small = spark.read.format("meridian_geotiff").option("image", 1).load(str(tmp_path / "a.tif"))
    assert small.count() == 150 * 100
    with pytest.raises(Exception, match="no band 7"):
        spark.read.format("meridian_geotiff").option("band", 7).load(str(tmp_path)).collect()


def test_records_of_a_box(spark, tmp_path):
    texts = [f"LINESTRING ({k} 0, {k + 0.5} {k})" for k in range(60)]
    features = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(st_geomfromtext(F.col("t")).alias("geom"), F.lit("{}").alias("props"))
    vector.write(features, str(tmp_path), "shp")
    datasource.register(spark)
    read = spark.read.format("meridian_shapefile").option("partitionBytes", 1000).load(str(tmp_path))
    rows = read.orderBy("feature_id").collect()
    assert [codecs.to_wkt(codecs.from_wkb(bytes(r.geom))) for r in rows] == [codecs.to_wkt(codecs.from_wkt(t)) for t in texts]
    assert read.rdd.getNumPartitions() > 3
    few = read.where("xmin >= 10 and xmax <= 20.5")
    assert sorted(r.feature_id for r in few.collect()) == list(range(10, 21))
    reader = datasource.ShapefileReader({"path": str(tmp_path)})
    list(reader.pushFilters([datasource.GreaterThanOrEqual(("xmin",), 10.0), datasource.LessThanOrEqual(("xmax",), 20.5)]))
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 11  # the others weren't taken apart
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("meridian_shapefile").load(str(empty)).count() == 0
