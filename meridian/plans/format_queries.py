"""Registered queries on codecs, summaries, constructive geometry and geofences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import buffers, overlay, relate
from meridian.functions import planar as P
from meridian.functions import udf as U
from meridian.operators import joins
from meridian.raster.band import BandMeta, GeoTransform
from meridian.session import scratch
from meridian.sources import geotiff, vector
from meridian.streaming.geofence import geofence

from .fixtures import view
from .planar_queries import lines, polygons, query, r, rects


@query("wkt_roundtrip", "SELECT zone_id, 'POINT (' || CAST(CAST(h AS INT) AS VARCHAR) || ' ' || CAST(CAST(h AS INT) + 1 AS VARCHAR) || ')' AS wkt FROM zones")
def wkt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("h").cast("int")
    text = F.concat(F.lit("srid=4326; point zm("), h.cast("string"), F.lit(".0 "), (h + 1).cast("string"), F.lit("  7 8)"))
    return view(spark, sf_dir, "zones").select("zone_id", U.st_astext(U.st_geomfromtext(text)).alias("wkt"))


@query("wkb_roundtrip", "SELECT zone_id, hex('\\x01\\x01\\x00\\x00\\x00'::BLOB) AS head, 21 AS n FROM zones")
def wkb_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = view(spark, sf_dir, "zones").select("zone_id", U.st_geomfromtext(F.format_string("POINT (%s %s)", F.col("cx").cast("string"), F.col("cy").cast("string"))).alias("b"))
    return made.select("zone_id", F.hex(F.substring("b", 1, 5)).alias("head"), F.octet_length("b").alias("n"))


@query("geojson_parse", "SELECT zone_id, cx AS x, cy AS y, 'Point' AS kind FROM zones")
def geojson_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('{"type":"Point","coordinates":[%s,%s,5]}', F.col("cx").cast("string"), F.col("cy").cast("string"))
    made = view(spark, sf_dir, "zones").select("zone_id", U.st_geomfromgeojson(text).alias("b"))
    return made.select("zone_id", F.get(U.st_points(F.col("b")), F.lit(0)).alias("p"), U.st_geometrytype(F.col("b")).alias("kind")).select("zone_id", "p.x", "p.y", "kind")


# a hull's edges: pairs with all other points of their line on the left
@query("convex_hull_area", """WITH d AS (SELECT DISTINCT line_id, x, y FROM line_pts),
 e AS (SELECT a.line_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM d a JOIN d b ON a.line_id = b.line_id AND (a.x <> b.x OR a.y <> b.y)),
 h AS (SELECT e.line_id, x1, y1, x2, y2 FROM e JOIN d p ON p.line_id = e.line_id GROUP BY e.line_id, x1, y1, x2, y2 HAVING min((x2-x1)*(p.y-y1) - (y2-y1)*(p.x-x1)) >= 0 AND count(*) > 2)
 SELECT l.line_id, round(coalesce(sum(x1*y2 - x2*y1)/2, 0), 4) AS area FROM (SELECT DISTINCT line_id FROM line_pts) l LEFT JOIN h ON h.line_id = l.line_id GROUP BY l.line_id""")
def convex_hull_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("line_id", r(P.ring_signed_area(U.st_convexhull(F.col("line"))), 4).alias("area"))


@query("simplify_count")
def simplify_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("line_id", F.size(U.st_simplify(F.col("line"), 100.0)).alias("n"))


@query("buffer_point_area", "SELECT zone_id, round(16.0/2*sin(2*pi()/16)*h*h/100, 6) AS area FROM zones")
def buffer_point_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All within a tenth of a zone's half width of its centre."""
    made = view(spark, sf_dir, "zones").select("zone_id", buffers.buffer_point(P.point(F.col("cx"), F.col("cy")), F.col("h") / 10, 16).alias("b"))
    return made.select("zone_id", r(P.multipolygon_area(F.col("b"))).alias("area"))


def line_text(points: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(points, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ", "), F.lit(")"))


def zone_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every zone as a feature with its half width and shape."""
    z = polygons(spark, sf_dir).join(view(spark, sf_dir, "zones").select("zone_id", "h", "shape"), "zone_id")
    closed = F.transform("polygon", lambda ring: F.concat(ring, F.slice(ring, 1, 1)))
    text = F.concat(F.lit("POLYGON ("), F.array_join(F.transform(closed, line_text), ", "), F.lit(")"))
    props = F.to_json(F.struct("zone_id", "h", F.when(F.col("shape") > 0, F.col("shape")).alias("shape")))
    return z.select(F.lit("zones").alias("path"), F.col("zone_id").alias("feature_id"), U.st_geomfromtext(text).alias("geom"), props.alias("props"))


ROUND_TRIP = "SELECT zone_id, round(CASE shape WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END * h * h, 6) AS area, cx - h AS xmin, cy + h AS ymax, h FROM zones"


def read_back(features: DataFrame) -> DataFrame:
    """What a zone's feature still says after a file."""
    m = F.col("m")
    told = features.select(F.get_json_object("props", "$.zone_id").cast("double").cast("long").alias("zone_id"), F.get_json_object("props", "$.h").cast("double").alias("h"), U.st_measures(F.col("geom")).alias("m"))
    return told.select("zone_id", r(m["area"]).alias("area"), m["xmin"].alias("xmin"), m["ymax"].alias("ymax"), "h")


@query("geojson_file", ROUND_TRIP)
def geojson_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All zones as one FeatureCollection, written and read again by ranges of 4 KB."""
    folder = scratch(spark, "geojson")
    vector.write_feature_collection(zone_features(spark, sf_dir), folder)
    return read_back(vector.read_geojson(spark, folder, 4096))


@query("shapefile_file", ROUND_TRIP)
def shapefile_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All zones as shapefiles, written and read again."""
    folder = scratch(spark, "shapefile")
    vector.write(zone_features(spark, sf_dir), folder, "shp")
    return read_back(vector.read(spark, folder, "shp"))


@query("geotiff_file", "SELECT x, y, v FROM cells")
def geotiff_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells as a mosaic of tiled GeoTIFFs with overviews, written and read again chunk by chunk, at their places in the whole."""
    folder, given = scratch(spark, "geotiff"), view(spark, sf_dir, "cells")
    height = given.agg(F.max("y")).first()[0] + 1
    meta = BandMeta(40, height, "f64", -9999.0, GeoTransform(0.0, float(height), 1.0, 1.0))
    geotiff.write_mosaic(given, meta, folder, 32, 16, True, 1, 1).write.format("noop").mode("overwrite").save()
    found = geotiff.layouts(spark, folder).cache()
    corner = found.where("image = 0").select("path", F.col("origin_x").cast("int").alias("x0"), (height - F.col("origin_y")).cast("int").alias("y0"))
    read = geotiff.read_cells(found).join(corner, "path").select((F.col("x") + F.col("x0")).alias("x"), (F.col("y") + F.col("y0")).alias("y"), "v")
    return read.join(given.select("x", "y"), ["x", "y"])  # a last row that isn't full has been filled up


Q = "q AS (SELECT zone_id, cx-h AS x0, cy-h AS y0, cx+h AS x1, cy+h AS y1 FROM zones), p AS (SELECT a.zone_id AS left_id, b.zone_id AS right_id, least(a.x1,b.x1)-greatest(a.x0,b.x0) AS w, least(a.y1,b.y1)-greatest(a.y0,b.y0) AS h, (a.x1-a.x0)*(a.y1-a.y0) AS aa, (b.x1-b.x0)*(b.y1-b.y0) AS ab, a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 AS holds FROM q a JOIN q b ON a.zone_id < b.zone_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)"


def rect_measures(spark: SparkSession, sf_dir: str, of_boxes: joins.Measure, of_polygons: joins.Measure, name: str) -> DataFrame:
    """Pairs of the zones' bounding rectangles that meet, with a measure of them."""
    return joins.polygon_measures(rects(spark, sf_dir, "left_id"), rects(spark, sf_dir, "right_id"), of_boxes, of_polygons, name, 100.0, ordered=True)


@query("polygon_contains_rect", f"WITH {Q} SELECT left_id, right_id FROM p WHERE holds")
def polygon_contains_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    holds = lambda matrix: relate.matches(matrix, "T*****FF*")
    found = rect_measures(spark, sf_dir, lambda a, b: holds(relate.relate_boxes(a, b)), relate.polygon_contains_polygon, "holds")
    return found.where("holds").select("left_id", "right_id")


@query("rects_touch", f"WITH {Q} SELECT left_id, right_id, w*h <= 1e-9*(aa+ab) AS touch FROM p")
def rects_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = lambda s: s["both"] <= 1e-9 * (s["a"] + s["b"])
    return rect_measures(spark, sf_dir, overlay.box_areas, overlay.areas, "s").select("left_id", "right_id", apart(F.col("s")).alias("touch"))


@query("clip_intersection_area", f"WITH {Q} SELECT left_id, right_id, round(w*h, 4) AS area FROM p")
def clip_intersection_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rect_measures(spark, sf_dir, overlay.box_areas, overlay.areas, "s").select("left_id", "right_id", r(F.col("s.both"), 4).alias("area"))


@query("dataset_summary", """WITH b AS (SELECT count(*) AS features, min(cx-h) AS xmin, min(cy-h) AS ymin, max(cx+h) AS xmax, max(cy+h) AS ymax, max(shape) AS s FROM zones)
 SELECT kind, features, xmin, ymin, xmax, ymax, CASE WHEN s > 0 THEN 'h,shape,zone_id' ELSE 'h,zone_id' END AS properties FROM b CROSS JOIN (VALUES ('Polygon'), ('*')) k(kind)""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = vector.summarize(zone_features(spark, sf_dir), total=True)
    return told.withColumn("properties", F.array_join("properties", ","))


@query("validate_features", """SELECT line_id AS feature_id, '' AS part, 'a line needs two vertices' AS problem FROM line_pts GROUP BY line_id HAVING count(*) < 2
 UNION ALL SELECT zone_id, '1/0', 'not a valid polygon' FROM zones WHERE shape = 2""")
def validate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, and for every zone a collection of its centre, and a multipolygon (of a bow tie, for a triangle)."""
    line = lines(spark, sf_dir).select(F.lit("lines").alias("path"), F.col("line_id").alias("feature_id"), U.st_geomfromtext(F.concat(F.lit("LINESTRING "), line_text(F.col("line")))).alias("geom"))
    at = lambda dx, dy: F.concat((F.col("cx") + dx * F.col("h")).cast("string"), F.lit(" "), (F.col("cy") + dy * F.col("h")).cast("string"))
    corners = [at(-1, -1), F.when(F.col("shape") == 2, at(1, 1)).otherwise(at(1, -1)), F.when(F.col("shape") == 2, at(1, -1)).otherwise(at(1, 1)), at(-1, 1), at(-1, -1)]
    text = F.concat(F.lit("GEOMETRYCOLLECTION (POINT ("), at(0, 0), F.lit("), MULTIPOLYGON ((("), F.concat_ws(", ", *corners), F.lit("))))"))
    zone = view(spark, sf_dir, "zones").select(F.lit("zones").alias("path"), F.col("zone_id").alias("feature_id"), U.st_geomfromtext(text).alias("geom"))
    return vector.validate(line.unionByName(zone)).select("feature_id", "part", "problem")


@query("stream_geofence", "SELECT point_id AS fix_id, zone_id FROM inside")
def stream_geofence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the stream: the same plan over a static table."""
    return geofence(view(spark, sf_dir, "pts").withColumnRenamed("point_id", "fix_id"), polygons(spark, sf_dir), 100.0)
