"""Vector files as DataFrames of features: (feature_id, geom: WKB or null, props: JSON text)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codecs

FEATURES = "path string, feature_id long, geom binary, props string"
_NAMES = ["path", "feature_id", "geom", "props"]

#: Bytes of a GeoJSON file that one task scans at a time.
CHUNK_BYTES = 8 << 20

# Names and endings of formats.
FORMATS = {"geojson": "geojson", "json": "geojson", "wkt": "wkt", "wkb": "wkb", "shp": "shp", "shapefile": "shp", "gpkg": "gpkg", "geopackage": "gpkg"}


def format_of(path_or_name: str) -> str:
    """The format by its name or by a path's ending."""
    key = path_or_name.lower().rsplit(".", 1)[-1]
    if key not in FORMATS:
        raise ValueError(f"unknown format {path_or_name!r}")
    return FORMATS[key]


def features_of(text: str) -> list[tuple[bytes | None, str]]:
    """(WKB or None, properties as JSON) of a FeatureCollection, a Feature or a bare geometry."""
    value = json.loads(text)
    kind = value.get("type") if isinstance(value, dict) else None
    if kind == "FeatureCollection":
        members = value["features"]
    elif kind == "Feature":
        members = [value]
    elif kind in codecs.CODES:
        members = [{"geometry": value, "properties": None}]
    else:
        raise ValueError("not GeoJSON")
    return [(None if m.get("geometry") is None else codecs.to_wkb(codecs.from_geojson(m["geometry"])), json.dumps(m.get("properties") or {}, sort_keys=True)) for m in members]


def read_geojson(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every feature of the files under ``path``, numbered by its place in its file.

    A file is a FeatureCollection, or Features and geometries one after another (a single one, lines, a text sequence).  Files
    are cut into chunks that tasks read by byte ranges, so one collection of any size is many tasks: see :mod:`.geojson`.
    """
    from .geojson import objects

    found = objects(spark, path, chunk_bytes)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            out = [(p, n, *f) for p, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for f in features_of(text)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)], _NAMES)

    return found.mapInArrow(run, FEATURES)


def read_wkt(spark: SparkSession, path: str) -> DataFrame:
    """A geometry on each line that isn't blank; lines are split over tasks."""
    from meridian.functions.udf import st_geomfromtext

    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("feature_id"), st_geomfromtext(F.trim("value")).alias("geom"), F.lit("{}").alias("props"))


def read_wkb(spark: SparkSession, path: str) -> DataFrame:
    """A geometry in each file, checked and rewritten in little-endian order."""
    from meridian.functions.udf import st_astext, st_geomfromtext

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.lit(0).cast("long").alias("feature_id"), st_geomfromtext(st_astext(F.col("content"))).alias("geom"), F.lit("{}").alias("props"))


def to_geojson_lines(features: DataFrame) -> DataFrame:
    """A Feature as JSON text in each row (column ``value``), for ``df.write.text``."""
    from meridian.functions.udf import st_asgeojson

    geometry = F.coalesce(st_asgeojson(F.col("geom")), F.lit("null"))
    return features.select(F.concat(F.lit('{"geometry":'), geometry, F.lit(',"properties":'), F.coalesce("props", F.lit("{}")), F.lit(',"type":"Feature"}')).alias("value"))


def to_feature_collection(features: DataFrame) -> DataFrame:
    """The lines (``value``) of one FeatureCollection in the order of ``part`` and ``n``: a head, a Feature a line with a comma before all but the first, a tail.

    Parts are the partitions of ``features``; the first one with rows is found by a small job, and nothing is shuffled.
    """
    lines = to_geojson_lines(features).select("value", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("n"))
    first = lines.agg(F.min("n")).first()[0]
    comma = F.when(F.col("n") == (-1 if first is None else first), F.lit("")).otherwise(F.lit(","))
    ends = [(-1, -1, '{"features":['), (1 << 62, 0, '],"type":"FeatureCollection"}')]
    head, tail = (features.sparkSession.range(1).select(F.lit(v).alias("value"), F.lit(p).cast("long").alias("part"), F.lit(n).cast("long").alias("n")) for p, n, v in ends)
    return head.unionByName(lines.withColumn("value", F.concat(comma, "value"))).unionByName(tail)


def write_feature_collection(features: DataFrame, folder: str, files: int = 1) -> None:
    """One FeatureCollection as text under ``folder``: one file, or as many as are named, which in the order of their names make one text."""
    rows = to_feature_collection(features)
    spread = rows.repartition(1) if files == 1 else rows.repartitionByRange(files, "part", "n")
    spread.sortWithinPartitions("part", "n").select("value").write.text(folder)


def read(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Features of files of any format, by its name or the path's ending."""
    from .geopackage import read_gpkg
    from .shapefile import read_shapefile

    return {"geojson": read_geojson, "wkt": read_wkt, "wkb": read_wkb, "shp": read_shapefile, "gpkg": read_gpkg}[format_of(fmt or path)](spark, path)


def write(features: DataFrame, folder: str, fmt: str) -> None:
    """Features (geom, props) as files under a folder, a file for each partition: Features in lines (GeoJSON; :func:`write_feature_collection` for one collection), WKT lines, shapefiles or GeoPackages."""
    from meridian.functions.udf import st_astext

    from .geopackage import write_gpkg
    from .shapefile import write_shapefile

    kind = format_of(fmt)
    if kind == "geojson":
        to_geojson_lines(features).write.text(folder)
    elif kind == "wkt":
        features.where("geom is not null").select(st_astext(F.col("geom")).alias("value")).write.text(folder)
    elif kind in ("shp", "gpkg"):
        made = write_shapefile(features, folder) if kind == "shp" else write_gpkg(features, folder)
        made.write.format("noop").mode("overwrite").save()
    else:
        raise ValueError(f"{fmt} can't be written")


def summarize(features: DataFrame, total: bool = False) -> DataFrame:
    """A row for each geometry type (null: features without geometry) with count, bounds and the sorted names of properties; with ``total`` one for all of them, of kind ``*``."""
    from meridian.functions import planar
    from meridian.functions.udf import st_geometrytype, st_points

    boxed = features.select(st_geometrytype(F.col("geom")).alias("kind"), planar.bbox(st_points(F.col("geom"))).alias("b"), F.json_object_keys("props").alias("keys"))
    kinds = [F.struct(F.lit(False).alias("all"), "kind"), F.struct(F.lit(True).alias("all"), F.lit("*").alias("kind"))]
    each = boxed.select(F.explode(F.array(*kinds[: 1 + total])).alias("k"), "b", "keys")
    counts = each.groupBy("k").agg(F.count("*").alias("features"), F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))
    names = each.select("k", F.explode("keys").alias("name")).distinct().groupBy("k").agg(F.sort_array(F.collect_list("name")).alias("properties"))
    return counts.join(names, counts["k"].eqNullSafe(names["k"]), "left").select(counts["k.kind"].alias("kind"), "features", "xmin", "ymin", "xmax", "ymax", F.coalesce("properties", F.array().cast("array<string>")).alias("properties"))


def validate(features: DataFrame) -> DataFrame:
    """(path, feature_id, part, problem) of what is wrong with features, down to the parts of multi-geometries and collections.

    ``part`` is a path like ``0/2``: numbers of members from the outside, empty for the geometry itself.  A feature without a geometry, a line of
    fewer than two vertices and a polygon that isn't valid are problems; so is a geometry without parts.
    """
    from meridian.functions import planar, relate

    kind = f"array<struct<part: string, kind: string, rings: {planar.POLYGON}>>"

    def parts(b: bytes | None) -> list[dict]:
        def walk(g: tuple, at: str) -> Iterator[dict]:
            name, c = g
            members = c if name == "GeometryCollection" else [(name.removeprefix("Multi"), m) for m in c] if name.startswith("Multi") else None
            if members is not None:
                if not members:
                    yield {"part": at, "kind": "empty", "rings": None}
                for k, m in enumerate(members):
                    yield from walk(m, f"{at}/{k}" if at else str(k))
                return
            shape = {"Point": lambda: [[c]], "LineString": lambda: [c], "Polygon": lambda: c}[name]()
            yield {"part": at, "kind": name, "rings": [[{"x": x, "y": y} for x, y in ring] for ring in shape]}

        return [{"part": "", "kind": "none", "rings": None}] if b is None else list(walk(codecs.from_wkb(b), ""))

    def call(column: pa.Array) -> pa.Array:
        from meridian.functions import batches

        ring = pa.struct([("part", pa.string()), ("kind", pa.string()), ("rings", batches.POLYGON_TYPE)])
        return pa.array([parts(b) for b in column.to_pylist()], pa.list_(ring))

    each = features.select("path", "feature_id", F.inline(F.arrow_udf(call, kind)(F.col("geom"))))
    judged = each.withColumn("valid", relate.is_valid(F.when(F.col("kind") == "Polygon", F.col("rings"))))
    problem = (
        F.when(F.col("kind") == "none", "no geometry").when(F.col("kind") == "empty", "no parts")
        .when((F.col("kind") == "LineString") & (F.size(F.get("rings", F.lit(0))) < 2), "a line needs two vertices")
        .when((F.col("kind") == "Polygon") & ~F.col("valid"), "not a valid polygon")
    )
    return judged.withColumn("problem", problem).where("problem is not null").select("path", "feature_id", "part", "problem")
