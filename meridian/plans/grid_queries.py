"""Registered queries on rasters and cell ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import planar, s2
from meridian.operators import joins
from meridian.raster import band as B

from .fixtures import view
from .planar_queries import polygons, query, r

META = B.BandMeta(40, 1 << 20, nodata=-9999.0)
BYTE = B.BandMeta(40, 1 << 20, cell_type="u8", nodata=-9999.0)
L = "l AS (SELECT x, y, CASE WHEN v <> -9999 THEN v END AS v FROM cells), q AS (SELECT x, y, CASE WHEN v <> -9999 THEN v END AS v FROM cells2)"


def cells(spark: SparkSession, sf_dir: str, name: str = "cells") -> DataFrame:
    return view(spark, sf_dir, name)


def _binary(name: str, op, sql: str, meta: B.BandMeta = META) -> None:
    @query(name, f"WITH {L} SELECT l.x, l.y, round(coalesce({sql}, -9999.0), 6) AS v FROM l JOIN q ON l.x = q.x AND l.y = q.y")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(cells(spark, sf_dir), cells(spark, sf_dir, "cells2"), meta, META).select("x", "y", r(F.col("v")).alias("v"))


_binary("raster_add", B.add, "greatest(0.0, least(255.0, round(l.v + q.v)))", BYTE)
_binary("raster_subtract", B.subtract, "l.v - q.v")
_binary("raster_multiply", B.multiply, "greatest(0.0, least(255.0, round(l.v * q.v)))", BYTE)
_binary("raster_divide", B.divide, "l.v / nullif(q.v, 0)")


@query("raster_min_max", f"WITH {L} SELECT l.x, l.y, coalesce(CASE WHEN q.v < l.v THEN q.v WHEN q.v IS NOT NULL THEN l.v END, -9999.0) AS lo, coalesce(CASE WHEN q.v > l.v THEN q.v WHEN q.v IS NOT NULL THEN l.v END, -9999.0) AS hi FROM l JOIN q ON l.x = q.x AND l.y = q.y")
def raster_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = cells(spark, sf_dir), cells(spark, sf_dir, "cells2")
    return B.minimum(a, b, META, META).withColumnRenamed("v", "lo").join(B.maximum(a, b, META, META).withColumnRenamed("v", "hi"), ["x", "y"])


@query("raster_scale_offset", "SELECT x, y, CASE WHEN v = -9999 THEN v ELSE v*1.5 END AS scaled, CASE WHEN v = -9999 THEN v ELSE v-7.25 END AS moved FROM cells")
def raster_scale_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = cells(spark, sf_dir)
    return B.scale(a, META, 1.5).withColumnRenamed("v", "scaled").join(B.offset(a, META, -7.25).withColumnRenamed("v", "moved"), ["x", "y"])


@query("raster_clamp", "SELECT x, y, CASE WHEN v = -9999 THEN v ELSE greatest(10.0, least(40.0, v)) END AS v FROM cells")
def raster_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.clamp(cells(spark, sf_dir), META, 10, 40)


@query("raster_reclassify", "SELECT x, y, CASE WHEN v = -9999 THEN v WHEN v >= 0 AND v < 10 THEN 1.0 WHEN v >= 5 AND v < 25 THEN 2.0 WHEN v >= 25 AND v < 40 THEN 3.0 ELSE -9999.0 END AS v FROM cells")
def raster_reclassify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.reclassify(cells(spark, sf_dir), META, [(0, 10, 1), (5, 25, 2), (25, 40, 3)])


def focal_sql(radius: int, columns: str) -> str:
    return f"WITH {L} SELECT a.x, a.y, {columns} FROM l a JOIN l b ON b.x BETWEEN a.x-{radius} AND a.x+{radius} AND b.y BETWEEN a.y-{radius} AND a.y+{radius} GROUP BY a.x, a.y"


@query("raster_focal_mean", focal_sql(1, "round(coalesce(avg(b.v), -9999.0), 6) AS v"))
def raster_focal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.focal(cells(spark, sf_dir), META, 1, {"v": "mean"}).select("x", "y", r(F.col("v")).alias("v"))


@query("raster_focal_minmaxrange", focal_sql(2, "coalesce(min(b.v), -9999.0) AS lo, coalesce(max(b.v), -9999.0) AS hi, coalesce(max(b.v)-min(b.v), -9999.0) AS span"))
def raster_focal_minmaxrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.focal(cells(spark, sf_dir), META, 2, {"lo": "min", "hi": "max", "span": "range"})


@query("raster_focal_std_median", focal_sql(1, "round(coalesce(stddev_pop(b.v), -9999.0), 6) AS std, coalesce(median(b.v), -9999.0) AS mid, coalesce(sum(b.v), -9999.0) AS total"))
def raster_focal_std_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.focal(cells(spark, sf_dir), META, 1, {"std": "std", "mid": "median", "total": "sum"})
    return found.withColumn("std", r(F.col("std")))


@query("raster_focal_kernel", f"WITH {L}, k(dx, dy, w) AS (VALUES (-1,-1,1.0),(0,-1,2.0),(1,-1,1.0),(-1,0,0.0),(0,0,0.5),(1,0,0.0),(-1,1,-1.0),(0,1,-2.0),(1,1,-1.0)) SELECT a.x, a.y, round(CAST(CASE WHEN count(b.v) = 9 THEN sum(b.v*w) ELSE -9999 END AS DOUBLE), 6) AS v FROM l a CROSS JOIN k LEFT JOIN l b ON b.x = a.x+dx AND b.y = a.y+dy GROUP BY a.x, a.y")
def raster_focal_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = [[1.0, 2.0, 1.0], [0.0, 0.5, 0.0], [-1.0, -2.0, -1.0]]
    return B.focal_kernel(cells(spark, sf_dir), META, kernel).select("x", "y", r(F.col("v")).alias("v"))


@query("raster_stats", f"WITH {L} SELECT count(v) AS valid_count, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean FROM l")
def raster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.stats(cells(spark, sf_dir), META).withColumn("mean", r(F.col("mean")))


def rows_of(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the raster, from its whole table."""
    return cells(spark, sf_dir).agg(F.max("y") + 1).first()[0]


#: The number of rows, for SQL.
ROWS = "h AS (SELECT max(y) + 1 AS n FROM cells)"


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, B.BandMeta]:
    """Points over a raster of 40 columns and all its rows, of cells of 50 units across that share 2000 units down."""
    meta = B.BandMeta(40, n := rows_of(spark, sf_dir), nodata=-9999.0, transform=B.GeoTransform(-1000.0, 1000.0, 50.0, 2000.0 / n))
    return view(spark, sf_dir, "pts").select("point_id", F.col("x").alias("wx"), F.col("y").alias("wy")), meta


@query("raster_sample_nearest", f"WITH {L}, {ROWS} SELECT point_id, l.v FROM pts p CROSS JOIN h LEFT JOIN l ON l.x = floor((p.x+1000)/50) AND l.y = floor((1000-p.y)/(2000.0/n))")
def raster_sample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, meta = _placed(spark, sf_dir)
    return B.sample_nearest(points, cells(spark, sf_dir), meta).select("point_id", "v")


@query("raster_sample_bilinear", f"""WITH {L}, {ROWS}, f AS (SELECT point_id, (x+1000)/50 AS fx, (1000-y)/(2000.0/n) AS fy, n FROM pts CROSS JOIN h), s AS (SELECT *, CASE WHEN fx <= 0.5 THEN 0 WHEN fx-0.5 >= 39 THEN 39 ELSE floor(fx-0.5) END AS ix, CASE WHEN fy <= 0.5 THEN 0 WHEN fy-0.5 >= n-1 THEN n-1 ELSE floor(fy-0.5) END AS iy FROM f),
t AS (SELECT *, CASE WHEN fx <= 0.5 OR ix = 39 THEN 0 ELSE fx-0.5-ix END AS tx, CASE WHEN fy <= 0.5 OR iy = n-1 THEN 0 ELSE fy-0.5-iy END AS ty, least(ix+1, 39) AS jx, least(iy+1, n-1) AS jy FROM s)
SELECT t.point_id, round(a.v*(1-tx)*(1-ty) + b.v*tx*(1-ty) + c.v*(1-tx)*ty + d.v*tx*ty, 3) AS v FROM t LEFT JOIN l a ON a.x = ix AND a.y = iy AND fx >= 0 AND fx < 40 AND fy >= 0 AND fy < n LEFT JOIN l b ON b.x = jx AND b.y = iy LEFT JOIN l c ON c.x = ix AND c.y = jy LEFT JOIN l d ON d.x = jx AND d.y = jy""")
def raster_sample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, meta = _placed(spark, sf_dir)
    return B.sample_bilinear(points, cells(spark, sf_dir), meta, "point_id").select("point_id", r(F.col("v"), 3).alias("v"))


@query("raster_downsample", f"WITH {L} SELECT CAST(floor(x/3) AS INT) AS x, CAST(floor(y/3) AS INT) AS y, round(coalesce(avg(v), -9999.0), 6) AS v FROM l GROUP BY 1, 2")
def raster_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.downsample(cells(spark, sf_dir), META, 3).select("x", "y", r(F.col("v")).alias("v"))


@query("raster_resample", f"WITH {ROWS} SELECT CAST(t.x AS INT) AS x, CAST(u.y AS INT) AS y, v FROM range(100) t(x) CROSS JOIN (SELECT unnest(range(n // 2 + 1)) AS y FROM h) u CROSS JOIN h JOIN cells c ON c.x = floor((t.x+0.5)*40/100) AND c.y = floor((u.y+0.5)*n/(n // 2 + 1))")
def raster_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = rows_of(spark, sf_dir)
    return B.resample_nearest(cells(spark, sf_dir), B.BandMeta(40, n), 100, n // 2 + 1)


@query("zonal_stats", "WITH m AS (SELECT x, y, v, CAST(x*50-975 AS DOUBLE) AS wx, CAST(980-y*40 AS DOUBLE) AS wy FROM cells WHERE v <> -9999), i AS (SELECT m.x, m.y, m.v, e.zone_id, e.ring, CAST(sum(CASE WHEN (e.y1>m.wy)<>(e.y2>m.wy) THEN CASE WHEN m.wx < (e.x1-e.x2)*(m.wy-e.y2)/nullif(e.y1-e.y2,0)+e.x2 THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT)%2 AS ins FROM m CROSS JOIN zone_edges e GROUP BY 1,2,3,4,5), k AS (SELECT x, y, v, zone_id FROM i GROUP BY 1,2,3,4 HAVING max(CASE WHEN ring=0 THEN ins ELSE 0 END)=1 AND max(CASE WHEN ring>0 THEN ins ELSE 0 END)=0) SELECT zone_id, count(*) AS n, round(avg(v), 6) AS mean, max(v) AS hi FROM k GROUP BY zone_id")
def zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = cells(spark, sf_dir).where("v <> -9999").select((F.col("y") * 40 + F.col("x")).alias("point_id"), (F.col("x") * 50 - 975).cast("double").alias("x"), (980 - F.col("y") * 40).cast("double").alias("y"), "v")
    found = joins.spatial_join(centres, polygons(spark, sf_dir), 100.0).join(centres.select("point_id", "v"), "point_id")
    return found.groupBy("zone_id").agg(F.count("*").alias("n"), r(F.avg("v")).alias("mean"), F.max("v").alias("hi"))


FACE = """c AS (SELECT gid, lat, lon, cos(radians(lat))*cos(radians(lon)) AS x, cos(radians(lat))*sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM geopts),
f AS (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x >= 0 THEN 0 ELSE 3 END WHEN abs(y) >= abs(z) THEN CASE WHEN y >= 0 THEN 1 ELSE 4 END ELSE CASE WHEN z >= 0 THEN 2 ELSE 5 END END AS face FROM c),
u AS (SELECT *, CASE face % 3 WHEN 0 THEN y/x WHEN 1 THEN -x/y ELSE -x/z END AS u, CASE face % 3 WHEN 0 THEN z/x WHEN 1 THEN z/y ELSE -y/z END AS v FROM f),
s AS (SELECT *, CASE WHEN u >= 0 THEN 0.5*sqrt(1+3*u) ELSE 1-0.5*sqrt(1-3*u) END AS s, CASE WHEN v >= 0 THEN 0.5*sqrt(1+3*v) ELSE 1-0.5*sqrt(1-3*v) END AS t FROM u),
k AS (SELECT gid, lat, lon, face, CAST(floor(s*4096) AS BIGINT) AS i, CAST(floor(t*4096) AS BIGINT) AS j FROM s),
m AS (SELECT *, (SELECT CAST(sum(((i >> b) & 1) * (1::BIGINT << (2*b)) + ((j >> b) & 1) * (1::BIGINT << (2*b+1))) AS BIGINT) FROM range(12) t(b)) AS pos FROM k)"""
#: The id without its face, which would pass the signed range.
BODY = "(pos * (1::BIGINT << 37) + (1::BIGINT << 36))"
TOKEN = f"lower(lpad(printf('%x', (face::UBIGINT * (1::UBIGINT << 61) + {BODY}::UBIGINT)), 16, '0'))"


def celled(spark: SparkSession, sf_dir: str, level: int = 12) -> DataFrame:
    return view(spark, sf_dir, "geopts").withColumn("cell", s2.cell_at(F.col("lat"), F.col("lon"), level))


@query("s2_cell_at", f"WITH {FACE} SELECT gid, face, {BODY} AS body, 12 AS level FROM m")
def s2_cell_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cell")
    return celled(spark, sf_dir).select("gid", s2.face(c).alias("face"), c.bitwiseAND(F.lit((1 << 61) - 1)).alias("body"), s2.level(c).alias("level"))


@query("s2_parent", f"WITH {FACE} SELECT gid, ((pos >> 8) * (1::BIGINT << 45) + (1::BIGINT << 44)) AS body, 8 AS level FROM m")
def s2_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = s2.parent(F.col("cell"), 8)
    return celled(spark, sf_dir).select("gid", c.bitwiseAND(F.lit((1 << 61) - 1)).alias("body"), s2.level(c).alias("level"))


@query("s2_children", f"WITH {FACE} SELECT gid, CAST(n AS INT) AS n, ((pos*4+n) * (1::BIGINT << 35) + (1::BIGINT << 34)) AS body FROM m CROSS JOIN range(4) t(n)")
def s2_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = celled(spark, sf_dir).select("gid", F.posexplode(s2.children(F.col("cell"))).alias("n", "c"))
    return four.select("gid", "n", F.col("c").bitwiseAND(F.lit((1 << 61) - 1)).alias("body"))


@query("s2_center", f"""WITH {FACE}, p AS (SELECT gid, face, (i+0.5)/4096 AS s, (j+0.5)/4096 AS t FROM k), w AS (SELECT gid, face, CASE WHEN s >= 0.5 THEN (4*s*s-1)/3 ELSE (1-4*(1-s)*(1-s))/3 END AS u, CASE WHEN t >= 0.5 THEN (4*t*t-1)/3 ELSE (1-4*(1-t)*(1-t))/3 END AS v FROM p),
z AS (SELECT gid, CASE face WHEN 0 THEN 1 WHEN 1 THEN -u WHEN 2 THEN -u WHEN 3 THEN -1 ELSE u END AS x, CASE face WHEN 0 THEN u WHEN 1 THEN 1 WHEN 2 THEN -v WHEN 3 THEN -u WHEN 4 THEN -1 ELSE v END AS y, CASE face WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN 1 WHEN 3 THEN -v WHEN 4 THEN -v ELSE -1 END AS z FROM w)
SELECT gid, round(degrees(atan2(z, sqrt(x*x+y*y))), 7) AS lat, round(degrees(atan2(y, x)), 7) AS lon FROM z""")
def s2_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s2.with_center(celled(spark, sf_dir).select("gid", "cell"))
    return found.select("gid", r(F.col("lat"), 7).alias("lat"), r(F.col("lon"), 7).alias("lon"))


@query("s2_token", f"WITH {FACE} SELECT gid, {TOKEN} AS token, true AS back FROM m")
def s2_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = s2.token(F.col("cell"))
    return celled(spark, sf_dir).select("gid", t.alias("token"), (s2.from_token(t) == F.col("cell")).alias("back"))


@query("quadkey", "WITH i AS (SELECT point_id, CAST(floor((x+1000)/2000*32) AS BIGINT) AS i, CAST(floor((y+1000)/2000*32) AS BIGINT) AS j FROM pts) SELECT point_id, (SELECT string_agg(CAST(((i >> b) & 1) + 2*((j >> b) & 1) AS VARCHAR), '' ORDER BY b DESC) FROM range(5) t(b)) AS key FROM i")
def quadkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pts").select("point_id", s2.quadkey(F.col("x"), F.col("y"), (-1000.0, -1000.0, 1000.0, 1000.0), 5).alias("key"))


#: Centres of all cells of level 7, by face and place.
CENTRES = """c AS (SELECT f, (i+0.5)/128 AS s, (j+0.5)/128 AS t FROM range(6) a(f) CROSS JOIN range(128) b(i) CROSS JOIN range(128) d(j)),
 w AS (SELECT f, CASE WHEN s >= 0.5 THEN (4*s*s-1)/3 ELSE (1-4*(1-s)*(1-s))/3 END AS u, CASE WHEN t >= 0.5 THEN (4*t*t-1)/3 ELSE (1-4*(1-t)*(1-t))/3 END AS v FROM c),
 a AS (SELECT CASE f WHEN 0 THEN 1 WHEN 1 THEN -u WHEN 2 THEN -u WHEN 3 THEN -1 WHEN 4 THEN u ELSE u END AS x, CASE f WHEN 0 THEN u WHEN 1 THEN 1 WHEN 2 THEN -v WHEN 3 THEN -u WHEN 4 THEN -1 ELSE v END AS y, CASE f WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN 1 WHEN 3 THEN -v WHEN 4 THEN -v ELSE -1 END AS z FROM w),
 l AS (SELECT degrees(atan2(z, sqrt(x*x+y*y))) AS lat, degrees(atan2(y, x)) AS lon FROM a)"""
#: Zones as polygons in degrees.
WIDE, TALL = 10.0, 12.5


@query("s2_cover", f"""WITH {CENTRES}, n AS (SELECT z.zone_id, l.lat, l.lon FROM zones z JOIN l ON l.lon BETWEEN (z.cx-z.h)/{WIDE} AND (z.cx+z.h)/{WIDE} AND l.lat BETWEEN (z.cy-z.h)/{TALL} AND (z.cy+z.h)/{TALL}),
 r AS (SELECT n.zone_id, n.lat, n.lon, e.ring, sum(CASE WHEN (e.y1/{TALL} > n.lat) <> (e.y2/{TALL} > n.lat) AND n.lon < (e.x1-e.x2)/{WIDE}*(n.lat-e.y2/{TALL})/nullif((e.y1-e.y2)/{TALL}, 0)+e.x2/{WIDE} THEN 1 ELSE 0 END) % 2 AS ins FROM n JOIN zone_edges e USING (zone_id) GROUP BY 1, 2, 3, 4)
 SELECT zone_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM r GROUP BY r.zone_id, r.lat, r.lon HAVING max(CASE WHEN ring = 0 THEN ins ELSE 0 END) = 1 AND max(CASE WHEN ring > 0 THEN ins ELSE 0 END) = 0""")
def s2_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of the cells of level 7 in every zone, in degrees."""
    turned = F.transform("polygon", lambda ring: F.transform(ring, lambda p: planar.point(p["x"] / WIDE, p["y"] / TALL)))
    cells = s2.cover(polygons(spark, sf_dir).select("zone_id", turned.alias("polygon")), 7)
    return s2.with_center(cells).select("zone_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("s2_neighbours", "SELECT gid, 4 AS n, true AS back FROM geopts")
def s2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four cells beside every position's cell: how many they are, and whether a step from each returns to it."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (0, 1), (-1, 0), (0, -1))])).alias("s")
    start = view(spark, sf_dir, "geopts").select("gid", s2.cell_at(F.col("lat"), F.col("lon"), 12).alias("c"))
    beside = start.select("gid", "c", steps).select("gid", "c", s2.neighbour(F.col("c"), F.col("s.i"), F.col("s.j")).alias("n"))
    again = beside.select("gid", "c", "n", steps).select("gid", "c", "n", s2.neighbour(F.col("n"), F.col("s.i"), F.col("s.j")).alias("back"))
    met = again.groupBy("gid", "c", "n").agg(F.max(F.col("back") == F.col("c")).alias("back"))
    return met.where("n <> c").groupBy("gid").agg(F.count("*").cast("int").alias("n"), F.min("back").alias("back"))
