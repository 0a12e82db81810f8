"""Registered queries on coordinate systems.  Inverse projections are held against the point they started from."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.crs import ellipsoid as E
from meridian.crs import projections as P
from meridian.crs import registry

from .fixtures import view
from .planar_queries import polygons, query, r

FRANCE = "f AS (SELECT gid, lon/30 + 3 AS lon, lat/20 + 46.5 AS lat FROM geopts)"
STATES = "f AS (SELECT gid, lon/8 - 96 AS lon, lat/8 + 38 AS lat FROM geopts)"
BRITAIN = "f AS (SELECT gid, lon/60 - 2 AS lon, lat/25 + 54 AS lat FROM geopts)"


def near(spark: SparkSession, sf_dir: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return view(spark, sf_dir, "geopts").selectExpr("gid", f"{lon} AS lon", f"{lat} AS lat")


def out(df: DataFrame, x: Column, y: Column, digits: int = 3, names: tuple[str, str] = ("x", "y")) -> DataFrame:
    return df.select("gid", r(x, digits).alias(names[0]), r(y, digits).alias(names[1]))


def back(df: DataFrame, p) -> DataFrame:
    """There and back again."""
    x, y = p.forward(F.col("lat"), F.col("lon"))
    lat, lon = p.inverse(F.col("x"), F.col("y"))
    return df.withColumns({"x": x, "y": y}).select("gid", r(lat, 6).alias("lat"), r(lon, 6).alias("lon"))


@query("web_mercator_forward", "SELECT gid, round(6378137.0*radians(lon), 3) AS x, round(6378137.0*ln(tan(pi()/4 + radians(lat)/2)), 3) AS y FROM geopts")
def web_mercator_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(near(spark, sf_dir), *P.WebMercator().forward(F.col("lat"), F.col("lon")))


@query("web_mercator_inverse", "SELECT point_id, round(degrees(2*atan(exp(y*10000/6378137.0)) - pi()/2), 7) AS lat, round(degrees(x*15000/6378137.0), 7) AS lon FROM pts")
def web_mercator_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = P.WebMercator().inverse(F.col("x") * 15000, F.col("y") * 10000)
    return view(spark, sf_dir, "pts").select("point_id", r(lat, 7).alias("lat"), r(lon, 7).alias("lon"))


ZONE = "CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat < 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END ELSE CAST(floor((lon+180)/6) AS INT) + 1 END"


@query("utm_zone", f"SELECT gid, {ZONE} AS zone, {ZONE} + CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END AS epsg FROM geopts")
def utm_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = P.utm_zone(F.col("lat"), F.col("lon"))
    return near(spark, sf_dir).select("gid", zone.alias("zone"), P.utm_epsg(zone, F.col("lat") >= 0).alias("epsg"))


def tm_sql(source: str, e: E.Ellipsoid, lat0: float, lon0: str, k0: float, fe: float, fn: str) -> str:
    """The transverse Mercator series as SQL."""
    e2 = e.e2
    es = e2 / (1 - e2)
    c = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)
    p0 = math.radians(lat0)
    m0 = e.a * (c[0] * p0 - c[1] * math.sin(2 * p0) + c[2] * math.sin(4 * p0) - c[3] * math.sin(6 * p0))
    return f"""{source}, s1 AS (SELECT gid, radians(lat) AS p, radians(lon - ({lon0}))*cos(radians(lat)) AS a, {fn} AS fn FROM f),
s2 AS (SELECT *, {e.a!r}/sqrt(1-{e2!r}*sin(p)*sin(p)) AS n, power(tan(p), 2) AS t, {es!r}*power(cos(p), 2) AS c, {e.a!r}*({c[0]!r}*p-{c[1]!r}*sin(2*p)+{c[2]!r}*sin(4*p)-{c[3]!r}*sin(6*p)) AS m FROM s1)
SELECT gid, round({fe!r}+{k0!r}*n*(a+(1-t+c)*power(a,3)/6+(5-18*t+t*t+72*c-58*{es!r})*power(a,5)/120), 3) AS x,
round(fn+{k0!r}*(m-{m0!r}+n*tan(p)*(a*a/2+(5-t+9*c+4*c*c)*power(a,4)/24+(61-58*t+t*t+600*c-330*{es!r})*power(a,6)/720)), 3) AS y FROM s2"""


@query("utm_forward", "WITH " + tm_sql(f"f AS (SELECT gid, lon, lat, ({ZONE})*6.0-183 AS cm FROM geopts)", E.WGS84, 0.0, "cm", 0.9996, 500000.0, "CASE WHEN lat >= 0 THEN 0.0 ELSE 10000000.0 END"))
def utm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = P.utm_zone(F.col("lat"), F.col("lon"))
    return out(near(spark, sf_dir), *P.utm(zone, F.col("lat") >= 0).forward(F.col("lat"), F.col("lon")))


@query("utm_inverse", "SELECT gid, round(lat, 5) AS lat, round(abs(lon), 5) AS abs_lon FROM geopts")
def utm_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = near(spark, sf_dir).withColumns({"zone": P.utm_zone(F.col("lat"), F.col("lon")), "north": F.col("lat") >= 0})
    p = P.utm(F.col("zone"), F.col("north"))
    df = df.withColumns(dict(zip(("x", "y"), p.forward(F.col("lat"), F.col("lon")), strict=True)))
    lat, lon = p.inverse(F.col("x"), F.col("y"))
    return df.select("gid", r(lat, 5).alias("lat"), r(F.abs(lon), 5).alias("abs_lon"))  # -180 and 180 are one meridian


@query("tm_bng_forward", "WITH " + tm_sql(BRITAIN, E.AIRY, 49.0, "-2.0", 0.9996012717, 400000.0, "-100000.0"))
def tm_bng_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(near(spark, sf_dir, "lon/60 - 2", "lat/25 + 54"), *P.british_national_grid().forward(F.col("lat"), F.col("lon")))


def _lcc_sql() -> str:
    p, ecc = P.lambert93(), math.sqrt(E.GRS80.e2)
    return f"WITH {FRANCE}, s AS (SELECT gid, {p.af!r}*power(tan(pi()/4-radians(lat)/2)/power((1-{ecc!r}*sin(radians(lat)))/(1+{ecc!r}*sin(radians(lat))), {ecc / 2!r}), {p.n!r}) AS rho, {p.n!r}*radians(lon-3) AS th FROM f) SELECT gid, round(700000.0+rho*sin(th), 3) AS x, round(6600000.0+{p.rho0!r}-rho*cos(th), 3) AS y FROM s"


@query("lambert93_forward", _lcc_sql())
def lambert93_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(near(spark, sf_dir, "lon/30 + 3", "lat/20 + 46.5"), *P.lambert93().forward(F.col("lat"), F.col("lon")))


@query("lambert93_inverse", f"WITH {FRANCE} SELECT gid, round(lat, 6) AS lat, round(lon, 6) AS lon FROM f")
def lambert93_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return back(near(spark, sf_dir, "lon/30 + 3", "lat/20 + 46.5"), P.lambert93())


def _albers_sql() -> str:
    p, e2 = P.conus_albers(), E.GRS80.e2
    ecc = math.sqrt(e2)
    q = f"(1-{e2!r})*(sin(radians(lat))/(1-{e2!r}*power(sin(radians(lat)),2))-ln((1-{ecc!r}*sin(radians(lat)))/(1+{ecc!r}*sin(radians(lat))))/(2*{ecc!r}))"
    return f"WITH {STATES}, s AS (SELECT gid, {E.GRS80.a!r}*sqrt({p.c!r}-{p.n!r}*{q})/{p.n!r} AS rho, {p.n!r}*radians(lon+96) AS th FROM f) SELECT gid, round(rho*sin(th), 3) AS x, round({p.rho0!r}-rho*cos(th), 3) AS y FROM s"


@query("albers_forward", _albers_sql())
def albers_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(near(spark, sf_dir, "lon/8 - 96", "lat/8 + 38"), *P.conus_albers().forward(F.col("lat"), F.col("lon")))


@query("albers_inverse", f"WITH {STATES} SELECT gid, round(lat, 6) AS lat, round(lon, 6) AS lon FROM f")
def albers_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return back(near(spark, sf_dir, "lon/8 - 96", "lat/8 + 38"), P.conus_albers())


def _scale_sql() -> str:
    p, ecc = P.lambert93(), math.sqrt(E.GRS80.e2)
    return f"WITH {FRANCE}, s AS (SELECT gid, radians(lat) AS p, {p.af!r}*power(tan(pi()/4-radians(lat)/2)/power((1-{ecc!r}*sin(radians(lat)))/(1+{ecc!r}*sin(radians(lat))), {ecc / 2!r}), {p.n!r}) AS rho FROM f) SELECT gid, round({p.n!r}*rho*sqrt(1-{E.GRS80.e2!r}*sin(p)*sin(p))/({E.GRS80.a!r}*cos(p)), 8) AS k FROM s"


@query("parallel_scale", _scale_sql())
def parallel_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark, sf_dir, "lon/30 + 3", "lat/20 + 46.5").select("gid", r(P.lambert93().parallel_scale(F.col("lat")), 8).alias("k"))


ECEF = f"c AS (SELECT gid, lat, lon, {E.WGS84.a!r}/sqrt(1-{E.WGS84.e2!r}*power(sin(radians(lat)),2)) AS n, CAST(gid % 5000 AS DOUBLE) AS h FROM geopts), g AS (SELECT gid, lat, lon, h, (n+h)*cos(radians(lat))*cos(radians(lon)) AS x, (n+h)*cos(radians(lat))*sin(radians(lon)) AS y, (n*(1-{E.WGS84.e2!r})+h)*sin(radians(lat)) AS z FROM c)"


def ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = near(spark, sf_dir).withColumn("h", (F.col("gid") % 5000).cast("double"))
    x, y, z = E.to_geocentric(E.WGS84, F.col("lat"), F.col("lon"), F.col("h"))
    return df.withColumns({"x": x, "y": y, "z": z})


@query("ecef_forward", f"WITH {ECEF} SELECT gid, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM g")
def ecef_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ecef(spark, sf_dir).select("gid", *[r(F.col(c), 3).alias(c) for c in "xyz"])


@query("ecef_inverse", f"WITH {ECEF} SELECT gid, round(lat, 7) AS lat, round(lon, 7) AS lon, round(h, 4) AS h FROM g")
def ecef_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon, h = E.to_geodetic(E.WGS84, F.col("x"), F.col("y"), F.col("z"))
    return ecef(spark, sf_dir).select("gid", r(lat, 7).alias("lat"), r(lon, 7).alias("lon"), r(h, 4).alias("h"))


def _helmert_sql() -> str:
    t = E.OSGB36_TO_WGS84
    m = 1 + t.s
    return f"WITH {ECEF} SELECT gid, round({t.tx!r}+{m!r}*(x-({t.rz!r})*y+({t.ry!r})*z), 3) AS tx, round({t.ty!r}+{m!r}*(({t.rz!r})*x+y-({t.rx!r})*z), 3) AS ty, round({t.tz!r}+{m!r}*(-({t.ry!r})*x+({t.rx!r})*y+z), 3) AS tz, round(x, 3) AS bx, round(y, 3) AS by_, round(z, 3) AS bz FROM g"


@query("helmert", _helmert_sql())
def helmert(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ecef(spark, sf_dir)
    there = E.helmert(E.OSGB36_TO_WGS84, F.col("x"), F.col("y"), F.col("z"))
    df = df.withColumns(dict(zip(("tx", "ty", "tz"), there, strict=True)))
    home = E.inverse_helmert(E.OSGB36_TO_WGS84, F.col("tx"), F.col("ty"), F.col("tz"))
    return df.select("gid", *[r(F.col(c), 3).alias(c) for c in ("tx", "ty", "tz")], *[r(c, 3).alias(n) for c, n in zip(home, ("bx", "by_", "bz"), strict=True)])


@query("osgb36_transform", f"WITH {BRITAIN} SELECT gid, round(lon, 5) AS lon, round(lat, 5) AS lat FROM f")
def osgb36_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the British National Grid and back: heights are dropped both ways, which moves nothing by a centimetre."""
    df = near(spark, sf_dir, "lon/60 - 2", "lat/25 + 54")
    e, n = registry.transform(4326, 27700, F.col("lon"), F.col("lat"))
    df = df.withColumns({"e": e, "n": n})
    lon, lat = registry.transform(27700, 4326, F.col("e"), F.col("n"))
    return df.select("gid", r(lon, 5).alias("lon"), r(lat, 5).alias("lat"))


@query("crs_transform_pairs", "WITH " + tm_sql("f AS (SELECT gid, lon/60 + 15 AS lon, lat/2 + 42 AS lat FROM geopts)", E.WGS84, 0.0, "15.0", 0.9996, 500000.0, "0.0"))
def crs_transform_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = near(spark, sf_dir, "lon/60 + 15", "lat/2 + 42")
    x, y = registry.from_geographic(3857, F.col("lat"), F.col("lon"))
    df = df.withColumns({"mx": x, "my": y})
    return out(df, *registry.transform(3857, 32633, F.col("mx"), F.col("my")))


def _enu_sql() -> str:
    p = P.LocalTangentPlane(48.0, 11.0)
    return f"SELECT gid, round(radians(((lon-11.0+180)%360+360)%360-180)*{p.east!r}, 3) AS east, round(radians(lat-48.0)*{p.north!r}, 3) AS north, round(lat, 7) AS lat, round(lon, 7) AS lon FROM geopts"


@query("enu_to_local", _enu_sql())
def enu_to_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = P.LocalTangentPlane(48.0, 11.0)
    x, y = plane.to_local(F.col("lat"), F.col("lon"))
    df = near(spark, sf_dir).withColumns({"x": x, "y": y})
    lat, lon = plane.to_geographic(F.col("x"), F.col("y"))
    return df.select("gid", r(F.col("x"), 3).alias("east"), r(F.col("y"), 3).alias("north"), r(lat, 7).alias("lat"), r(lon, 7).alias("lon"))


@query("epsg_lookup", "WITH e AS (SELECT gid, CASE gid % 8 WHEN 0 THEN 4326 WHEN 1 THEN 3857 WHEN 2 THEN 2154 WHEN 3 THEN 5070 WHEN 4 THEN 27700 WHEN 5 THEN 32600 + gid % 70 WHEN 6 THEN 32700 + gid % 70 ELSE gid END AS code FROM geopts) SELECT gid, CASE WHEN code = 4326 THEN 'WGS 84' WHEN code = 3857 THEN 'Web Mercator' WHEN code = 2154 THEN 'Lambert-93' WHEN code = 5070 THEN 'Conus Albers' WHEN code = 4277 THEN 'OSGB36' WHEN code = 27700 THEN 'British National Grid' WHEN code BETWEEN 32601 AND 32660 THEN 'UTM ' || CAST(code - 32600 AS VARCHAR) || 'N' WHEN code BETWEEN 32701 AND 32760 THEN 'UTM ' || CAST(code - 32700 AS VARCHAR) || 'S' END AS name FROM e")
def epsg_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr("CASE gid % 8 WHEN 0 THEN 4326 WHEN 1 THEN 3857 WHEN 2 THEN 2154 WHEN 3 THEN 5070 WHEN 4 THEN 27700 WHEN 5 THEN 32600 + gid % 70 WHEN 6 THEN 32700 + gid % 70 ELSE gid END")
    return near(spark, sf_dir).select("gid", registry.lookup(code).alias("name"))


@query("reproject_geometry", "SELECT zone_id, ring, k, round(6378137.0*radians(vx/10), 3) AS x, round(6378137.0*ln(tan(pi()/4 + radians(vy/20)/2)), 3) AS y FROM zone_vertices")
def reproject_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    degrees = F.transform("polygon", lambda ring: F.transform(ring, lambda p: F.struct((p["x"] / 10).alias("x"), (p["y"] / 20).alias("y"))))
    moved = polygons(spark, sf_dir).select("zone_id", registry.reproject(degrees, 4326, 3857, 2).alias("g"))
    rings = moved.select("zone_id", F.posexplode("g").alias("ring", "p")).select("zone_id", "ring", F.posexplode("p").alias("k", "v"))
    return rings.select("zone_id", "ring", "k", r(F.col("v.x"), 3).alias("x"), r(F.col("v.y"), 3).alias("y"))
