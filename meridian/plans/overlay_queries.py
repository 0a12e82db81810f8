"""Registered queries on overlays of polygons with holes and on geodesics, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.crs.ellipsoid import WGS84
from meridian.functions import buffers, geodesic, overlay, planar, strips

from .fixtures import view
from .planar_queries import STRIPS, polygons, query, r, zone_overlays


def _area(name: str, sql: str, operation: str) -> None:
    @query(name, f"WITH {STRIPS} SELECT left_id, right_id, round(CAST({sql} AS DOUBLE), 4) AS area FROM p")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = zone_overlays(spark, sf_dir, lambda a, b: strips.clip_area(a, b, operation), lambda a, b: overlay.clip_area(a, b, operation), "area")
        return found.withColumn("area", F.signum("area") * r(F.abs("area"), 4))  # keeps the sign of what rounds to zero, as the SQL does


_area("clip_common_area", "meet", "intersection")
_area("clip_union_area", "aa + ab - meet", "union")
_area("clip_difference_area", "aa - meet", "difference")
_area("clip_xor_area", "aa + ab - 2*meet", "symmetric_difference")


@query("rects_overlap", f"WITH {STRIPS} SELECT left_id, right_id, meet > 1e-9*(aa+ab) AND meet < aa - 1e-9*(aa+ab) AND meet < ab - 1e-9*(aa+ab) AS overlap, meet >= ab - 1e-9*(aa+ab) AS holds FROM p")
def rects_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    pairs = zone_overlays(spark, sf_dir, strips.areas, overlay.areas, "s")
    return pairs.select("left_id", "right_id", overlay.overlaps(s).alias("overlap"), overlay.contains(s).alias("holds"))


def _regular(sides: int, d: str) -> str:
    """Area of a regular polygon of circumradius ``d``."""
    return f"{sides / 2!r} * sin(2 * pi() / {sides}) * {d} * {d}"


# a convex shape gains its perimeter times d and, over all its corners, one whole disk; the sides of a hole each move in by d
@query("buffer_polygon_area", f"SELECT zone_id, round(CASE shape WHEN 2 THEN 2*h*h + 0.1*h*(2*h + 2*sqrt(5.0)*h) + disk ELSE 4*h*h + 0.8*h*h + disk - CASE WHEN shape = 1 THEN 0.64*h*h ELSE 0 END END, 4) AS area FROM (SELECT *, {_regular(32, '0.1*h')} AS disk FROM zones)")
def buffer_polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every zone grown by a tenth of its half width."""
    z = polygons(spark, sf_dir).join(view(spark, sf_dir, "zones").select("zone_id", "h"), "zone_id")
    return z.select("zone_id", r(planar.multipolygon_area(buffers.buffer_polygon(F.col("polygon"), F.col("h") * 0.1, 32)), 4).alias("area"))


@query("erode_polygon_area", "SELECT zone_id, round(CASE shape WHEN 2 THEN (2*h - 0.1*h*(1+sqrt(5.0)))*(2*h - 0.1*h*(1+sqrt(5.0)))/2 ELSE 3.24*h*h - CASE WHEN shape = 1 THEN h*h + 0.4*h*h + disk ELSE 0 END END, 4) AS area FROM (SELECT *, "
       + _regular(32, "0.1*h") + " AS disk FROM zones)")
def erode_polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every zone less all within a tenth of its half width of a ring; a hole grows."""
    z = polygons(spark, sf_dir).join(view(spark, sf_dir, "zones").select("zone_id", "h"), "zone_id")
    return z.select("zone_id", r(planar.multipolygon_area(buffers.buffer_polygon(F.col("polygon"), F.col("h") * -0.1, 32)), 4).alias("area"))


@query("buffer_line_area", f"SELECT point_id, round(2 * d * len + {_regular(16, 'd')}, 4) AS area FROM (SELECT *, 1 + point_id % 7 AS d, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS len FROM (SELECT p.point_id, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM pts p JOIN pts q ON q.point_id = p.point_id + 1))")
def buffer_line_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way from every position to the next one, widened."""
    p = view(spark, sf_dir, "pts")
    q = p.select((F.col("point_id") - 1).alias("point_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    line = F.array(planar.point(F.col("x"), F.col("y")), planar.point(F.col("x2"), F.col("y2")))
    return p.join(q, "point_id").select("point_id", r(planar.multipolygon_area(buffers.buffer_line(line, 1 + F.col("point_id") % 7, 16)), 4).alias("area"))


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each position with the next one."""
    a = view(spark, sf_dir, "geopts")
    b = a.select((F.col("gid") - 1).alias("gid"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, "gid")


def _inverse_sql(rounds: int = 15) -> str:
    """Vincenty's iteration: neighbouring positions are eight degrees of longitude apart, so that it settles for all."""
    f, a, b = WGS84.f, WGS84.a, WGS84.b
    head = f"""w AS (SELECT a.gid, a.lat, a.lon, b.lat AS lat2, b.lon AS lon2, atan((1-{f!r})*tan(radians(a.lat))) AS u1, atan((1-{f!r})*tan(radians(b.lat))) AS u2, radians((CASE WHEN b.lon-a.lon > 180 THEN -360 WHEN b.lon-a.lon < -180 THEN 360 ELSE 0 END) + b.lon - a.lon) AS l FROM geopts a JOIN geopts b ON b.gid = a.gid + 1),
l0 AS (SELECT *, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, l AS lam FROM w)"""
    spread = lambda k: f"""g{k} AS (SELECT *, c2*sin(lam) AS p, c1*s2-s1*c2*cos(lam) AS q, s1*s2+c1*c2*cos(lam) AS c FROM l{k}), h{k} AS (SELECT *, sqrt(p*p+q*q) AS s, c1*c2*sin(lam)/sqrt(p*p+q*q) AS sa FROM g{k}), k{k} AS (SELECT *, atan2(s, c) AS sigma, 1-sa*sa AS ca, c - 2*s1*s2/(1-sa*sa) AS m FROM h{k})"""
    steps = []
    for k in range(rounds):
        cc = f"({f!r}/16*ca*(4+{f!r}*(4-3*ca)))"
        steps.append(spread(k) + f""", l{k + 1} AS (SELECT gid, lat, lon, lat2, lon2, u1, u2, l, s1, c1, s2, c2, l+(1-{cc})*{f!r}*sa*(sigma+{cc}*s*(m+{cc}*c*(-1+2*m*m))) AS lam FROM k{k})""")
    u = f"(ca*{(a * a - b * b) / (b * b)!r})"
    end = spread(rounds) + f""", z AS (SELECT *, 1+{u}/16384*(4096+{u}*(-768+{u}*(320-175*{u}))) AS big, {u}/1024*(256+{u}*(-128+{u}*(74-47*{u}))) AS small FROM k{rounds})"""
    return f"""WITH {', '.join([head, *steps, end])} SELECT gid, round({b!r}*big*(sigma - small*s*(m+small/4*(c*(-1+2*m*m)-small/6*m*(-3+4*s*s)*(-3+4*m*m)))), 2) AS distance, round(((degrees(atan2(p, q)) + 360) % 360), 6) AS bearing FROM z"""


@query("geodesic_inverse", _inverse_sql())
def geodesic_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hops(spark, sf_dir).withColumn("g", geodesic.inverse(*[F.col(c) for c in ("lat", "lon", "lat2", "lon2")]))
    return found.select("gid", r(F.col("g.distance"), 2).alias("distance"), r(F.col("g.initial")).alias("bearing"))


def _back(lat: Column, lon: Column, to_lat: Column, to_lon: Column) -> list[Column]:
    return [r(to_lat - lat, 6).alias("dlat"), r(F.pmod(to_lon - lon + 180.0, F.lit(360.0)) - 180.0, 6).alias("dlon")]


@query("geodesic_direct", "SELECT a.gid, 0.0::DOUBLE AS dlat, 0.0::DOUBLE AS dlon FROM geopts a JOIN geopts b ON b.gid = a.gid + 1")
def geodesic_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each position by distance and bearing to the next one: what is left of the way."""
    found = hops(spark, sf_dir).withColumn("g", geodesic.inverse(*[F.col(c) for c in ("lat", "lon", "lat2", "lon2")]))
    found = found.withColumn("p", geodesic.direct(F.col("lat"), F.col("lon"), F.col("g.initial"), F.col("g.distance")))
    return found.select("gid", *[F.abs(c).alias(n) for c, n in zip(_back(F.col("p.lat"), F.col("p.lon"), F.col("lat2"), F.col("lon2")), ("dlat", "dlon"), strict=True)])


@query("geodesic_sample", "WITH w AS (SELECT a.gid, a.lat, a.lon, b.lat AS lat2, b.lon AS lon2 FROM geopts a JOIN geopts b ON b.gid = a.gid + 1) SELECT gid, 5 AS n, lat, lon, lat2, lon2, true AS even FROM w")
def geodesic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four equal parts of the way to the next position: number of points, first and last, and whether neighbours are a quarter of the way apart."""
    ends = [F.col(c) for c in ("lat", "lon", "lat2", "lon2")]
    s = hops(spark, sf_dir).withColumn("s", geodesic.sample(*ends, 4)).withColumn("d", geodesic.inverse(*ends)["distance"])
    p = lambda k, c: F.get("s", F.lit(k))[c]
    apart = [geodesic.inverse(p(k, "lat"), p(k, "lon"), p(k + 1, "lat"), p(k + 1, "lon"))["distance"] for k in range(4)]
    even = F.greatest(*[F.abs(4 * a - F.col("d")) for a in apart]) < 1e-5
    return s.select("gid", F.size("s").alias("n"), F.round(p(0, "lat"), 9).alias("lat"), F.round(p(0, "lon"), 9).alias("lon"), p(4, "lat").alias("lat2"), p(4, "lon").alias("lon2"), even.alias("even"))


_E = WGS84.e2**0.5
#: Area between the equator and a latitude, for a longitude of one radian.
_ZONE = f"{WGS84.b**2 / 2!r} * (sin(radians(lat)) / (1 - {WGS84.e2!r} * sin(radians(lat)) * sin(radians(lat))) + atanh({_E!r} * sin(radians(lat))) / {_E!r})"


@query("geodesic_polygon", f"SELECT gid, round({_ZONE} * radians(w) / 1e6, 3) AS area FROM (SELECT gid, abs(lat) AS lat, 0.02 + 0.01 * (gid % 5) AS w FROM geopts)")
def geodesic_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every position a strip down to the equator, in square kilometres.

    Its upper edge has 100 parts, so that geodesics and the parallel that the SQL integrates under agree to a square metre.
    """
    p = view(spark, sf_dir, "geopts").withColumn("w", 0.02 + 0.01 * (F.col("gid") % 5))
    steps = F.sequence(F.lit(0), F.lit(100))
    at = lambda lon, lat: planar.point(lon, lat)
    top = F.transform(steps, lambda k: at(F.col("lon") + F.col("w") * (100 - k) / 100, F.col("lat")))
    ring = F.concat(F.array(at(F.col("lon"), F.lit(0.0)), at(F.col("lon") + F.col("w"), F.lit(0.0))), top)
    return p.select("gid", r(F.abs(geodesic.polygon_measure(ring)["area"]) / 1e6, 3).alias("area"))
