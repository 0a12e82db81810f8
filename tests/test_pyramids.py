"""Several bands, overviews, pyramids of mosaics and reports on layouts, read back by chunks."""

import http.server
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.raster.band import BandMeta, GeoTransform
from meridian.sources import files, geotiff

META = BandMeta(300, 200, "u8", 0.0, GeoTransform(10.0, 90.0, 0.5, 0.25), 3857)


def band(k, w=300, h=200):
    y, x = np.mgrid[0:h, 0:w]
    return ((x + 2 * y + 50 * k) % 256).astype(float)


def grid(rows, w, h):
    out = np.full((h, w), -1.0)
    for r in rows:
        out[r.y, r.x] = r.v
    return out


def plain_half(a, nodata):
    h, w = a.shape
    out = np.zeros(((h + 1) // 2, (w + 1) // 2))
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            v = [c for c in a[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].ravel() if c != nodata and not np.isnan(c)]
            out[y, x] = sum(v) / len(v) if v else (0 if nodata is None else nodata)
    return out


def test_halves_are_averages_of_valid_cells():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 4, (2, 7, 9)).astype(float)
    a[0, 2, 3] = np.nan
    for nodata in (None, 0.0, 3.0):
        for k in (0, 1):
            assert np.allclose(geotiff.halved(a, nodata)[k], plain_half(a[k], nodata))


@pytest.mark.parametrize("deflate", [True, False])
def test_bands_and_overviews_by_chunks(spark, tmp_path, deflate):
    cells = np.stack([band(k) for k in range(3)])
    (tmp_path / "cog.tif").write_bytes(geotiff.encode(cells, META, 64, deflate, overviews=3))
    (tmp_path / "plain.tif").write_bytes(geotiff.encode(cells[0], META, 64, deflate))
    found = geotiff.layouts(spark, str(tmp_path)).where(F.col("path").endswith("cog.tif")).cache()
    assert [(r.width, r.height, r.bands, r.tiled, r.cell_width) for r in found.orderBy("image").collect()] == [(300, 200, 3, True, 0.5), (150, 100, 3, True, 1.0), (75, 50, 3, True, 2.0), (38, 25, 3, True, 0.5 * 300 / 38)]
    level = cells
    for image in range(3):
        for b in range(3):
            got = grid(geotiff.read_cells(found, image, b).collect(), level.shape[2], level.shape[1])
            assert np.array_equal(got, np.rint(level[b]))
        level = geotiff.halved(level, 0.0)
    window = geotiff.read_cells(found, 0, 1, (100, 60, 170, 130)).collect()
    assert len(window) == 4900 and all(r.v == cells[1, r.y, r.x] for r in window)
    lengths = files.lengths(spark, [r.path for r in found.select("path").distinct().collect()])
    assert geotiff.check_layouts(found, lengths).count() == 0


def test_reports_on_layouts(spark, tmp_path):
    whole = geotiff.encode(np.zeros((600, 600)), BandMeta(600, 600, "u8", None, GeoTransform(), None), 256, False)
    (tmp_path / "cut.tif").write_bytes(whole[:-100])
    (tmp_path / "large.tif").write_bytes(whole)
    (tmp_path / "cog.tif").write_bytes(geotiff.encode(np.zeros((600, 600)), META, 256, True, 1))
    found = geotiff.layouts(spark, str(tmp_path))
    report = geotiff.check_layouts(found, files.listing(spark, str(tmp_path), ".tif"))
    got = sorted((r.path.rsplit("/", 1)[-1], r.image, r.problem, r.error) for r in report.collect())
    assert got == [("cut.tif", 0, "data out of range", True), ("cut.tif", 0, "no overviews", False), ("large.tif", 0, "no overviews", False)]
    striped = found.where(F.col("path").endswith("large.tif")).withColumns({"tiled": F.lit(False), "georeferenced": F.lit(False)})
    assert {r.problem for r in geotiff.check_layouts(striped, files.listing(spark, str(tmp_path), ".tif")).collect()} == {"not tiled", "no georeference", "no overviews"}
    mixed = found.where(F.col("path").endswith("large.tif")).withColumn("offsets", F.reverse("offsets"))
    assert "tiles not in order" in {r.problem for r in geotiff.check_layouts(mixed, files.listing(spark, str(tmp_path), ".tif")).collect()}


def test_mosaics_of_bands_and_pyramids(spark, tmp_path):
    two = [(x, y, k, float((x * y + 7 * k) % 250 + 1)) for x in range(100) for y in range(70) for k in (0, 1)]
    meta = BandMeta(100, 70, "u8", 0.0, GeoTransform(0.0, 70.0, 1.0, 1.0), 3857)
    cells = spark.createDataFrame(two, "x int, y int, band int, v double")
    assert geotiff.write_mosaic(cells, meta, str(tmp_path / "two"), 64, 32, True, 2, 1).count() == 4
    found = geotiff.layouts(spark, str(tmp_path / "two"))
    assert {(r.bands, r.image) for r in found.collect()} == {(2, 0), (2, 1)}
    block = grid(geotiff.read_cells(found.where(F.col("path").endswith("/64-64.tif")), 0, 1).collect(), 36, 6)
    assert all(block[y - 64, x - 64] == v for x, y, k, v in two if k == 1 and x >= 64 and y >= 64)
    made = geotiff.write_pyramid(cells.where("band = 0"), meta, str(tmp_path / "levels"), 32, 16)
    assert {r.level: r.n for r in made.groupBy("level").agg(F.count("*").alias("n")).collect()} == {0: 12, 1: 4, 2: 1}
    level = np.zeros((70, 100))
    for x, y, k, v in two:
        if k == 0:
            level[y, x] = v
    for _ in range(2):
        level = plain_half(level, 0.0)
    top = grid(geotiff.read_geotiff(spark, str(tmp_path / "levels" / "2")).collect(), 25, 18)
    assert np.abs(top - level).max() <= 1  # whole numbers at each level
    with pytest.raises(ValueError):
        geotiff.encode(np.zeros((4, 4)), meta, 100)


class Ranges(http.server.BaseHTTPRequestHandler):
    content = b""

    def do_GET(self):  # noqa: N802
        if self.headers.get("X-Key") != "open":
            self.send_error(403)
            return
        first, last = (int(v) for v in self.headers["Range"].removeprefix("bytes=").split("-"))
        part = self.content[first : last + 1]
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {first}-{first + len(part) - 1}/{len(self.content)}")
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *args):
        pass


def test_remote_files_with_headers_and_an_own_transport(spark):
    Ranges.content = geotiff.encode(band(0), META, 64, True, 1)
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        address = f"http://127.0.0.1:{server.server_port}/x.tif"
        keyed = files.with_headers({"X-Key": "open"})
        rows = geotiff.read_geotiff(spark, [address], 0, 0, (10, 20, 30, 40), keyed).collect()
        assert len(rows) == 400 and all(r.v == band(0)[r.y, r.x] for r in rows)
        assert files.lengths(spark, [address], {"X-Key": "open"}).first().length == len(Ranges.content)
        with pytest.raises(Exception, match="403"):
            geotiff.layouts(spark, [address]).collect()
        content = Ranges.content
        own = geotiff.read_geotiff(spark, ["memory"], 1, transport=lambda path, start, length: content[start : start + length])
        assert own.count() == 150 * 100
    finally:
        server.shutdown()
