"""GeoTIFF: files made by hand in every layout, mosaics, windows that read only their chunks."""

import http.server
import struct
import threading
import zlib

import numpy as np
import pyarrow as pa
import pytest

from meridian.raster.band import BandMeta, GeoTransform
from meridian.sources import geotiff as T


def tiff(grid, order="<", big=False, compression=1, predictor=1, rows=3, planar=1, extra=()):
    """A stripped file of a (height, width, bands) array."""
    h, w, n = grid.shape
    planes = [grid[:, :, b : b + 1] for b in range(n)] if planar == 2 else [grid]
    chunks = []
    for p in planes:
        for y in range(0, h, rows):
            part = p[y : y + rows]
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
            raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
            if predictor == 3:
                lines = np.ascontiguousarray(part.reshape(len(part), -1).astype(part.dtype.newbyteorder(">"))).view(np.uint8).reshape(len(part), -1, part.dtype.itemsize).transpose(0, 2, 1).reshape(len(part), -1, part.shape[2])
                raw = np.diff(lines, axis=1, prepend=np.zeros_like(lines[:, :1])).astype(np.uint8).tobytes()
            if compression == 8:
                raw = zlib.compress(raw)
            elif compression == 50000:
                raw = pa.compress(raw, codec="zstd", asbytes=True)
            elif compression == 32773:
                raw = b"".join(struct.pack("B", len(raw[k : k + 100]) - 1) + raw[k : k + 100] for k in range(0, len(raw), 100))
            elif compression == 5:
                bits = "".join(f"{256:09b}" + "".join(f"{b:09b}" for b in raw[k : k + 200]) for k in range(0, len(raw), 200)) + f"{257:09b}"
                raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
            chunks.append(raw)
    kind = {"u": 1, "i": 2, "f": 3}[grid.dtype.kind]
    word = "Q" if big else "I"
    tags = [(256, "H", [w]), (257, "H", [h]), (258, "H", [8 * grid.dtype.itemsize] * n), (259, "H", [compression]), (277, "H", [n]), (278, "H", [rows]), (284, "H", [planar]), (317, "H", [predictor]), (339, "H", [kind] * n), (273, word, [0] * len(chunks)), (279, word, list(map(len, chunks))), *extra]
    head = order.replace("<", "II").replace(">", "MM").encode() + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    entry, inline, codes = (20, 8, {"H": 3, "I": 4, "Q": 16, "d": 12, "s": 2}) if big else (12, 4, {"H": 3, "I": 4, "d": 12, "s": 2})
    start = len(head) + (8 if big else 2) + entry * len(tags) + inline
    body = lambda f, v: v if f == "s" else struct.pack(f"{order}{len(v)}{f}", *v)
    at = start + sum(len(body(f, v)) for _, f, v in tags if len(body(f, v)) > inline)
    offsets = np.cumsum([at, *map(len, chunks)])[:-1].tolist()
    directory, data = struct.pack(order + ("Q" if big else "H"), len(tags)), b""
    for tag, f, v in tags:
        raw = body(f, offsets if tag == 273 else v)
        directory += struct.pack(order + "HH" + word, tag, codes[f], len(v)) + (raw.ljust(inline, b"\0") if len(raw) <= inline else struct.pack(order + word, start + len(data)))
        data += raw if len(raw) > inline else b""
    return head + directory + bytes(inline) + data + b"".join(chunks)


def read(spark, path, **options):
    return {(r.x, r.y): r.v for r in T.read_geotiff(spark, str(path), **options).collect()}


LAYOUTS = [("u1", {}), ("u2", {"order": ">", "compression": 8, "predictor": 2}), ("i2", {"big": True, "compression": 50000}), ("i4", {"planar": 2, "compression": 32773}), ("u4", {"order": ">", "big": True}), ("f4", {"compression": 8, "predictor": 3}), ("f8", {"predictor": 3, "order": ">"}), ("u1", {"compression": 5, "predictor": 2})]


def test_files_in_every_layout(spark, tmp_path):
    rng = np.random.default_rng(7)
    want = {}
    for k, (kind, options) in enumerate(LAYOUTS):
        grid = rng.integers(0, 120, (8, 5, 2)).astype(kind)
        grid = grid + np.array(0.25, kind) if kind[0] == "f" else grid
        (tmp_path / f"{k}.tif").write_bytes(tiff(grid, **options))
        for b in (0, 1):
            want[k, b] = {(x, y): float(grid[y, x, b]) for y in range(8) for x in range(5)}
    for b in (0, 1):
        got = {}
        for r in T.read_geotiff(spark, str(tmp_path), band=b).collect():
            got.setdefault((int(r.path.rsplit("/", 1)[1][:-4]), b), {})[r.x, r.y] = r.v
        assert got == {key: cells for key, cells in want.items() if key[1] == b}
    found = {int(r.path.rsplit("/", 1)[1][:-4]): (r.cell_type, r.bands, r.width, r.height) for r in T.layouts(spark, str(tmp_path)).collect()}
    assert found == {k: ({"u1": "u8", "u2": "u16", "i2": "i16", "i4": "i32", "u4": "u32", "f4": "f32", "f8": "f64"}[kind], 2, 5, 8) for k, (kind, _) in enumerate(LAYOUTS)}
    with pytest.raises(Exception, match="no band 2"):
        read(spark, tmp_path / "0.tif", band=2)


def test_georeferences(spark, tmp_path):
    grid = np.zeros((2, 2, 1), "u1")
    keys = lambda kind, point: (34735, "H", [1, 1, 0, 2, kind[0], 0, 1, kind[1], 1025, 0, 1, point])
    tie = [(33550, "d", [2.0, 3.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 100.0, 50.0, 0.0])]
    (tmp_path / "a.tif").write_bytes(tiff(grid, extra=[*tie, keys((3072, 32633), 1), (42113, "s", b"-9999\0")]))
    (tmp_path / "b.tif").write_bytes(tiff(grid, extra=[*tie, keys((2048, 4326), 2)]))
    (tmp_path / "c.tif").write_bytes(tiff(grid, extra=[(34264, "d", [2.0, 0, 0, 10.0, 0, -3.0, 0, 20.0, 0, 0, 0, 0, 0, 0, 0, 1.0])]))
    (tmp_path / "d.tif").write_bytes(tiff(grid))
    got = {r.path[-5]: T.meta_of(r) for r in T.layouts(spark, str(tmp_path)).collect()}
    assert got["a"] == BandMeta(2, 2, "u8", -9999.0, GeoTransform(100.0, 50.0, 2.0, 3.0), 32633)
    assert got["b"] == BandMeta(2, 2, "u8", None, GeoTransform(99.0, 51.5, 2.0, 3.0), 4326)
    assert got["c"].transform == GeoTransform(10.0, 20.0, 2.0, 3.0) and got["d"].transform == GeoTransform()


@pytest.mark.parametrize("deflate", [True, False])
def test_mosaic_and_back(spark, tmp_path, deflate):
    meta = BandMeta(50, 35, "f32", -1.0, GeoTransform(10.0, 90.0, 0.5, 0.25), 4326)
    value = {(x, y): float(x * 100 + y) for x in range(50) for y in range(35) if (x + y) % 7}
    cells = spark.createDataFrame([(x, y, v) for (x, y), v in value.items()], "x int, y int, v double")
    files = T.write_mosaic(cells, meta, str(tmp_path), block=32, tile=16, deflate=deflate).collect()
    assert {r.file for r in files} == {"0-0.tif", "32-0.tif", "0-32.tif", "32-32.tif"}
    back = {}
    for r in T.layouts(spark, str(tmp_path)).collect():
        m = T.meta_of(r)
        assert (m.cell_type, m.nodata, m.epsg) == ("f32", -1.0, 4326)
        dx, dy = round((m.transform.origin_x - 10) / 0.5), round((90 - m.transform.origin_y) / 0.25)
        back |= {(x + dx, y + dy): v for (x, y), v in read(spark, r.path).items()}
    assert back == {(x, y): value.get((x, y), -1.0) for x in range(50) for y in range(35)}
    one = str(tmp_path / "0-0.tif")
    assert read(spark, one, region=(14, 3, 18, 100)) == {(x, y): v for (x, y), v in read(spark, one).items() if 14 <= x < 18 and 3 <= y}
    with pytest.raises(ValueError):
        read(spark, one, region=(5, 5, 5, 9))


def test_damaged_files(spark, tmp_path):
    with pytest.raises(ValueError):
        list(T.images(lambda a, n: b"not a tiff at all"[a : a + n]))
    loop = b"II*\0" + struct.pack("<I", 8) + struct.pack("<HI", 0, 8)
    with pytest.raises(ValueError, match="end"):
        list(T.images(lambda a, n: loop[a : a + n]))
    for raw, compression in ((zlib.compress(b"x" * 5), 8), (b"abc", 1), (b"\xff\xff\xff", 5), (b"", 32773)):
        with pytest.raises(ValueError):
            T.decompress(raw, compression, 10)
    assert T.decompress(zlib.compress(bytes(10**6)), 8, 10) == bytes(10)
    assert T.unpack_bits(b"\xfea\x01bc\x80", 9) == b"aaabc"


def test_remote_window_reads_few_ranges(spark):
    grid = np.arange(64 * 64, dtype="f4").reshape(64, 64)
    content, asked = T.encode(grid.astype(float), BandMeta(64, 64, "f32"), tile=16, deflate=False), []

    class Ranges(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            start, end = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            asked.append(end + 1 - start)
            self.send_response(206)
            self.end_headers()
            self.wfile.write(content[start : end + 1])

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/a.tif"
    found = T.layouts(spark, [url])
    got = {(r.x, r.y): r.v for r in T.read_cells(found, region=(17, 20, 31, 30)).collect()}
    server.shutdown()
    assert got == {(x, y): float(grid[y, x]) for x in range(17, 31) for y in range(20, 30)}
    assert asked.count(16 * 16 * 4) == 1 and sum(asked) < len(content) / 4


def test_lzw_codes_grow():
    """Against a plain encoder whose codes grow up to twelve bits, with the early change and a full table."""
    rng = np.random.default_rng(3)
    data = bytes(rng.integers(0, 6, 40_000, dtype=np.uint8)) + bytes(rng.integers(0, 256, 9_000, dtype=np.uint8))
    bits, table, width, held = [f"{256:09b}"], {bytes([k]): k for k in range(256)}, 9, b""
    for b in data:
        if held + bytes([b]) in table:
            held += bytes([b])
            continue
        bits.append(f"{table[held]:0{width}b}")
        table[held + bytes([b])] = len(table) + 2
        held = bytes([b])
        n = len(table) + 2
        if n >= 4095:
            bits.append(f"{256:012b}")
            table, width = {bytes([k]): k for k in range(256)}, 9
        elif n >= 1 << width:
            width += 1
    text = "".join([*bits, f"{table[held]:0{width}b}", f"{257:0{width}b}"])
    raw = int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
    assert T.unpack_lzw(raw, len(data)) == data
