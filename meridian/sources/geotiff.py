"""GeoTIFF and BigTIFF: layouts of images, cells of any window by chunks read in parallel, and mosaics of tiled files.

A chunk is a strip or a tile.  Layouts come from the headers alone; a window picks its chunks before
anything of them is read, and every chunk is one piece of work: a byte range and its cells.
"""

from __future__ import annotations

import functools
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.raster.band import BandMeta, GeoTransform, downsample

from .files import Transport, listing, opened, read_range

# Bytes of the field types, codes of tags, sample types.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
NUMBERS = {1: "u1", 3: "u2", 4: "u4", 6: "i1", 7: "u1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, TRANSFORMATION, GEO_KEYS, NODATA, SUBFILE, SUBIMAGES = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113, 254, 330
RASTER_TYPE, GEOGRAPHIC, PROJECTED = 1025, 2048, 3072
CELLS = {(8, 1): "u8", (8, 2): "u8", (8, 3): "u8", (16, 1): "u16", (16, 2): "i16", (32, 1): "u32", (32, 2): "i32", (32, 3): "f32", (64, 3): "f64"}
DTYPES = {"u8": "u1", "u16": "u2", "i16": "i2", "u32": "u4", "i32": "i4", "f32": "f4", "f64": "f8"}
#: More images than this in one file are taken for a damaged chain.
MAX_IMAGES = 4096
LAYOUT = "path string, image int, order string, width int, height int, bands int, cell_type string, tiled boolean, chunk_width int, chunk_height int, compression int, predictor int, planar int, nodata double, epsg int, origin_x double, origin_y double, cell_width double, cell_height double, georeferenced boolean, offsets array<long>, sizes array<long>"


def images(fetch) -> Iterator[tuple[str, dict]]:
    """(byte order, tags) of every image, those of the chain and then the images within them; ``fetch(start, length)`` gives bytes."""
    head = fetch(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(order + "H", head, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at, seen = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0], set()
    count, entry, inline, link = ("Q", 20, 8, "Q") if big else ("H", 12, 4, "I")
    width = struct.calcsize("<" + count)
    inner: list[int] = []
    while at or inner:
        at = at or inner.pop(0)
        if at in seen or len(seen) >= MAX_IMAGES:
            raise ValueError("the chain of images doesn't end")
        seen.add(at)
        n = struct.unpack(order + count, fetch(at, width))[0]
        raw = fetch(at + width, n * entry + struct.calcsize("<" + link))
        tags = {}
        for k in range(n):
            tag, kind = struct.unpack_from(order + "HH", raw, k * entry)
            items = struct.unpack_from(order + link, raw, k * entry + 4)[0]
            size = SIZES.get(kind, 0) * items
            place = k * entry + entry - inline
            value = raw[place : place + size] if size <= inline else fetch(struct.unpack_from(order + link, raw, place)[0], size)
            if len(value) < size:
                raise ValueError("a tag is cut short")
            tags[tag] = np.frombuffer(value, order + NUMBERS[kind]) if kind in NUMBERS else value
        yield order, tags
        inner += [int(v) for v in tags.get(SUBIMAGES, ())]
        at = struct.unpack_from(order + link, raw, n * entry)[0]


def georeference(tags: dict) -> tuple[GeoTransform | None, int | None]:
    """Transform and EPSG code; where cells stand for their centres, the origin is half a cell up and left of them."""
    keys = tags.get(GEO_KEYS, np.empty(0, "u2")).reshape(-1)
    keys = keys[4 : len(keys) // 4 * 4].reshape(-1, 4).tolist()
    epsg, half = None, 0.0
    for key, location, _, value in keys:
        if key in (GEOGRAPHIC, PROJECTED) and location == 0 and value:
            epsg = value
        if key == RASTER_TYPE and location == 0:
            half = 0.5 if value == 2 else 0.0
    if TRANSFORMATION in tags:
        m = tags[TRANSFORMATION].tolist()
        if len(m) < 16:
            raise ValueError("the transformation is cut short")
        return GeoTransform(m[3] - half * (m[0] + m[1]), m[7] - half * (m[4] + m[5]), m[0], -m[5]), epsg
    scale, tie = tags.get(SCALE, np.empty(0)).tolist(), tags.get(TIEPOINT, np.empty(0)).tolist()
    if len(scale) >= 2 and len(tie) >= 6:
        return GeoTransform(tie[3] - (tie[0] + half) * scale[0], tie[4] + (tie[1] + half) * scale[1], scale[0], scale[1]), epsg
    return None, epsg


def layout_of(order: str, tags: dict) -> dict:
    one = lambda tag, default: int(tags[tag][0]) if tag in tags else default
    width, height, tiled = one(WIDTH, 0), one(HEIGHT, 0), TILES in tags
    cell_type = CELLS.get((one(BITS, 1), one(FORMAT, 1)))
    if width < 1 or height < 1 or cell_type is None:
        raise ValueError("an image of this size or sample type isn't supported")
    transform, epsg = georeference(tags)
    known = transform is not None
    transform = transform or GeoTransform()
    text = bytes(tags.get(NODATA, b"")).split(b"\0")[0].decode("ascii", "replace").strip()
    try:
        nodata = float(text)
    except ValueError:
        nodata = None
    chunk = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS, height), height))
    offsets, sizes = (tags.get(t, np.empty(0)).astype(np.int64).tolist() for t in ((TILES, TILE_BYTES) if tiled else (STRIPS, STRIP_BYTES)))
    bands, planar = one(SAMPLES, 1), one(PLANAR, 1)
    if min(chunk) < 1 or len(offsets) != len(sizes) or len(offsets) < -(-width // chunk[0]) * -(-height // chunk[1]) * (bands if planar == 2 else 1):
        raise ValueError("the chunks don't cover the image")
    return {
        "order": order, "width": width, "height": height, "bands": bands, "cell_type": cell_type, "tiled": tiled, "chunk_width": chunk[0], "chunk_height": chunk[1],
        "compression": one(COMPRESSION, 1), "predictor": one(PREDICTOR, 1), "planar": planar, "nodata": nodata, "epsg": epsg, "origin_x": transform.origin_x, "origin_y": transform.origin_y,
        "cell_width": transform.cell_width, "cell_height": transform.cell_height, "georeferenced": known, "offsets": offsets, "sizes": sizes,
    }


def _layouts(fetch: Transport, incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.strip().split(" ")[0] for c in LAYOUT.split(", ")]
    for batch in incoming:
        for path in batch.column(0).to_pylist():
            rows = [{"path": path, "image": k, **layout_of(*found)} for k, found in enumerate(images(functools.partial(fetch, path)))]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], _ARROW.get(n)) for n in names})


_ARROW = {"image": pa.int32(), "nodata": pa.float64(), "epsg": pa.int32(), "offsets": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), **{n: pa.int32() for n in ("width", "height", "bands", "chunk_width", "chunk_height", "compression", "predictor", "planar")}}


def layouts(spark: SparkSession, path: str | list[str], transport: Transport = read_range) -> DataFrame:
    """A row for each image of the files under a path, or of the http(s) addresses in a list, without their cells.

    ``transport(path, start, length)`` gives the bytes of a range, in tasks: :func:`.files.with_headers` for servers that want some.
    """
    if isinstance(path, list):
        files = spark.createDataFrame([(p,) for p in path], "path string").repartition(max(len(path), 1))
    else:
        files = listing(spark, path, ".tif").unionByName(listing(spark, path, ".tiff")).select("path")
    return files.mapInArrow(functools.partial(_layouts, transport), LAYOUT)


def meta_of(row) -> BandMeta:
    """The metadata of a row of :func:`layouts`."""
    return BandMeta(row.width, row.height, row.cell_type, row.nodata, GeoTransform(row.origin_x, row.origin_y, row.cell_width, row.cell_height), row.epsg)


def unpack_bits(raw: bytes, expected: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw) and len(out) < expected:
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += raw[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out[:expected])


def unpack_lzw(raw: bytes, expected: int) -> bytes:
    """Most significant bits first; codes grow one entry early."""
    fresh = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, last, width, bits, held = list(fresh), bytearray(), b"", 9, 0, 0
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257 or len(out) >= expected:
            break
        if code == 256:
            table, last, width = list(fresh), b"", 9
            continue
        if code > len(table) or (code == len(table) and not last):
            raise ValueError("a damaged chunk")
        entry = table[code] if code < len(table) else last + last[:1]
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out[:expected])


def decompress(raw: bytes, compression: int, expected: int) -> bytes:
    """At most the expected bytes, whatever a damaged chunk would grow to."""
    if compression == 1:
        out = raw[:expected]
    elif compression in (8, 32946):
        try:
            out = zlib.decompressobj().decompress(raw, expected)
        except zlib.error:
            out = zlib.decompressobj(-15).decompress(raw, expected)
    elif compression == 5:
        out = unpack_lzw(raw, expected)
    elif compression == 32773:
        out = unpack_bits(raw, expected)
    elif compression == 50000:
        with pa.CompressedInputStream(pa.BufferReader(raw), "zstd") as stream:
            out = stream.read(expected)
    else:
        raise ValueError(f"compression {compression} isn't supported")
    if len(out) < expected:
        raise ValueError("a chunk is cut short")
    return bytes(out)


def samples(raw: bytes, shape: tuple[int, int, int], cell_type: str, order: str, predictor: int) -> np.ndarray:
    """(height, width, samples) of an unpacked chunk."""
    kind = np.dtype(DTYPES[cell_type])
    if predictor == 3:
        h, w, n = shape
        rows = np.frombuffer(raw, np.uint8).reshape(h, -1, n)
        rows = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(h, kind.itemsize, w * n)
        return np.ascontiguousarray(rows.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape).astype(kind)
    cells = np.frombuffer(raw, kind.newbyteorder(order)).reshape(shape).astype(kind)
    if predictor == 2:
        cells = np.cumsum(cells, axis=1, dtype=cells.dtype)
    return cells


def _read_chunks(band: int, fetch: Transport, region: tuple[int, int, int, int] | None, incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        for c in batch.to_pylist():
            shape = (c["rows"], c["chunk_width"], 1 if c["planar"] == 2 else c["bands"])
            kind = np.dtype(DTYPES[c["cell_type"]])
            if c["size"]:
                raw = decompress(fetch(c["path"], c["offset"], c["size"]), c["compression"], math.prod(shape) * kind.itemsize)
                cells = samples(raw, shape, c["cell_type"], c["order"], c["predictor"])[:, :, 0 if c["planar"] == 2 else band].astype(float)
            else:
                cells = np.full(shape[:2], 0.0 if c["nodata"] is None else c["nodata"])
            x0, y0, x1, y1 = region or (0, 0, c["width"], c["height"])
            x0, y0, x1, y1 = max(x0, c["x"]), max(y0, c["y"]), min(x1, c["x"] + shape[1], c["width"]), min(y1, c["y"] + shape[0], c["height"])
            if x0 < x1 and y0 < y1:
                cells = cells[y0 - c["y"] : y1 - c["y"], x0 - c["x"] : x1 - c["x"]]
                y, x = np.mgrid[y0:y1, x0:x1].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([c["path"]] * cells.size), pa.array(x.ravel()), pa.array(y.ravel()), pa.array(cells.ravel())], ["path", "x", "y", "v"])


def read_cells(found: DataFrame, image: int = 0, band: int = 0, region: tuple[int, int, int, int] | None = None, transport: Transport = read_range) -> DataFrame:
    """(path, x, y, v) of one band of one image of each file of ``found`` (:func:`layouts`), of all cells or of a window (x0, y0, x1, y1; ends exclusive)."""
    e = F.expr
    if region is not None and not (region[0] < region[2] and region[1] < region[3]):
        raise ValueError("the window has no cells")
    rows = found.where(F.col("image") == image).withColumn("band_ok", F.when(F.col("bands") <= band, F.raise_error(F.lit(f"there is no band {band}"))).otherwise(F.lit(True))).where("band_ok")
    kept = ["path", "order", "width", "height", "bands", "cell_type", "chunk_width", "chunk_height", "tiled", "compression", "predictor", "planar", "nodata"]
    rows = rows.withColumn("across", e("(width + chunk_width - 1) div chunk_width")).withColumn("down", e("(height + chunk_height - 1) div chunk_height"))
    chunks = rows.select(*kept, "across", "down", F.posexplode(F.arrays_zip("offsets", "sizes")).alias("at", "chunk"))
    plane = F.when(F.col("planar") == 2, F.col("across") * F.col("down") * band).otherwise(F.lit(0))
    chunks = chunks.withColumn("k", F.col("at") - plane).where("k >= 0 and k < across * down")
    chunks = chunks.withColumn("x", e("cast(k % across * chunk_width as int)")).withColumn("y", e("cast(k div across * chunk_height as int)"))
    if region is not None:
        x0, y0, x1, y1 = region
        chunks = chunks.where((F.col("x") < x1) & (F.col("x") + F.col("chunk_width") > x0) & (F.col("y") < y1) & (F.col("y") + F.col("chunk_height") > y0))
    height = F.when(F.col("tiled"), F.col("chunk_height")).otherwise(F.least("chunk_height", F.col("height") - F.col("y")))
    kept = ["path", "order", "width", "height", "bands", "cell_type", "chunk_width", "compression", "predictor", "planar", "nodata", "x", "y"]
    work = chunks.select(*kept, height.alias("rows"), F.col("chunk.offsets").alias("offset"), F.col("chunk.sizes").alias("size"))
    return work.repartition("path", "x", "y").mapInArrow(functools.partial(_read_chunks, band, transport, region), "path string, x int, y int, v double")


def read_geotiff(spark: SparkSession, path: str | list[str], image: int = 0, band: int = 0, region: tuple[int, int, int, int] | None = None, transport: Transport = read_range) -> DataFrame:
    return read_cells(layouts(spark, path, transport), image, band, region, transport)


# What can be wrong with a cloud-optimised layout, and whether it is an error or a warning.
PROBLEMS = {"not tiled": True, "tiles not in order": True, "data out of range": True, "no georeference": False, "overview not tiled": False, "no overviews": False}


def check_layouts(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """(path, image, problem, error) for the files of ``found`` (:func:`layouts`) whose layout isn't that of a cloud-optimised GeoTIFF.

    ``lengths``: (path, length) of the files (:func:`.files.listing`, :func:`.files.lengths`).  A file without a row that is an error is one;
    no cell is read.
    """
    first = F.col("image") == 0
    last = F.array_max(F.zip_with("offsets", "sizes", lambda a, b: F.when(b > 0, a + b).otherwise(F.lit(0))))
    stored = F.transform(F.filter(F.arrays_zip("offsets", "sizes"), lambda c: c["sizes"] > 0), lambda c: c["offsets"])
    ordered = F.forall(F.zip_with(F.slice(stored, 1, F.greatest(F.size(stored) - 1, F.lit(0))), F.slice(stored, 2, F.greatest(F.size(stored) - 1, F.lit(0))), lambda a, b: b > a), lambda v: v)
    large = (F.col("width") > 512) | (F.col("height") > 512)
    images_of = found.groupBy("path").agg(F.count("*").alias("images"))
    tests = {
        "not tiled": first & ~F.col("tiled"), "tiles not in order": first & F.col("tiled") & ~ordered, "data out of range": last > F.col("length"),
        "no georeference": first & ~F.col("georeferenced"), "overview not tiled": ~first & ~F.col("tiled"), "no overviews": first & large & (F.col("images") == 1),
    }
    named = F.array(*[F.when(test, F.struct(F.lit(name).alias("problem"), F.lit(PROBLEMS[name]).alias("error"))) for name, test in tests.items()])
    rows = found.join(lengths.select("path", "length"), "path").join(images_of, "path")
    return rows.select("path", "image", F.inline(F.filter(named, lambda p: p.isNotNull())))


def halved(cells: np.ndarray, nodata: float | None) -> np.ndarray:
    """Bands half as wide and high: averages of the valid cells of each 2 x 2 block; a block without any is ``nodata``, or 0."""
    b, h, w = cells.shape
    valid = ~np.isnan(cells) if nodata is None or np.isnan(nodata) else ~np.isnan(cells) & (cells != nodata)
    even = ((0, 0), (0, h % 2), (0, w % 2))
    total, count = (np.pad(v, even).reshape(b, (h + 1) // 2, 2, (w + 1) // 2, 2).sum(axis=(2, 4)) for v in (np.where(valid, cells, 0.0), valid.astype(float)))
    return np.where(count > 0, total / np.maximum(count, 1), 0.0 if nodata is None else nodata)


def encode(cells: np.ndarray, m: BandMeta, tile: int = 256, deflate: bool = True, overviews: int = 0) -> bytes:
    """A tiled, little-endian GeoTIFF of one band (rows x columns) or several (bands x rows x columns, interleaved by cell), with overviews, each half as wide and high.

    All directories come first, then tiles, those of the smallest image before the others, as a cloud-optimised file has them.
    """
    if tile % 16 or not 16 <= tile <= 4096:
        raise ValueError("the tile size must be a multiple of 16 from 16 to 4096")
    levels = [cells.reshape(-1, *cells.shape[-2:]).astype(float)]
    while len(levels) <= overviews and max(levels[-1].shape[1:]) > 1:
        levels.append(halved(levels[-1], m.nodata))
    kind = np.dtype(DTYPES[m.cell_type]).newbyteorder("<")
    tiles = [_tiles(level, kind, tile, deflate) for level in levels]
    forms = {2: "B", 3: "H", 4: "I", 12: "d"}

    def directory(k: int, offsets: list[int]) -> list[tuple[int, int, list]]:
        (b, h, w), g = levels[k].shape, m.transform
        scale = (levels[0].shape[2] / w, levels[0].shape[1] / h) if k else (1.0, 1.0)
        tags = [
            *([(SUBFILE, 4, [1])] if k else []), (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8 * kind.itemsize] * b), (COMPRESSION, 3, [8 if deflate else 1]), (PHOTOMETRIC, 3, [2 if b == 3 and kind.itemsize == 1 else 1]), (SAMPLES, 3, [b]), (PLANAR, 3, [1]),
            (TILE_WIDTH, 3, [tile]), (TILE_HEIGHT, 3, [tile]), (TILES, 4, offsets), (TILE_BYTES, 4, [len(c) for c in tiles[k]]), (FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * b),
            (SCALE, 12, [g.cell_width * scale[0], g.cell_height * scale[1], 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, g.origin_x, g.origin_y, 0.0]),
        ]
        if m.epsg is not None:
            geographic = 4000 <= m.epsg < 5000
            tags.append((GEO_KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, RASTER_TYPE, 0, 1, 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, m.epsg]))
        if m.nodata is not None:
            tags.append((NODATA, 2, list(f"{m.nodata!r}".encode() + b"\0")))
        return sorted(tags)

    def packed(tags: list, at: int, following: int) -> bytes:
        """A directory that starts at a place, with the values that don't fit into it behind it."""
        entries, extra, start = struct.pack("<H", len(tags)), b"", at + 2 + 12 * len(tags) + 4
        for t, kind_of, v in tags:
            body = struct.pack(f"<{len(v)}{forms[kind_of]}", *v)
            entries += struct.pack("<HHI", t, kind_of, len(v)) + (body.ljust(4, b"\0") if len(body) <= 4 else struct.pack("<I", start + len(extra)))
            extra += body + b"\0" * (len(body) % 2) if len(body) > 4 else b""
        return entries + struct.pack("<I", following) + extra

    sizes = [len(packed(directory(k, [0] * len(tiles[k])), 8, 0)) for k in range(len(levels))]
    places = np.cumsum([8, *sizes])
    if places[-1] + sum(len(c) for level in tiles for c in level) >= 1 << 32:
        raise ValueError("a block is too large for one file")
    at, offsets = int(places[-1]), {}
    for k in reversed(range(len(levels))):
        ends = np.cumsum([at, *map(len, tiles[k])])
        offsets[k], at = ends[:-1].tolist(), int(ends[-1])
    heads = [packed(directory(k, offsets[k]), int(places[k]), int(places[k + 1]) if k + 1 < len(levels) else 0) for k in range(len(levels))]
    return b"II*\0" + struct.pack("<I", 8) + b"".join(heads) + b"".join(c for k in reversed(range(len(levels))) for c in tiles[k])


def _tiles(level: np.ndarray, kind: np.dtype, tile: int, deflate: bool) -> list[bytes]:
    """Tiles of a level row by row, their cells interleaved by band, padded with zeros."""
    b, h, w = level.shape
    out = []
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            full = np.zeros((tile, tile, b), kind)
            part = level[:, y : y + tile, x : x + tile]
            full[: part.shape[1], : part.shape[2]] = (np.rint(part) if kind.kind != "f" else part).transpose(1, 2, 0).astype(kind)
            out.append(zlib.compress(full.tobytes()) if deflate else full.tobytes())
    return out


def write_mosaic(cells: DataFrame, m: BandMeta, folder: str, block: int = 2048, tile: int = 256, deflate: bool = True, bands: int = 1, overviews: int = 0) -> DataFrame:
    """Cells (x, y, v and, if there are several bands, ``band``) as a mosaic: a GeoTIFF ``x-y.tif`` for each block of ``block`` x ``block`` cells, with its own transform and overviews.

    No task holds more than a block.  Cells without a row get the sentinel or 0; a task that runs again
    writes the same file.  Returns (file, bytes), written when it is evaluated.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        x0, y0 = key[0].as_py() * block, key[1].as_py() * block
        w, h = min(block, m.width - x0), min(block, m.height - y0)
        grid = np.full((bands, h, w), float(m.missing))
        grid[rows["band"].to_numpy(), rows["y"].to_numpy() - y0, rows["x"].to_numpy() - x0] = rows["v"].to_numpy()
        g = m.transform
        here = GeoTransform(g.origin_x + x0 * g.cell_width, g.origin_y - y0 * g.cell_height, g.cell_width, g.cell_height)
        content = encode(grid, BandMeta(w, h, m.cell_type, m.nodata, here, m.epsg), tile, deflate, overviews)
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{x0}-{y0}.tif") as out:
            out.write(content)
        return pa.table({"file": [f"{x0}-{y0}.tif"], "bytes": pa.array([len(content)], pa.int64())})

    band = F.col("band").cast("int") if bands > 1 else F.lit(0)
    inside = cells.withColumn("band", band).where((F.col("x") >= 0) & (F.col("x") < m.width) & (F.col("y") >= 0) & (F.col("y") < m.height) & (F.col("band") >= 0) & (F.col("band") < bands))
    kept = inside.select("x", "y", "band", m.filled(m.narrow(F.col("v"))).alias("v"))
    blocks = kept.groupBy(F.floor(F.col("x") / block).alias("bx"), F.floor(F.col("y") / block).alias("by"))
    return blocks.applyInArrow(run, "file string, bytes long")


def write_pyramid(cells: DataFrame, m: BandMeta, folder: str, block: int = 2048, tile: int = 256, deflate: bool = True) -> DataFrame:
    """Mosaics ``0``, ``1``, ... under ``folder``, each half as wide and high as the one before, down to a single block.

    Levels are aggregations of the level before, written first where they are read again: (x, y, v) as Parquet under ``folder``/cells.
    Returns (level, file, bytes) of all of them; the levels are written when this is called.
    """
    spark, level, out = cells.sparkSession, 0, []
    while True:
        written = write_mosaic(cells, m, f"{folder}/{level}", block, tile, deflate).collect()  # a row for each file
        out += [(level, r["file"], r["bytes"]) for r in written]
        if max(m.width, m.height) <= block:
            return spark.createDataFrame(out, "level int, file string, bytes long")
        small = BandMeta(-(-m.width // 2), -(-m.height // 2), m.cell_type, m.nodata, m.transform.downsampled(2), m.epsg)
        downsample(cells.select("x", "y", "v"), m, 2).write.mode("overwrite").parquet(f"{folder}/cells/{level + 1}")
        cells, m, level = spark.read.parquet(f"{folder}/cells/{level + 1}"), small, level + 1
