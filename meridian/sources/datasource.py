"""``spark.read.format("meridian_geotiff")`` and ``("meridian_shapefile")``: planned partitions, pushed filters.

    datasource.register(spark)
    spark.read.format("meridian_geotiff").option("band", 0).load(path).where("x >= 512 and x < 1024 and y < 256")

Filters on the cells ``x`` and ``y`` of a GeoTIFF choose chunks before anything of them is read; filters on the box of a shapefile's
records (``xmin``, ``ymin``, ``xmax``, ``ymax``) are tested on a record's header, before its vertices are taken apart.  Spark tests them
again, so a filter is only ever a saving.  Plans come from headers and indexes; a plan's rows are runs of chunks or records.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from . import codecs, geotiff, shapefile
from .files import opened, read_range, read_sibling

#: Bytes of chunks that one partition reads.
PARTITION_BYTES = 32 << 20


def _files(path: str, endings: tuple[str, ...]) -> list[str]:
    system, name = opened(path)
    found = [system.get_file_info(name)]
    if found[0].type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(name, recursive=True))
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted(f"{scheme}{f.path}" for f in found if f.type == fs.FileType.File and f.path.lower().endswith(endings))


class _Bounds:
    """Closed ranges of columns that filters leave."""

    def __init__(self, columns: tuple[str, ...]):
        self.low, self.high = dict.fromkeys(columns, float("-inf")), dict.fromkeys(columns, float("inf"))

    def narrow(self, f: Filter) -> None:
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column in self.low and isinstance(f.value, (int, float)):
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.low[column] = max(self.low[column], f.value)
            if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.high[column] = min(self.high[column], f.value)


_COMPARED = (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


class _Reader(DataSourceReader):
    columns: tuple[str, ...] = ()

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.options, self.path, self.bounds = options, options["path"], _Bounds(self.columns)
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the interface's name
        for f in filters:
            if isinstance(f, _COMPARED):
                self.bounds.narrow(f)
            yield f  # tested again on the rows


@dataclass
class Chunks(InputPartition):
    """Chunks of one image: (x, y, offset, size) of each."""

    path: str
    layout: dict
    chunks: list[tuple[int, int, int, int]]

    def __post_init__(self) -> None:
        super().__init__(None)


class GeoTiffReader(_Reader):
    columns = ("x", "y")

    def partitions(self) -> list[InputPartition]:
        image, band = int(self.options.get("image", 0)), int(self.options.get("band", 0))
        out: list[InputPartition] = []
        for path in _files(self.path, (".tif", ".tiff")):
            for k, found in enumerate(geotiff.images(functools.partial(read_range, path))):
                if k == image:
                    out += self._chunks(path, geotiff.layout_of(*found), band)
                    break
        return out or [Chunks("", {}, [])]

    def _chunks(self, path: str, m: dict, band: int) -> Iterator[Chunks]:
        if band >= m["bands"]:
            raise ValueError(f"there is no band {band}")
        across, down = -(-m["width"] // m["chunk_width"]), -(-m["height"] // m["chunk_height"])
        first = across * down * band if m["planar"] == 2 else 0
        small = {k: v for k, v in m.items() if k not in ("offsets", "sizes")}
        held: list[tuple[int, int, int, int]] = []
        low, high = self.bounds.low, self.bounds.high
        for k in range(across * down):
            x, y = k % across * m["chunk_width"], k // across * m["chunk_height"]
            if x <= high["x"] and x + m["chunk_width"] > low["x"] and y <= high["y"] and y + m["chunk_height"] > low["y"]:
                held.append((x, y, m["offsets"][first + k], m["sizes"][first + k]))
                if sum(c[3] for c in held) >= self.size:
                    yield Chunks(path, small, held)
                    held = []
        if held:
            yield Chunks(path, small, held)

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        m, low, high = partition.layout, self.bounds.low, self.bounds.high
        band = int(self.options.get("band", 0))
        rows = [{**m, "path": partition.path, "x": x, "y": y, "rows": m["chunk_height"] if m["tiled"] else min(m["chunk_height"], m["height"] - y), "offset": offset, "size": size} for x, y, offset, size in partition.chunks]
        edge = lambda v, default: default if v in (float("inf"), float("-inf")) else v
        region = None
        if m:
            region = (int(max(0, edge(low["x"], 0))), int(max(0, edge(low["y"], 0))), int(min(m["width"], edge(high["x"], m["width"]) + 1)), int(min(m["height"], edge(high["y"], m["height"]) + 1)))
        for row in rows:
            if region[0] < region[2] and region[1] < region[3]:
                yield from geotiff._read_chunks(band, read_range, region, iter([pa.RecordBatch.from_pylist([row])]))


class GeoTiffSource(DataSource):
    """Cells (path, x, y, v) of a band; options ``image``, ``band``, ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "meridian_geotiff"

    def schema(self) -> str:
        return "path string, x int, y int, v double"

    def reader(self, schema) -> DataSourceReader:
        return GeoTiffReader(dict(self.options))


@dataclass
class Records(InputPartition):
    """A run of whole records of a shapefile."""

    path: str
    start: int
    size: int
    first: int

    def __post_init__(self) -> None:
        super().__init__(None)


class ShapefileReader(_Reader):
    columns = ("xmin", "ymin", "xmax", "ymax")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in _files(self.path, (".shp",)):
            system, name = opened(path)
            length = system.get_file_info(name).size
            index = read_sibling(path[:-4], [".shx", ".SHX"])
            at = [2 * struct.unpack_from(">i", index, k)[0] for k in range(100, len(index) - 7, 8)] if index else [100]
            begins = [k for k, p in enumerate(at) if k == 0 or p // self.size != at[k - 1] // self.size]
            ends = [*(at[k] for k in begins[1:]), length]
            out += [Records(path, at[k], end - at[k], k) for k, end in zip(begins, ends, strict=True)] if at else []
        return out or [Records("", 0, 0, 0)]

    def read(self, partition: Records) -> Iterator[tuple]:
        raw = read_range(partition.path, partition.start, partition.size) if partition.size else b""
        at, number, low, high = 0, partition.first, self.bounds.low, self.bounds.high
        while at + 12 <= len(raw):
            words = struct.unpack_from(">i", raw, at + 4)[0]
            content = raw[at + 8 : at + 8 + 2 * words]
            if words < 2 or len(content) < 2 * words:
                raise ValueError(f"{partition.path}: a record is cut short")
            code = struct.unpack_from("<i", content)[0]
            kind = shapefile.FLAT.get(code, code)
            box = (None,) * 4 if kind == 0 else struct.unpack_from("<dd", content, 4) * 2 if kind == shapefile.POINT else struct.unpack_from("<4d", content, 4)
            unbounded = all(v in (float("inf"), float("-inf")) for v in (*low.values(), *high.values()))
            if unbounded or (box[0] is not None and all(low[c] <= v <= high[c] for c, v in zip(self.columns, box, strict=True))):
                g = shapefile.geometry_of(content)
                yield (partition.path, number, *box, None if g is None else codecs.to_wkb(g))
            at += 8 + 2 * words
            number += 1


class ShapefileSource(DataSource):
    """Records (path, feature_id, xmin, ymin, xmax, ymax, geom: WKB), null shapes with null boxes; option ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "meridian_shapefile"

    def schema(self) -> str:
        return "path string, feature_id long, xmin double, ymin double, xmax double, ymax double, geom binary"

    def reader(self, schema) -> DataSourceReader:
        return ShapefileReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (GeoTiffSource, ShapefileSource):
        spark.dataSource.register(source)
