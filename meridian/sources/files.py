"""Files of binary formats: listed by Spark, read by byte range and written inside tasks."""

from __future__ import annotations

import functools
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(path, length, base: the path without its ending) of the files under ``path``; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return found.where(F.lower("path").endswith(ending)).withColumn("base", F.expr(f"left(path, length(path) - {len(ending)})"))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


#: What gives the bytes (path, start, length) of a range of a file; fewer at its end.
Transport = Callable[[str, int, int], bytes]


def _ask(path: str, start: int, length: int, headers: dict[str, str]):
    request = urllib.request.Request(path, headers={**headers, "Range": f"bytes={start}-{start + length - 1}"})
    return urllib.request.urlopen(request, timeout=60)


def read_range(path: str, start: int, length: int, headers: dict[str, str] | None = None) -> bytes:
    """Bytes of a file or an http(s) address; fewer at its end."""
    if path.startswith(("http://", "https://")):
        if length < 1:
            return b""
        with _ask(path, start, length, headers or {}) as answer:
            if answer.status != 206:
                raise ValueError(f"{path}: the server doesn't give ranges")
            return answer.read()
    system, name = opened(path)
    with system.open_input_file(name) as file:
        return file.read_at(min(length, max(file.size() - start, 0)), start)


def with_headers(headers: dict[str, str]) -> Transport:
    """A transport that sends ``headers`` along with every request."""
    return functools.partial(read_range, headers=headers)


def length_of(path: str, headers: dict[str, str] | None = None) -> int:
    """The length of a file, or of what an http(s) address holds as its answer to a range says."""
    if path.startswith(("http://", "https://")):
        with _ask(path, 0, 1, headers or {}) as answer:
            total = answer.headers.get("Content-Range", "").rpartition("/")[2]
        if not total.isdigit():
            raise ValueError(f"{path}: the server doesn't tell a length")
        return int(total)
    system, name = opened(path)
    return system.get_file_info(name).size


def lengths(spark: SparkSession, paths: list[str], headers: dict[str, str] | None = None) -> DataFrame:
    """(path, length) of files and addresses, asked for in tasks."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([length_of(p, headers) for p in batch.column(0).to_pylist()], pa.int64())], ["path", "length"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(len(paths), 1)).mapInArrow(run, "path string, length long")


def read_sibling(path: str, endings: list[str]) -> bytes | None:
    """The first file beside ``path`` (without its ending) that exists."""
    for ending in endings:
        system, name = opened(path + ending)
        if system.get_file_info(name).type == fs.FileType.File:
            with system.open_input_file(name) as file:
                return file.read()
    return None


def save_parts(rows: DataFrame, folder: str, encode: Callable[[list[dict]], dict[str, bytes]]) -> DataFrame:
    """Writes a set of files for each partition that holds rows, under ``folder``, which all tasks must reach.

    ``encode`` gives their contents by ending.  A partition is held in memory, as the formats need sizes and
    extents first: ``repartition`` to what one file should hold.  A task that runs again writes the same names.
    Returns (file, bytes), written when it is evaluated.
    """

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        members = [r for batch in incoming for r in batch.to_pylist()]
        if members:
            system, base = opened(folder)
            system.create_dir(base, recursive=True)
            sizes = {}
            for ending, content in encode(members).items():
                name = f"part-{TaskContext.get().partitionId():05d}{ending}"
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(content)
                sizes[name] = len(content)
            yield pa.RecordBatch.from_arrays([pa.array(sizes.keys(), pa.string()), pa.array(sizes.values(), pa.int64())], ["file", "bytes"])

    return rows.mapInArrow(run, "file string, bytes long")
