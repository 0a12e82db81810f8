"""GeoJSON files of any size in many tasks: a structural scan of byte ranges.

Whether a byte lies in a string, and how deep it is nested, depends on all bytes before it, but only through the parity of
quotes and the sum of brackets.  So every chunk is scanned once for both answers (it starts within a string or not), running
sums over the chunks of a file give each its true start, and a second scan finds objects: the members of a root object's
``features``, or root objects themselves in a file without it.  The task in whose chunk an object starts reads it to its end.

A chunk starts behind a byte that is no backslash, so that it never starts within an escape.  What lies outside of
features isn't checked for being JSON.

Neighbouring chunks go to one task in order, which reads ahead, so that chunks may be small.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import listing, read_range

QUOTE, ESCAPE, COLON = b'"'[0], b"\\"[0], b":"[0]
#: How far back a member's name is looked for, how much is read on at first for an object that its chunk doesn't end, and how much of a file one task reads in order and at a time, if chunks are smaller.
NAME_BYTES, MORE, RUN_BYTES = 4096, 4096, 1 << 17


def _steps() -> np.ndarray:
    step = np.zeros(256, np.int8)
    step[[b"{"[0], b"["[0]]], step[[b"}"[0], b"]"[0]]] = 1, -1
    return step


_STEP = _steps()


class _Ahead:
    """Ranges of files that are asked for one behind the other: what was read last is kept, with some bytes before and behind it."""

    def __init__(self) -> None:
        self.path, self.low, self.held, self.whole = None, 0, b"", False

    def __call__(self, path: str, start: int, length: int) -> bytes:
        end = self.low + len(self.held)
        if path != self.path or start < self.low or (start + length > end and not self.whole):
            self.path, self.low = path, max(start - NAME_BYTES, 0)
            wanted = start - self.low + max(length, RUN_BYTES)
            self.held = read_range(path, self.low, wanted)
            self.whole = len(self.held) < wanted
        return self.held[start - self.low : start - self.low + length]


def _start(read: _Ahead, path: str, at: int) -> int:
    """The first place from ``at`` on that doesn't follow a backslash."""
    while at:
        near = read(path, at - 1, 4096)
        free = next((k for k, c in enumerate(near) if c != ESCAPE), None)
        if free is not None:
            return at + free
        if not near:
            return at
        at += len(near)
    return 0


def _chunk(read: _Ahead, path: str, at: int, end: int) -> tuple[int, np.ndarray]:
    first = _start(read, path, at)
    return first, np.frombuffer(read(path, first, max(_start(read, path, end) - first, 0)), np.uint8)


def _quotes(data: np.ndarray) -> tuple[np.ndarray, int]:
    """How many quotes that aren't escaped lie before each byte, and in all, modulo 2."""
    slash = data == ESCAPE
    quote = data == QUOTE
    if slash.any():
        # a run of backslashes escapes what follows if its length is odd
        begins = slash & ~np.append(False, slash[:-1])
        runs = np.maximum.accumulate(np.where(begins, np.arange(len(data)), -1))
        runs = np.append(-1, runs[:-1])
        length = np.arange(len(data)) - runs  # of the run right before a byte
        behind = np.append(False, slash[:-1])
        quote &= ~(behind & (length % 2 == 1))
    inside = np.cumsum(quote) & 1
    return np.append(0, inside)[:-1].astype(np.int8), int(inside[-1]) if len(inside) else 0


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))


def _tallies(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk: its quotes modulo 2 and the sum of its brackets if it starts outside and inside of a string."""
    read = _Ahead()
    for batch in incoming:
        rows = []
        for path, k, at, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            _, data = _chunk(read, path, at, end)
            before, odd = _quotes(data)
            step = _STEP[data]
            rows.append((path, k, at, end, odd, int(step[before == 0].sum()), int(step[before == 1].sum())))
        yield _table(rows, path=pa.string(), k=pa.int64(), start=pa.int64(), stop=pa.int64(), odd=pa.int32(), out=pa.int32(), within=pa.int32())


def _scan(read: _Ahead, path: str, at: int, end: int, inside: int, depth: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """First byte of a chunk, its bytes, the places of brackets outside of strings, and the depth before each."""
    first, data = _chunk(read, path, at, end)
    before, _ = _quotes(data)
    places = np.flatnonzero((_STEP[data] != 0) & (before == inside))
    steps = _STEP[data[places]].astype(np.int64)
    return first, data, places, depth + np.cumsum(steps) - steps


def _is_features(read: _Ahead, path: str, place: int) -> bool:
    """Whether the array at a place is the member ``features``."""
    back = min(NAME_BYTES, place)
    return read(path, place - back, back).rstrip().removesuffix(b":").rstrip().endswith(b'"features"')


def _events(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where arrays that are members of a root object open and close, whether they are ``features``, and how many objects lie directly in one, or in the root, from a place on."""
    read = _Ahead()
    for batch in incoming:
        rows = []
        for path, k, at, end, inside, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            first, data, places, deep = _scan(read, path, at, end, inside, depth)
            kind = data[places]
            opened = np.flatnonzero((kind == b"["[0]) & (deep == 1))
            closed = np.flatnonzero((kind == b"]"[0]) & (deep == 2))
            rows += [(path, k, int(first + places[i]), 1 if _is_features(read, path, int(first + places[i])) else 0, 0) for i in opened]
            rows += [(path, k, int(first + places[i]), -1, 0) for i in closed]
            for level, code in ((2, 2), (0, 3)):
                objects = places[(kind == b"{"[0]) & (deep == level)]
                bounds = np.concatenate([[0], np.sort(places[np.concatenate([opened, closed])]), [len(data)]]) if level else np.array([0, len(data)])
                counts = np.diff(np.searchsorted(objects, bounds))
                rows += [(path, k, int(first + b), code, int(n)) for b, n in zip(bounds[:-1], counts, strict=True) if n]
        yield _table(rows, path=pa.string(), k=pa.int64(), place=pa.int64(), kind=pa.int32(), n=pa.int64())


def _end(read: _Ahead, data: bytes, path: str, after: int) -> bytes:
    """The object that ``data`` starts with, read on behind it if need be."""
    while True:
        a = np.frombuffer(data, np.uint8)
        before, _ = _quotes(a)
        depth = np.cumsum(np.where(before == 0, _STEP[a], 0).astype(np.int64))
        done = np.flatnonzero(depth == 0)
        if len(done):
            return data[: done[0] + 1]
        more = read(path, after, max(MORE, len(data)))
        if not more:
            raise ValueError(f"{path}: an object isn't closed")
        data, after = data + more, after + len(more)


def _objects(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = _Ahead()
    for batch in incoming:
        for path, at, end, inside, depth, level, low, high, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            first, data, places, deep = _scan(read, path, at, end, inside, depth)
            chosen = places[(data[places] == b"{"[0]) & (deep == level) & (first + places > low) & (first + places < high)]
            raw = data.tobytes()
            ends = places[(data[places] == b"}"[0]) & (deep == level + 1)]
            stop = np.searchsorted(ends, chosen)
            texts = []
            for place, k in zip(chosen.tolist(), stop.tolist(), strict=True):
                text = raw[place : ends[k] + 1] if k < len(ends) else _end(read, raw[place:], path, first + len(raw))
                texts.append(text.decode())
                if sum(map(len, texts[-64:])) > 1 << 22:
                    yield _texts(path, number, texts)
                    number, texts = number + len(texts), []
            if texts:
                yield _texts(path, number, texts)


def _texts(path: str, number: int, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(texts)), pa.array(range(number, number + len(texts)), pa.int64()), pa.array(texts, pa.string())], ["path", "feature_id", "text"])


def objects(spark: SparkSession, path: str, chunk_bytes: int) -> DataFrame:
    """(path, feature_id, text) of the features of the files under a path, each as JSON text."""
    files = functools.reduce(DataFrame.unionByName, [listing(spark, path, ending).select("path", "length") for ending in (".geojson", ".json", ".txt")])
    step = F.lit(chunk_bytes).cast("long")
    runs = files.agg(F.sum(F.ceil(F.col("length") / RUN_BYTES))).first()[0] or 1
    # a number of its own: rows of chunks are so small that Spark would put them all into one task
    tasks = min(runs, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "path", F.floor(F.col("start") / RUN_BYTES)).sortWithinPartitions("path", "start")

    chunks = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step).cast("long"))).alias("k"))
    chunks = chunks.select("path", "k", (F.col("k") * step).alias("start"), F.least((F.col("k") + 1) * step, F.col("length")).alias("stop"))
    tallies = dealt(chunks).mapInArrow(_tallies, "path string, k long, start long, stop long, odd int, out int, within int")
    # a row for each chunk: running sums are small work
    before = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    told = tallies.withColumn("inside", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int"))
    told = told.withColumn("net", F.when(F.col("inside") == 0, F.col("out")).otherwise(F.col("within")))
    told = told.withColumn("depth", F.coalesce(F.sum("net").over(before), F.lit(0)).cast("long")).select("path", "k", "start", "stop", "inside", "depth")
    events = dealt(told).mapInArrow(_events, "path string, k long, place long, kind int, n long")
    by_place = Window.partitionBy("path").orderBy("place")
    opens = events.where("kind < 2").withColumn("until", F.lead("place").over(by_place)).where("kind = 1")
    range_ = opens.groupBy("path").agg(F.min(F.struct("place", "until")).alias("r")).select("path", F.col("r.place").alias("low"), F.coalesce("r.until", F.lit(1 << 62)).alias("high"))
    counts = events.where("kind >= 2").join(range_, "path", "left")
    member = F.when(F.col("low").isNull(), F.col("kind") == 3).otherwise((F.col("kind") == 2) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
    counts = counts.where(member).groupBy("path", "k").agg(F.sum("n").alias("n")).withColumn("number", F.coalesce(F.sum("n").over(before), F.lit(0)))
    work = told.join(counts, ["path", "k"]).join(range_, "path", "left")
    level = F.when(F.col("low").isNull(), 0).otherwise(2)
    work = work.select("path", "start", "stop", "inside", "depth", level.alias("level"), F.coalesce("low", F.lit(-1)).alias("low"), F.coalesce("high", F.lit(1 << 62)).alias("high"), "number")
    return dealt(work).mapInArrow(_objects, "path string, feature_id long, text string")
