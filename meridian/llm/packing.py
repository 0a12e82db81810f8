"""Cost-balanced packing of token sequences.

A piece of ``n`` tokens costs ``linear * n + quadratic * n**2`` (attention inside a piece).  Pieces
are taken in descending length and each goes to the sequence with the lowest cost so far among
those with room for it.  Where no sequence has room, the piece is cut over the roomiest ones.
Sequences have ``capacity`` tokens; what remains of a window of documents fills sequences whose
lengths are the powers of two in its binary form, so nothing is padded.

Documents are packed in windows of about ``window_tokens`` ids of one input partition: no shuffle,
memory bounded by a window, and a lost executor's partitions are simply packed again.  Every row is a document of its own, also if ids
repeat or are null.  Null and empty texts are documents of the end id alone.  No rows: no pieces.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

CAPACITY = 4096
LINEAR = 1.0
#: The quadratic part equals the linear one at this many tokens.
QUADRATIC = 1 / 2048
WINDOW_TOKENS = 1 << 21

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sequence_sizes(total: int, capacity: int) -> list[int]:
    """Full sequences, then the powers of two that make up the rest."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, length, sequence) that fill ``sequence_sizes(sum(lengths))`` exactly."""
    room = sequence_sizes(sum(lengths), capacity)
    spent = [0.0] * len(room)
    pieces = [(capacity, d, s) for d, n in enumerate(lengths) for s in range(0, n - n % capacity, capacity)]
    pieces += [(n % capacity, d, n - n % capacity) for d, n in enumerate(lengths) if n % capacity]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    aside: dict[int, list[int]] = defaultdict(list)  # sequences by room, less than the length at hand
    for q, r in enumerate(room):
        aside[r].append(q)
    open_: list[tuple[float, int]] = []  # every sequence here has room for the length at hand
    level, out = capacity + 1, []

    def put(length: int, d: int, start: int, q: int) -> None:
        out.append((d, start, length, q))
        room[q] -= length
        spent[q] += linear * length + quadratic * length * length

    for length, d, start in pieces:
        for r in range(length, level):  # each level is opened once
            for q in aside.pop(r, ()):
                heapq.heappush(open_, (spent[q], q))
        level = length
        if open_:
            _, q = heapq.heappop(open_)
            put(length, d, start, q)
            if room[q] >= length:
                heapq.heappush(open_, (spent[q], q))
            elif room[q]:
                aside[room[q]].append(q)
            continue
        while length:
            r = max(k for k, v in aside.items() if v)
            q = aside[r].pop()
            part = min(r, length)
            put(part, d, start, q)
            start, length = start + part, length - part
            if room[q]:
                aside[room[q]].append(q)
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text): see the module.  ``capacity`` must be a power of two."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = vocabulary or tokens.default_path()

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        base = TaskContext.get().partitionId() << 36
        used = 0
        names: list = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal used
            lengths = [len(a) for a in ids]
            pieces = assign(lengths, capacity, linear, quadratic)
            filled: dict[int, int] = defaultdict(int)
            rows = []
            for d, start, length, q in pieces:
                rows.append((names[d], start, length, tokens.ids_crc32(ids[d][start : start + length]), lengths[d], base + used + q, filled[q]))
                filled[q] += length
            used += len(filled)
            names.clear()
            ids.clear()
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        held = 0
        for batch in incoming:
            for name, a in zip(batch.column(0).to_pylist(), encoder.each(batch.column(1)), strict=True):
                names.append(name)
                ids.append(np.append(a, np.array([end_id], a.dtype)))
                held += len(a) + 1
                if held >= window_tokens:
                    yield flush()
                    held = 0
        if names:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
