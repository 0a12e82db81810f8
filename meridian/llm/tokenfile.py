"""Token-id files with Elias-Fano document boundaries.

A *file* is a Parquet table of shards in ascending ``doc_id`` order (null ids first, then ties by
text).  A shard's row holds its ids as one little-endian binary (16 bits an id if the vocabulary
allows, else 32), and two Elias-Fano sequences: the boundaries of its documents in that array, and
their doc_ids less the smallest, each with its select structure.  Readers get offsets and doc_ids
from :meth:`EliasFano.select` alone.  Shards tell how many ids
come before them in their partition; readers add the totals of earlier partitions.

Documents are range-partitioned by doc_id once, and encoded behind that shuffle; shards have at
most ``shard_tokens`` ids (a longer document has a shard of its own).  Parquet's commit protocol
makes writing safe against lost or repeated tasks, and any store that Spark writes will do.
Null and empty texts are documents of the end id alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens

SHARD_TOKENS = 1 << 20
SAMPLE = 256
ENCODED_AT_ONCE = 1 << 14
_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)

SHARD_SCHEMA = "part int, shard int, before long, n_docs long, n_ids long, id_bytes int, end_id int, n_null long, min_doc_id long, ids binary, bounds binary, doc_ids binary"


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about ``2 + log2(u / n)`` bits each.

    The low bits of all values lie one after another; the high parts are written in unary, value ``i``
    as the one bit at ``(value >> low_bits) + i``.  The select structure holds, for every 256th one
    bit, its byte and the ones before that byte; it is stored with the sequence.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample_byte: np.ndarray, sample_ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.sample_byte, self.sample_ones = sample_byte, sample_ones

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = np.zeros((n + (top >> low_bits) + 8) // 8, np.uint8)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
        low = []
        for a in range(0, n, ENCODED_AT_ONCE):  # a multiple of 8 values ends with a whole byte
            bits = (values[a : a + ENCODED_AT_ONCE, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
        sample_byte = at[::SAMPLE] >> 3
        sample_ones = np.arange(0, n, SAMPLE) - _POP[high[sample_byte] & ((1 << (at[::SAMPLE] & 7)) - 1).astype(np.uint8)]
        return cls(n, low_bits, np.concatenate(low) if low else np.empty(0, np.uint8), high, sample_byte.astype("<u4"), sample_ones.astype("<u4"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u8")
        return head.tobytes() + self.sample_byte.tobytes() + self.sample_ones.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, n_low, n_high = (int(x) for x in np.frombuffer(raw, "<u8", 4))
        samples = -(-n // SAMPLE)
        byte, ones = np.frombuffer(raw[32 : 32 + 8 * samples], "<u4").reshape(2, samples)
        data = np.frombuffer(raw[32 + 8 * samples :], np.uint8)
        return cls(n, low_bits, data[:n_low], data[n_low : n_low + n_high], byte, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        value = np.zeros(len(i), np.int64)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            value |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << b
        return value

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values numbered ``i`` (ascending): for each, the bytes from its sample on are searched for its one bit."""
        i = np.asarray(i, np.int64)
        position = np.empty(len(i), np.int64)
        block = i // SAMPLE
        cuts = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(i)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            k = int(block[a])
            first = int(self.sample_byte[k])
            last = int(self.sample_byte[k + 1]) + 1 if k + 1 < len(self.sample_byte) else len(self.high)
            ones = np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little"))
            position[a:b] = first * 8 + ones[i[a:b] - int(self.sample_ones[k])]
        return ((position - i) << self.low_bits) | self._low(i)


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> None:
    """Writes the file of all rows of ``docs`` (doc_id, text) at ``path``."""
    vocabulary = vocabulary or tokens.default_path()

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        names: list = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, before
            data = np.concatenate(ids)
            known = np.array([n for n in names if n is not None], np.int64)
            least = int(known[0]) if len(known) else 0
            bounds = EliasFano.encode(np.cumsum([len(a) for a in ids]))
            doc_ids = EliasFano.encode(known.astype(np.uint64) - np.array([least]).astype(np.uint64)[0])
            row = [[part], [shard], [before], [len(names)], [len(data)], [data.itemsize], [end_id], [len(names) - len(known)], [least], [data.tobytes()], [bounds.to_bytes()], [doc_ids.to_bytes()]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            shard += 1
            before += len(data)
            names.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], [c.split()[0] for c in SHARD_SCHEMA.split(", ")])

        for batch in incoming:
            for name, a in zip(batch.column(0).to_pylist(), encoder.each(batch.column(1)), strict=True):
                if names and held + len(a) + 1 > shard_tokens:
                    yield flush()
                    held = 0
                names.append(name)
                ids.append(np.append(a, np.array([end_id], a.dtype)))
                held += len(a) + 1
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    dealt.sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of a file: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (binary, as stored)."""
    shards = spark.read.parquet(path)
    base, total = {}, 0
    for part, n in sorted(shards.groupBy("part").agg(F.sum("n_ids")).collect()):  # one number a written partition
        base[part], total = total, total + n
    columns = shards.select("part", "before", "id_bytes", "n_null", "min_doc_id", "ids", "bounds", "doc_ids")
    return columns.mapInArrow(functools.partial(_decode, base, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def _decode(base: dict[int, int], with_ids: bool, incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        for i in range(batch.num_rows):
            part, before, id_bytes, n_null, least, raw, bounds, doc_ids = (batch.column(c)[i].as_py() for c in range(8))
            ids = np.frombuffer(raw, f"<u{id_bytes}")
            ef = EliasFano.from_bytes(bounds)
            ends = ef.select(np.arange(ef.n))
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            ef = EliasFano.from_bytes(doc_ids)
            names = [None] * n_null + [int(k) + least for k in ef.select(np.arange(ef.n))]
            crcs = [tokens.ids_crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
            columns = [pa.array(names, pa.int64()), pa.array(starts + base[part] + before), pa.array(ends - starts), pa.array(crcs, pa.int64())]
            if with_ids:
                columns.append(pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
