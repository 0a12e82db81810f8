"""Fill-in-the-middle transformation: documents as piece tables over immutable buffers.

A document is a list of descriptors (buffer, start, length) over its text's UTF-8 bytes and a buffer of
sentinels, neither of which is ever changed or copied.  Cutting splits a descriptor, an arrangement is
another order of descriptors with sentinels between, and hashes run over what the descriptors show.

Units are runs of ASCII letters and single other code points; their starts are found on the bytes, in
chunks, so that a very long text needs no list of its units.  Two numbers from the sha256 of
``<seed>:<doc_id>`` choose the cuts and two more the form, so a lost task is redone with the same result:

* ``psm``: ``<P>``prefix``<S>``suffix``<M>``middle, ``spm``: ``<S>``suffix``<P>``prefix``<M>``middle,
* ``plain``: the text as it is; so are empty texts and texts that contain a sentinel.

:func:`restored` reads the pieces of an output between its sentinels (which no piece contains) and puts them
in text order by the inverse permutation.

Null texts are empty; a null doc_id is hashed as the empty string; repeated rows give repeated results.
Only ``doc_id`` and ``text`` are read, so no other column can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import batches

#: Arrangements: the parts in order, each behind its own sentinel.
ARRANGED = {"psm": ("P", "S", "M"), "spm": ("S", "P", "M")}
#: The parts as they stand in a text.
IN_TEXT = ("P", "M", "S")
#: Out of 100 documents, those that stay plain, and those of the others that are arranged as spm.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
CHUNK = 1 << 20

_SENTINELS = b"<P><S><M>"
_MARK = {"P": (0, 3), "S": (3, 3), "M": (6, 3)}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


class Piece(NamedTuple):
    """``length`` bytes of a buffer from ``start``."""

    buffer: int
    start: int
    length: int


TEXT, MARKS = 0, 1


def _starts(data: np.ndarray, at: int) -> np.ndarray:
    """Which bytes of the chunk from ``at`` start a unit."""
    part = data[at : at + CHUNK]
    letter = _LETTER[part]
    follows = np.empty(len(part), bool)
    follows[0] = at > 0 and _LETTER[data[at - 1]]
    follows[1:] = letter[:-1]
    return ~_CONTINUES[part] & ~(letter & follows)


class Units:
    """The number of a text's units and the byte where each starts."""

    def __init__(self, raw: bytes):
        self.data = np.frombuffer(raw, np.uint8)
        counts = [np.count_nonzero(_starts(self.data, at)) for at in range(0, len(raw), CHUNK)]
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.n = int(self.before[-1])

    def offset(self, k: int) -> int:
        """The byte after the first ``k`` units."""
        if k >= self.n:
            return len(self.data)
        chunk = int(np.searchsorted(self.before, k, side="right")) - 1
        return chunk * CHUNK + int(np.flatnonzero(_starts(self.data, chunk * CHUNK))[k - self.before[chunk]])


def split(pieces: list[Piece], at: int) -> list[Piece]:
    """The same document with a cut after ``at`` bytes; nothing is copied but descriptors."""
    out: list[Piece] = []
    for p in pieces:
        left = min(max(at, 0), p.length)
        out += [Piece(p.buffer, p.start, left), Piece(p.buffer, p.start + left, p.length - left)] if 0 < at < p.length else [p]
        at -= p.length
    return out


def between(pieces: list[Piece], start: int, end: int) -> list[Piece]:
    """The descriptors of a document's bytes from ``start`` to ``end``."""
    out, at = [], 0
    for p in split(split(pieces, start), end):
        if p.length and start <= at and at + p.length <= end:
            out.append(p)
        at += p.length
    return out


def arrange(parts: dict[str, list[Piece]], form: str) -> list[Piece]:
    """The parts in the order of ``form``, each behind its sentinel."""
    return [p for name in ARRANGED[form] for p in (Piece(MARKS, *_MARK[name]), *parts[name])]


def views(pieces: Iterable[Piece], buffers: tuple[bytes, bytes]) -> Iterable[memoryview]:
    """What the descriptors show, without copies."""
    for p in pieces:
        yield memoryview(buffers[p.buffer])[p.start : p.start + p.length]


def sha256(pieces: Iterable[Piece], buffers: tuple[bytes, bytes]) -> str:
    digest = hashlib.sha256()
    for view in views(pieces, buffers):
        digest.update(view)
    return digest.hexdigest()


def restored(output: bytes, form: str) -> list[Piece]:
    """The text of an output as descriptors over the output itself.  Raises ValueError where a sentinel is missing."""
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    where, at = {}, 0
    for name in ARRANGED[form]:
        mark = bytes(next(iter(views([Piece(MARKS, *_MARK[name])], (b"", _SENTINELS)))))
        found = output.index(mark, at)
        where[name] = found, found + len(mark)
        at = found + len(mark)
    ends = [where[name][0] for name in ARRANGED[form][1:]] + [len(output)]
    part = {name: Piece(TEXT, where[name][1], end - where[name][1]) for name, end in zip(ARRANGED[form], ends, strict=True)}
    return [part[name] for name in IN_TEXT]


def _draws(seed: int, doc_id: object) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def _one(raw: bytes, doc_id: object, seed: int, plain: int, spm: int) -> tuple[int, str, dict[str, list[Piece]], list[Piece]]:
    """Units, form, parts and arranged pieces of a document."""
    h1, h2, h3, h4 = _draws(seed, doc_id)
    units, whole = Units(raw), [Piece(TEXT, 0, len(raw))]
    if not raw or h3 % 100 >= 100 - plain or any(mark in raw for mark in (b"<P>", b"<S>", b"<M>")):
        return units.n, "plain", {}, whole
    low, high = (units.offset(k) for k in sorted((h1 % (units.n + 1), h2 % (units.n + 1))))
    parts = {"P": between(whole, 0, low), "M": between(whole, low, high), "S": between(whole, high, len(raw))}
    form = "spm" if h4 % 100 < spm else "psm"
    return units.n, form, parts, arrange(parts, form)


def _chars(pieces: list[Piece], raw: bytes) -> int:
    return sum(int(np.count_nonzero(~_CONTINUES[np.frombuffer(v[at : at + CHUNK], np.uint8)])) for v in views(pieces, (raw, _SENTINELS)) for at in range(0, len(v), CHUNK))


_PIECES = "array<struct<buffer: int, start: long, length: long>>"


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, with_output: bool = True) -> DataFrame:
    """Each document arranged for filling in its middle.

    Returns ``doc_id``, ``n`` (units), ``form``, ``prefix_chars`` and ``middle_chars`` (null if plain),
    ``pieces`` (descriptors: buffer 0 is the text's UTF-8, 1 the sentinels ``<P><S><M>``),
    ``output_sha256``, ``restored_sha256`` (of the text rebuilt from the output) and, with
    ``with_output``, ``output``.  One pass over the rows, no shuffle.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, pieces {_PIECES}, output_sha256 string, restored_sha256 string" + (", output string" if with_output else "")
    piece_type = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))

    def arranged(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        rows = []
        for doc_id, raw in zip(ids, batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            raw = raw or b""
            n, form, parts, pieces = _one(raw, doc_id, seed, plain_percent, spm_percent)
            buffers = (raw, _SENTINELS)
            output = b"".join(views(pieces, buffers))
            chars = (_chars(parts["P"], raw), _chars(parts["M"], raw)) if parts else (None, None)
            row = (n, form, *chars, [p._asdict() for p in pieces], sha256(pieces, buffers), sha256(restored(output, form), (output, b"")))
            rows.append((*row, output.decode()) if with_output else row)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), piece_type, pa.string(), pa.string(), pa.string()]
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output_sha256", "restored_sha256", "output"]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names[: len(columns) + 1])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(batches(arranged), schema)


def restore(outputs: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``outputs`` with ``restored``: the text rebuilt from an output and its form (null output: null)."""
    names = [c for c in outputs.columns if c != "restored"]
    kept = outputs.select(*[F.col(f"`{c}`") for c in names])
    where, how = names.index(output), names.index(form)

    def rebuilt(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = zip(batch.column(where).cast(pa.binary()).to_pylist(), batch.column(how).to_pylist(), strict=True)
        texts = [None if raw is None else b"".join(views(restored(raw, f), (raw, b""))).decode() for raw, f in pairs]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "restored"])

    schema = StructType([*kept.schema.fields, StructField("restored", StringType())])
    return kept.mapInArrow(batches(rebuilt), schema)


#: Held against op13 in DuckDB: the same cuts over a list of all units.
ORACLE_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || doc_id) AS h FROM documents),
numbers AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM drawn),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cut)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
