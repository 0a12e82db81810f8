"""Removal of repeated byte strings, over sampled suffixes of all texts.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document that
comes before, or in the same document at an earlier place.  Strings are judged on the input.

A suffix array of every byte needs many times the input on disk (the README has the figures), so
suffixes are sampled by content.  Of the ``length + 1 - GRAM`` grams of GRAM bytes in a string, the
one with the smallest hash (the leftmost of equals) is the string's anchor: equal strings have the
same anchor at the same place.  Consecutive strings with one anchor are a *run*, about
2 / (length - GRAM) runs a byte, and the suffixes that start at anchors are partitioned and sorted:

1. Suffixes are range-partitioned by the fingerprint of their leading gram.  Splitters are even, as a
   fingerprint is uniform: a sample would say the same.  Suffixes with one leading gram never lie on
   two sides of a boundary, so nothing is left to be compared across it.
2. A bucket sorts its suffixes by the fingerprint of the whole run, then by place, by multikey
   quicksort.  A run that equals an earlier one is covered.  If runs with the same leading gram
   differ, those that come first are sent back to their documents.
3. Only for these, the strings themselves are fingerprinted, partitioned and sorted in the same way.

Before a partition step every task keeps the first of equal runs (strings) and settles the others by
itself, and a leading gram with many different runs in one task skips step 2.  So a passage that a
third of all documents share costs each task one row a bucket.

Fingerprints have 128 bits, two sums with independent bases and tables: for n = 4e12 runs (100 TB)
the chance of any false match is about n**2 / 2**129, 2e-14; weak low bits of sums modulo 2**64 may
cost some factors of two of that.

Documents are ordered by doc_id (nulls first), equal ids by text.  Null texts are empty.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import Work, with_rows
from .neardup import by_key

LENGTH = 100
#: Bytes of text a bucket stands for, and a task holds before it deals out.
BUCKET_BYTES = 4 << 20
FLUSH_BYTES = 4 << 20
#: Fingerprints of single strings that a task holds before it deals out.
STRINGS_AT_ONCE = 250_000
#: Different runs of one leading gram that a task sends to a bucket.
FEW = 6
#: Bits of a position in a chunk of text.
_BITS = np.uint64(20)
_MASK = np.uint64((1 << 20) - 1)

# f, e: fingerprint of 128 bits; h: half of the gram's, of which the other half chose the bucket; n: strings less 1, 255: gram known to have several runs
RUN = np.dtype([("f", "<u8"), ("e", "<u8"), ("h", "<u4"), ("row", "<i8"), ("p", "<u4"), ("n", "u1")])
SPOT = np.dtype([("f", "<u8"), ("e", "<u8"), ("row", "<i8"), ("p", "<u4")])
CUT = np.dtype([("row", "<i8"), ("a", "<u4"), ("b", "<u4")])
SUFFIX, STRING, REMOVE, ASK = 0, 1, 2, 3
DEALT = "key long, data binary"


def _gram(length: int) -> int:
    return length // 2


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    done, step = v, 1
    while 2 * step <= width:
        done = np.minimum(done[:-step], done[step:])
        step *= 2
    if step < width:
        done = np.minimum(done[: len(done) - (width - step)], done[width - step :])
    return done


def runs_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, first string, last string, fingerprint of the gram, two of the run) in texts that lie one after another up to ``ends``."""
    none = np.empty(0, np.int64)
    nothing = (none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64))
    gram = _gram(length)
    if len(data) < length:
        return nothing
    sums = hashing.prefix(data)
    at = np.arange(len(data) - gram + 1)
    grams = hashing.mix(hashing.between(sums, at, at + gram))
    low = _sliding_min((grams & ~_MASK) | at.astype(np.uint64), length - gram + 1) & _MASK
    left = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[: len(low)] - np.arange(len(low))  # bytes to the text's end
    start = np.flatnonzero(left >= length)
    if not len(start):
        return nothing
    anchor = low[start].astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first, last = start[cut], start[np.append(cut[1:], len(start)) - 1]
    anchor = anchor[cut]
    whole = hashing.mix(hashing.between(sums, first, last + length) ^ hashing.mix(((anchor - first) * 256 + (last - first)).astype(np.uint64)))
    again = hashing.mix(hashing.between(hashing.prefix(data, 1), first, last + length, 1))
    return anchor, first, last, grams[anchor], whole, again


def _groups(rows: list[int], texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(data, ends, rows, offsets in the texts, first and end of the anchors wanted): small texts together, long ones in overlapping chunks."""
    some: list[int] = []
    size = 0

    def together() -> tuple:
        data = np.frombuffer(b"".join(texts[i] for i in some), np.uint8)
        ends = np.cumsum([len(texts[i]) for i in some])
        return data, ends, np.array([rows[i] for i in some]), np.zeros(len(some), np.int64), 0, len(data)

    for i, text in enumerate(texts):
        if len(text) > hashing.CHUNK:
            whole = np.frombuffer(text, np.uint8)
            for a in range(0, len(text), hashing.CHUNK):
                lo, hi = max(0, a - 4 * LENGTH), min(len(text), a + hashing.CHUNK + 4 * LENGTH)
                yield whole[lo:hi], np.array([hi - lo]), np.array([rows[i]]), np.array([lo]), a - lo, min(len(text), a + hashing.CHUNK) - lo
            continue
        if some and size + len(text) > hashing.CHUNK:
            yield together()
            some, size = [], 0
        some.append(i)
        size += len(text)
    if some:
        yield together()


def multikey(columns: list[np.ndarray]) -> np.ndarray:
    """The order by several columns, by multikey quicksort: only what ties on one column goes on to the next."""
    order = np.argsort(columns[0], kind="quicksort")
    tied = np.arange(len(order))  # places in ``order`` of what is still tied
    group = np.zeros(len(order), np.int64)
    for done, following in zip(columns, columns[1:], strict=False):
        value = done[order[tied]]
        fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (group[1:] != group[:-1])]) if len(tied) else np.empty(0, bool)
        alone = fresh & np.append(fresh[1:], True)
        group = np.cumsum(fresh)[~alone]
        tied = tied[~alone]
        if not len(tied):
            break
        some = order[tied]
        order[tied] = some[np.lexsort((following[some], group))]
    return order


def _firsts(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by fingerprint and place, whether each in that order is the first of its fingerprint)."""
    order = multikey([records[c] for c in ("f", "e", "row", "p")])
    f, e = records["f"][order], records["e"][order]
    return order, np.concatenate([[True], (f[1:] != f[:-1]) | (e[1:] != e[:-1])]) if len(f) else np.empty(0, bool)


def _deal(kind: int, records: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Records by part, as columns one after another (which compress better than rows)."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    records, part = records[order], part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for a, b in zip(cuts, np.append(cuts[1:], len(part)), strict=True):
        yield (kind << 40) | int(part[a]), _pack(records[a:b])


def _pack(records: np.ndarray) -> bytes:
    planes = np.frombuffer(records.tobytes(), np.uint8).reshape(len(records), -1).T
    return np.ascontiguousarray(planes).tobytes()


def _unpack(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind) for b in blobs]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _bucket_of(fingerprint: np.ndarray, parts: int) -> np.ndarray:
    return ((fingerprint >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _part_of(row: np.ndarray, parts: int) -> np.ndarray:
    """As :func:`_part_column`."""
    row = row.astype(np.int64)
    return (row ^ (row >> 17)) % parts


def _cuts(row: np.ndarray, a: np.ndarray, b: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Removals to their documents, overlapping ones joined."""
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order].astype(np.int64), b[order].astype(np.int64)
    if not len(row):
        return
    new_row = np.concatenate([[True], row[1:] != row[:-1]])
    group = np.cumsum(new_row) - 1
    base = group * (1 << 33)  # reach restarts with each document
    reach = np.maximum.accumulate(b + base) - base
    fresh = new_row | np.concatenate([[True], a[1:] > reach[:-1]])
    at = np.flatnonzero(fresh)
    out = np.empty(len(at), CUT)
    out["row"], out["a"] = row[at], a[at]
    out["b"] = reach[np.append(at[1:], len(row)) - 1]
    yield from _deal(REMOVE, out, _part_of(out["row"], parts))


def _strings(data: np.ndarray, row: np.ndarray, offset: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of all strings of the given runs."""
    n = last - first + 1
    p = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out = np.empty(len(p), SPOT)
    for which, name in enumerate(("f", "e")):
        out[name] = hashing.mix(hashing.between(hashing.prefix(data, which), p, p + length, which))
    out["row"], out["p"] = np.repeat(row, n), p + np.repeat(offset, n)
    return out


def _settle(spots: list[np.ndarray], parts: int, length: int) -> Iterator[tuple[int, bytes]]:
    """First strings to their buckets; the others of a task are removed."""
    if not spots:
        return
    s = np.concatenate(spots)
    order, first = _firsts(s)
    s = s[order]
    yield from _deal(STRING, s[first], _bucket_of(s["f"][first], parts))
    later = s[~first]
    yield from _cuts(later["row"], later["p"], later["p"].astype(np.int64) + length, parts)


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], ["key", "data"])


def _sample(length: int, parts: int, incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row, text) to suffixes, strings and removals for their parts."""
    rows: list[int] = []
    texts: list[bytes] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        found, kept, grams = [], [], []
        for data, ends, row, offset, lo, hi in _groups(rows, texts):
            anchor, first, last, h, f, e = runs_of(data, ends, length)
            doc = np.searchsorted(ends, anchor, side="right")
            want = (anchor >= lo) & (anchor < hi)
            begin = np.concatenate([[0], ends[:-1]])[doc]
            run = np.empty(int(want.sum()), RUN)
            run["f"], run["e"], run["h"], run["row"] = f[want], e[want], h[want] & np.uint64(0xFFFFFFFF), row[doc[want]]
            run["p"], run["n"] = (first - begin + offset[doc])[want], (last - first)[want]
            found.append(run)
            grams.append(h[want])
            kept.append((data, first[want], (offset[doc] - begin)[want]))
        if not found:
            return
        all_, gram = np.concatenate(found), np.concatenate(grams)
        order, new = _firsts(all_)
        later = all_[order[~new]]
        yield _batch(list(_cuts(later["row"], later["p"], later["p"].astype(np.int64) + later["n"] + length, parts)))
        head = order[new]
        # leading grams with many runs here
        hs = np.sort(gram[head])
        cut = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]])) if len(hs) else np.empty(0, np.int64)
        many = hs[cut][np.diff(np.append(cut, len(hs))) > FEW]
        crowded = np.isin(gram[head], many) if len(many) else np.zeros(len(head), bool)
        marks = np.zeros(len(many), RUN)
        marks["h"], marks["n"] = many & np.uint64(0xFFFFFFFF), 255
        few = np.concatenate([all_[head[~crowded]], marks])
        yield _batch(list(_deal(SUFFIX, few, _bucket_of(np.concatenate([gram[head[~crowded]], many]), parts))))
        if crowded.any():
            flag = np.zeros(len(all_), bool)
            flag[head[crowded]] = True
            spots, at, made = [], 0, 0
            for run, (data, first, shift) in zip(found, kept, strict=True):
                mine = np.flatnonzero(flag[at : at + len(run)])
                at += len(run)
                if len(mine):
                    spots.append(_strings(data, run["row"][mine], shift[mine], first[mine], first[mine] + run["n"][mine], length))
                    made += len(spots[-1])
                if made > STRINGS_AT_ONCE:
                    yield _batch(list(_settle(spots, parts, length)))
                    spots, made = [], 0
            yield _batch(list(_settle(spots, parts, length)))

    for batch in incoming:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            if len(raw) >= length:
                rows.append(row)
                texts.append(raw)
                held += len(raw)
            if held >= FLUSH_BYTES:
                yield from flush()
                rows, texts, held = [], [], 0
    if texts:
        yield from flush()


def _sort(length: int, parts: int, group: pa.Table) -> pa.RecordBatch | None:
    """A bucket of suffixes to removals and questions; what belongs elsewhere is passed on."""
    key = group.column(0)[0].as_py()
    if key >> 40 != SUFFIX:
        return group.combine_chunks().to_batches()[0]
    runs = _unpack(group.column(1).to_pylist(), RUN)
    marked, runs = runs["h"][runs["n"] == 255], runs[runs["n"] != 255]
    order, new = _firsts(runs)
    later, firsts = runs[order[~new]], runs[order[new]]
    out = list(_cuts(later["row"], later["p"], later["p"].astype(np.int64) + later["n"] + length, parts))
    hs = np.sort(firsts["h"])
    several = np.concatenate([hs[1:][hs[1:] == hs[:-1]], marked])
    asked = firsts[np.isin(firsts["h"], several)]
    ask = np.empty(len(asked), CUT)
    ask["row"], ask["a"], ask["b"] = asked["row"], asked["p"], asked["p"].astype(np.int64) + asked["n"]
    out += list(_deal(ASK, ask, _part_of(ask["row"], parts)))
    return _batch(out) if out else None


def _answer(length: int, parts: int, docs: pa.Table, asks: pa.Table) -> pa.Table:
    """Strings of the runs that were asked for, of one part's documents."""
    schema = pa.schema([("key", pa.int64()), ("data", pa.binary())])
    ask = _unpack(asks.column("data").to_pylist(), CUT)
    if not len(ask):
        return schema.empty_table()
    ask = ask[np.lexsort((ask["a"], ask["row"]))]
    spots, made, out = [], 0, []
    for row, text in zip(docs.column("_row"), docs.column("text"), strict=True):
        lo, hi = np.searchsorted(ask["row"], row.as_py(), "left"), np.searchsorted(ask["row"], row.as_py(), "right")
        if lo == hi:
            continue
        data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
        mine = ask[lo:hi]
        a, b = mine["a"].astype(np.int64), mine["b"].astype(np.int64)
        piece = a // hashing.CHUNK
        for k in np.unique(piece):  # a long text isn't hashed in one go
            some = piece == k
            base = int(k) * hashing.CHUNK
            spots.append(_strings(data[base : base + hashing.CHUNK + 4 * length], mine["row"][some], np.full(some.sum(), base), a[some] - base, b[some] - base, length))
            made += len(spots[-1])
        if made > STRINGS_AT_ONCE:
            out += list(_settle(spots, parts, length))
            spots, made = [], 0
    out += list(_settle(spots, parts, length))
    return pa.Table.from_batches([_batch(out)]) if out else schema.empty_table()


def _sort_strings(length: int, parts: int, group: pa.Table) -> pa.RecordBatch | None:
    if group.column(0)[0].as_py() >> 40 != STRING:
        return group.combine_chunks().to_batches()[0]
    spots = _unpack(group.column(1).to_pylist(), SPOT)
    order, first = _firsts(spots)
    later = spots[order[~first]]
    out = list(_cuts(later["row"], later["p"], later["p"].astype(np.int64) + length, parts))
    return _batch(out) if out else None


def _remove(with_text: bool, docs: pa.Table, cuts: pa.Table) -> pa.Table:
    cut = _unpack(cuts.column("data").to_pylist(), CUT)
    cut = cut[np.lexsort((cut["a"], cut["row"]))]
    rows = []
    for row, doc, text in zip(docs.column("_row").to_pylist(), docs.column("doc_id").to_pylist(), docs.column("text"), strict=True):
        raw = (text.as_py() or "").encode()
        mine = cut[np.searchsorted(cut["row"], row, "left") : np.searchsorted(cut["row"], row, "right")]
        kept, at, removed, spans, reach = [], 0, 0, 0, -1
        for a, b in zip(mine["a"].tolist(), mine["b"].tolist(), strict=True):
            if a > reach:
                spans += 1
                kept.append(raw[at:a])
                removed += b - a
                at = reach = b
            elif b > reach:
                removed += b - reach
                at = reach = b
        kept.append(raw[at:])
        left = b"".join(kept)
        rows.append((doc, len(raw), removed, spans, hashlib.sha256(left).hexdigest(), left))
    types = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())][: 5 + with_text]
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=False)], schema=pa.schema(types))


def _placed(dealt: DataFrame, parts: int) -> DataFrame:
    """Each part's records in a partition of its own, by kind."""
    return dealt.repartitionById(parts, F.col("key").bitwiseAND((1 << 40) - 1).cast("int")).sortWithinPartitions("key")


def _part_column(parts: int) -> Column:
    return F.pmod(F.col("_row").bitwiseXOR(F.shiftright("_row", 17)), F.lit(parts).cast("long"))


def dedup(work: Work, docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (bytes) of every row of ``docs``."""
    if not 8 <= length <= LENGTH:
        raise ValueError(f"length must be from 8 to {LENGTH}")
    rows = with_rows(work, docs.select("doc_id", "text"), ordered=True)
    rows = rows.select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, -(-total // bucket_bytes))
    dealt = rows.select("_row", "text").mapInArrow(functools.partial(_sample, length, parts), DEALT)
    sorted_ = _placed(dealt, parts).mapInArrow(by_key(functools.partial(_sort, length, parts)), DEALT)
    found = work.write(sorted_, "sorted")
    kind = F.shiftright("key", 40)
    placed = rows.withColumn("part", _part_column(parts))
    part = F.col("key").bitwiseAND((1 << 40) - 1).alias("part")
    asks = found.where(kind == ASK).select(part, "data")
    answered = placed.select("part", "_row", "text").groupBy("part").cogroup(asks.groupBy("part")).applyInArrow(functools.partial(_answer, length, parts), DEALT)
    strings = found.where(kind == STRING).unionByName(answered)
    settled = _placed(strings, parts).mapInArrow(by_key(functools.partial(_sort_strings, length, parts)), DEALT)
    settled = work.write(settled, "settled")
    cuts = found.where(kind == REMOVE).unionByName(settled.where(kind == REMOVE)).select(part, "data")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return placed.groupBy("part").cogroup(cuts.groupBy("part")).applyInArrow(functools.partial(_remove, with_text), schema)
