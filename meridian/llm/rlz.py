"""Removal of repeated word runs by a relative Lempel-Ziv parse of the corpus against itself.

A word goes if a window of ``length`` consecutive words that covers it also starts anywhere else, in another
document or in the same one.  Words lie between ASCII white space; windows are judged on the input.

**Reference blocks.**  Of the runs of GRAM words in a window, the one with the smallest hash (the leftmost of
equals) is the window's anchor, so equal windows have equal anchors at the same place.  Consecutive windows with
one anchor are a *phrase*, about 2 / (length - GRAM + 2) a word.  All phrases around one anchor gram are a reference
block: a document is parsed against every block that it shares an anchor with, and no other block can
hold a match of ``length`` words.

**Parse.**  Blocks are indexed by the phrases' fingerprints, as plain aggregations and joins:

1. A phrase that occurs elsewhere is one factor, with the place that it copies.
2. In a block with several different phrases, factors may begin or end inside of phrases.  There every window
   of each different phrase is looked up in a second index, of the windows of all such phrases; a window found at
   another place is a factor of ``length`` words.  A phrase that occurs twice needs no look-up itself.
3. In its document, a factor goes on greedily as long as the next one copies what follows in the same
   source.  Windows across the boundary of two factors have been looked up by themselves (2), so none is lost.

Every factor is long enough by construction; the words that factors cover go.

Equal phrases and windows are counted before they are shuffled, no task gathers a block, and a document's own
factors are the only list.  Whole texts are shuffled only for documents with phrases to look up and for those
with factors.  Fingerprints have 128 bits of word hashes that have 128 bits themselves.

Null texts are empty, texts of fewer than ``length`` words have no window; rows with a null or repeated doc_id
are documents of their own.  Only ``doc_id`` and ``text`` are read, so no other column can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import Work, batches, with_rows

LENGTH = 35
GRAM = 8
#: Bytes of text that are parsed together.
AT_ONCE = 1 << 20
#: Ids of documents that are broadcast to choose rows before a shuffle (8 bytes each); beyond, all rows are shuffled.
BROADCAST_IDS = 1_000_000

_SPACES = re.compile(rb"[\x20\x09-\x0d]+")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OTHER = np.uint64(0x2545F4914F6CDD1D)


def _edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about AT_ONCE bytes that end between words."""
    at = 0
    while at < len(data):
        end = min(len(data), at + AT_ONCE)
        while end < len(data) and not _SPACE[data[end]]:
            ahead = np.flatnonzero(_SPACE[data[end : end + AT_ONCE]])
            end = end + int(ahead[0]) if len(ahead) else min(len(data), end + AT_ONCE)
        yield at, end
        at = end


def _sums(values: np.ndarray, which: int) -> np.ndarray:
    up, _ = hashing.powers(len(values), which)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its smallest (the leftmost of equals)."""
    place, low, have = np.arange(len(values)), values, 1
    while have < width:
        step = min(have, width - have)
        right = low[step:] < low[:-step]
        place = np.where(right, place[step:], place[:-step])
        low = np.where(right, low[step:], low[:-step])
        have += step
    return place


class _Stream:
    """The words of some texts, a stretch at a time, each with the last ``length - 1`` words before it."""

    def __init__(self, raws: list[bytes], length: int):
        self.data = np.frombuffer(b"\n".join(raws), np.uint8)
        size = np.array([len(r) for r in raws], np.int64)
        self.start = np.cumsum(size + 1) - size - 1
        self.n_words = np.zeros(len(raws), np.int64)
        self.length = length

    def __iter__(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Text number, place in its text and two hashes of each word."""
        kept = [np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64)]
        for at, end in _pieces(self.data):
            part = self.data[at:end]
            first, last = _edges(part)
            if not len(first):
                continue
            n = (last - first).astype(np.uint64)
            h = [hashing.mix(hashing.between(hashing.prefix(part, w), first, last, w) + n * _OTHER) for w in (0, 1)]
            text = np.searchsorted(self.start, first + at, side="right") - 1
            new = np.flatnonzero(np.diff(text, prepend=-1))  # a text's first word here
            ran = np.diff(np.append(new, len(text)))
            place = np.arange(len(text)) - np.repeat(new, ran) + np.repeat(self.n_words[text[new]], ran)
            self.n_words[text[new]] += ran
            kept = [np.concatenate(pair) for pair in zip(kept, (text, place, *h), strict=True)]
            yield tuple(kept)
            kept = [k[max(0, len(k) - self.length + 1) :] for k in kept]


def phrases(raws: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Text number, first word, windows, anchor gram and two fingerprints of each phrase; and the words of each text last."""
    stream, out = _Stream(raws, length), []
    gram = min(GRAM, length)
    for text, place, h, g in stream:
        n = len(text) - length + 1
        if n <= 0:
            continue
        sums = (_sums(h, 0), _sums(g, 1))
        at = np.arange(len(text) - gram + 1)
        grams = hashing.mix(hashing.between(sums[0], at, at + gram, 0))
        anchor = _leftmost_min(grams, length - gram + 1)[:n]
        valid = text[:n] == text[length - 1 :]
        starts = valid & ~(np.concatenate([[False], valid[:-1] & (anchor[1:] == anchor[:-1]) & (text[1:n] == text[: n - 1])]))
        first = np.flatnonzero(starts)
        if not len(first):
            continue
        run = np.cumsum(starts)[valid] - 1
        windows = np.bincount(run, minlength=len(first))
        end = first + windows + length - 1
        prints = [hashing.between(sums[w], first, end, w) for w in (0, 1)]
        out.append((text[first], place[first], windows, grams[anchor[first]], *prints))
    empty = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 3
    return (*(np.concatenate(c) for c in zip(*out, strict=True)), stream.n_words) if out else (*empty, stream.n_words)


def windows(raws: list[bytes], length: int, asked: list[list[tuple[int, int]]]) -> tuple[np.ndarray, ...]:
    """Text number, first word and two fingerprints of the windows that start in the asked (first, windows) stretches of each text, which don't overlap."""
    out = []
    counts = np.array([len(a) for a in asked])
    first = np.array([s for a in asked for s, _ in a], np.int64)
    last = np.array([s + n for a in asked for s, n in a], np.int64)
    owner = np.repeat(np.arange(len(raws)), counts)
    order = np.lexsort((first, owner))
    first, last, owner = first[order], last[order], owner[order]
    for text, place, h, g in _Stream(raws, length):
        n = len(text) - length + 1
        if n <= 0 or not len(first):
            continue
        # the last asked stretch that starts at or before a window, in its text
        scale = int(max(place.max(), last.max())) + 2
        k = np.searchsorted(owner * scale + first, text[:n] * scale + place[:n], side="right") - 1
        hit = (k >= 0) & (text[:n] == text[length - 1 :])
        hit &= (owner[k] == text[:n]) & (place[:n] < last[k])
        at = np.flatnonzero(hit)
        prints = [hashing.mix(hashing.between(_sums(v, w), at, at + length, w)) for w, v in enumerate((h, g))]
        out.append((text[at], place[at], *prints))
    empty = (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else empty


def factors(found: list[tuple[int, int, int, int]], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """Greedy factors (first word, words, source row, source's first word) from found (first window, windows, source row, source place)."""
    out: list[list[int]] = []
    for s, n, row, at in sorted(found):
        last = out[-1] if out else None
        if last and last[2] == row and last[3] - last[0] == at - s and s <= last[0] + last[1] - length + 1:
            last[1] = max(last[1], s + n + length - 1 - last[0])
        else:
            out.append([s, n + length - 1, row, at])
    return [tuple(f) for f in out]


def spans(parsed: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The maximal runs (first, end) of words that factors cover."""
    out: list[list[int]] = []
    for s, n, *_ in sorted(parsed):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n)
        else:
            out.append([s, s + n])
    return [tuple(x) for x in out]


def _spaced(raw: bytes) -> bytes:
    return _SPACES.sub(b" ", raw).strip(b" ")


def without(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    """The words of a text outside of the runs, joined by single spaces."""
    first, last = _edges(np.frombuffer(raw, np.uint8))
    stay = zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(first)], strict=True)
    return b" ".join(_spaced(raw[first[a] : last[b - 1]]) for a, b in stay if a < b)


def _raws(batch: pa.RecordBatch) -> list[bytes]:
    return [r or b"" for r in batch.column("text").cast(pa.binary()).to_pylist()]


def _lists(owner: np.ndarray, n: int, columns: dict[str, np.ndarray]) -> pa.Array:
    """A list of structs for each of ``n`` rows from columns in the order of ``owner``."""
    offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c.view(np.int64)) for c in columns.values()], list(columns)))


def _only(docs: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """``docs`` whose ``_row`` may be among ``ids``: chosen before the shuffle that follows, if the ids are few."""
    return docs.join(F.broadcast(ids), "_row", "left_semi") if ids.count() <= limit else docs


def parse(work: Work, docs: DataFrame, length: int = LENGTH, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The factors of every document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``, ``factors`` (first word, words, source row,
    source's first word) and ``kept`` (the text left, words joined by single spaces; null: nothing was removed).  A row's number is its doc_id where those are unique.
    """
    docs = with_rows(work, docs.select("doc_id", F.col("text").cast("string").alias("text")))
    id_type = dict(docs.dtypes)["doc_id"]

    def to_phrases(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = _raws(batch)
        text, place, n, gram, a, b, n_words = phrases(raws, length)
        order = np.argsort(text, kind="stable")
        columns = {"f": gram[order], "a": a[order], "b": b[order], "s": place[order], "n": n[order].astype(np.int64)}
        digests = [hashlib.sha256(_spaced(r)).hexdigest() for r in raws]
        return pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array(n_words), pa.array(digests, pa.string()), _lists(text[order], len(raws), columns)], ["_row", "doc_id", "n_words", "sha", "phrases"])

    schema = f"_row long, doc_id {id_type}, n_words long, sha string, phrases array<struct<f: long, a: long, b: long, s: long, n: long>>"
    read = work.write(docs.select("_row", "doc_id", "text").mapInArrow(batches(to_phrases, AT_ONCE), schema), "phrases")
    every = read.select("_row", F.inline("phrases"))
    place = F.struct("_row", "s")
    # written, so that Spark can split the joins at what occurs very often
    index = work.write(every.groupBy("f", "a", "b").agg(F.count("*").alias("times"), F.min(place).alias("low"), F.max(place).alias("high"), F.min("n").alias("n")), "index")
    many = index.where("times > 1").select("f", "a", "b", "low", "high")

    def copied(found: DataFrame) -> DataFrame:
        source = F.when((F.col("low._row") == F.col("_row")) & (F.col("low.s") == F.col("s")), F.col("high")).otherwise(F.col("low"))
        return found.select("_row", "s", "n", source.alias("source")).select("_row", "s", "n", F.col("source._row").alias("row"), F.col("source.s").alias("at"))

    whole = copied(every.join(many, ["f", "a", "b"]))

    several = index.groupBy("f").agg(F.count("*").alias("c")).where("c > 1").select("f")
    asked = index.join(several, "f", "left_semi").select("low._row", "low.s", "n", (F.col("times") == 1).alias("open"))
    asked = work.write(asked.groupBy("_row").agg(F.collect_list(F.struct("s", "n", "open")).alias("asked")), "asked")

    def to_windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        wanted = [sorted((q["s"], q["n"], q["open"]) for q in row) for row in batch.column("asked").to_pylist()]
        text, at, f, g = windows(_raws(batch), length, [[q[:2] for q in row] for row in wanted])
        is_open = np.zeros(len(text), bool)
        bounds = np.searchsorted(text, np.arange(len(wanted) + 1)) if np.all(np.diff(text) >= 0) else None
        assert bounds is not None
        for k, row in enumerate(wanted):
            own = at[bounds[k] : bounds[k + 1]]
            which = np.searchsorted([q[0] for q in row], own, side="right") - 1
            is_open[bounds[k] : bounds[k + 1]] = np.array([q[2] for q in row], bool)[which]
        rows = batch.column("_row").to_numpy(zero_copy_only=False)[text]
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(at), pa.array(is_open), pa.array(f.view(np.int64)), pa.array(g.view(np.int64))], ["_row", "s", "open", "f", "g"])

    texts = docs.select("_row", "text")
    seeds = _only(texts, asked.select("_row"), broadcast_ids).join(asked, "_row").select("_row", "text", "asked")
    seeds = work.write(seeds.mapInArrow(batches(to_windows, AT_ONCE), "_row long, s long, open boolean, f long, g long"), "windows")
    seen = seeds.groupBy("f", "g").agg(F.count("*").alias("times"), F.min(place).alias("low"), F.max(place).alias("high")).where("times > 1")
    seen = work.write(seen.select("f", "g", "low", "high"), "seen")
    single = copied(seeds.where("open").join(seen, ["f", "g"]).withColumn("n", F.lit(1).cast("long")))

    found = work.write(whole.unionByName(single).groupBy("_row").agg(F.collect_list(F.struct("s", "n", "row", "at")).alias("found")), "found")

    def to_kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for raw, hits in zip(_raws(batch), batch.column("found").to_pylist(), strict=True):
            parsed = factors([(h["s"], h["n"], h["row"], h["at"]) for h in hits], length)
            gone = spans(parsed)
            kept = without(raw, gone)
            rows.append((sum(b - a for a, b in gone), hashlib.sha256(kept).hexdigest(), [dict(zip(("start", "words", "row", "at"), f, strict=True)) for f in parsed], kept.decode()))
        factor = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "words", "row", "at")]))
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), factor, pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("_row"), *columns], ["_row", "n_removed", "kept_sha256", "factors", "kept"])

    cut = _only(texts, found.select("_row"), broadcast_ids).join(found, "_row").select("_row", "text", "found")
    factor = "array<struct<start: long, words: long, row: long, at: long>>"
    cut = work.write(cut.mapInArrow(batches(to_kept, AT_ONCE), f"_row long, n_removed long, kept_sha256 string, factors {factor}, kept string"), "kept")
    none = F.array().cast(factor)
    return read.select("_row", "doc_id", "n_words", "sha").join(cut, "_row", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("factors", none).alias("factors"), "kept"
    )


#: Held against op11 in DuckDB: every window as text, counted over the corpus.
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w)),
again AS (SELECT k FROM starts GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM starts JOIN again USING (k)),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
seen AS (SELECT word.doc_id, word.i, x, max(hit.i) OVER (PARTITION BY word.doc_id ORDER BY word.i) AS last FROM word LEFT JOIN hit ON hit.doc_id = word.doc_id AND hit.i = word.i),
kept AS (SELECT doc_id, count(*) FILTER (WHERE last IS NOT NULL AND i < last + 35) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE last IS NULL OR i >= last + 35), '') AS t FROM seen GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
