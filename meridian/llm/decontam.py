"""Benchmark decontamination: BM25 search of every training passage in an inverted index of test items.

Each document is cut into windows of words that overlap by half and are twice as long as the longest
item, so that a leaked item lies whole in some window.  A window is a query: its distinct words score
the items by BM25, as a share of the score that the item's own text would get.  Items with a share of
``min_score`` or more are retrieved, all of them, by block-max WAND: posting lists in the order of the
items, cut into blocks with their largest impact.  The first item that the lists before it could lift
to the threshold by their largest impacts is the pivot; if the blocks around it can't, the cursors skip
to where a block ends, and only else is the pivot scored.  Most windows have no item that their words
could lift to the threshold by their largest impacts within a short run of items; that is seen for all
windows of a batch at once, and the others are searched one by one.

A retrieved item is a leak if the window holds enough of the five-word shingles of its question and
of its answer: ``item_parts`` cuts a text at its last sentence.

The index is built by Spark: document frequencies by an aggregation, then the posting lists of parts
of about ``part_bytes`` of test items, each by one task.  Tasks get the parts as a broadcast of at most
about ``broadcast_bytes`` and search them one after another in one pass over the documents; a larger
benchmark takes a pass for each such share of it, and nothing else of it is ever on the driver.

Null or empty items and texts match nothing; repeated items are found each, as are rows with repeated
doc_ids.
"""

from __future__ import annotations

import functools
import math
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, whole_rows, with_rows

MIN_SCORE = 0.5
MIN_OVERLAP = 0.5
SHINGLE = 5
#: Postings in a block.
BLOCK = 16
#: Items in a run for which all windows of a batch are bounded at once, and bounds held meanwhile.
GROUP = 4
BOUNDS_AT_ONCE = 1 << 21
K1, B = 1.2, 0.75
PART_BYTES = 8 << 20
BROADCAST_BYTES = 128 << 20
WORDS_AT_ONCE = 1 << 16

# What separates words besides white space, all ASCII punctuation.
_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def words_of(text: str) -> list[bytes]:
    """Lower-case words of a whole text, as UTF-8."""
    return text.lower().encode().translate(_PUNCTUATION).split()


def item_parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of question and answer: the last sentence is the answer; of a single sentence, its second half."""
    ends = [m.end() for m in re.finditer(r"[.?!]\s", text.strip())]
    if ends:
        q, a = words_of(text.strip()[: ends[-1]]), words_of(text.strip()[ends[-1] :])
        if q and a:
            return q, a
    words = words_of(text)
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


def _shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


@dataclass
class Index:
    """Posting lists of words, with BM25 impacts as shares of an item's own score."""

    item_ids: list[int]
    parts: list[tuple[list[bytes], list[bytes]]]
    window: int
    words: dict[bytes, int]
    #: postings of word w: from start[w] to start[w + 1], by item
    start: np.ndarray = field(repr=False)
    items: np.ndarray = field(repr=False)
    impacts: np.ndarray = field(repr=False)
    #: blocks of word w: from block_start[w] to block_start[w + 1]
    block_start: np.ndarray = field(repr=False)
    block_last: np.ndarray = field(repr=False)
    block_max: np.ndarray = field(repr=False)
    #: the largest impact of each word; of words that no item has, the last entry
    word_max: np.ndarray = field(repr=False)
    #: runs of GROUP items in which word w occurs, with its largest impact there: from group_start[w] to group_start[w + 1]
    group_start: np.ndarray = field(repr=False)
    groups: np.ndarray = field(repr=False)
    group_max: np.ndarray = field(repr=False)


def build(items: list[tuple[int, str]], df: Mapping[bytes, int], n_items: int, mean_words: float, window: int) -> Index:
    """``df``, ``n_items``, ``mean_words``: of the whole benchmark, also where ``items`` is a part of it."""
    kept = [(i, words_of(t), item_parts(t)) for i, t in items]
    kept = [x for x in kept if x[1]]
    words = {w: k for k, w in enumerate(sorted({w for _, ws, _ in kept for w in ws}))}
    posted: list[tuple[int, int, float]] = []
    for number, (_, ws, _) in enumerate(kept):
        norm = K1 * (1 - B + B * len(ws) / mean_words)
        own = [(words[w], number, math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + norm)) for w, f in Counter(ws).items()]
        total = max(sum(x for _, _, x in own), 1e-9)
        posted += [(w, n, x / total) for w, n, x in own]
    posted.sort()
    word, item = (np.array([p[k] for p in posted], np.int32) for k in (0, 1))
    impact = np.array([p[2] for p in posted], np.float32)
    count = np.bincount(word, minlength=len(words)).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(count)])
    block_start = np.concatenate([[0], np.cumsum(-(-count // BLOCK))])
    of = np.repeat(np.arange(len(words)), np.diff(block_start))  # the word of each block
    first = start[of] + (np.arange(len(of)) - block_start[of]) * BLOCK
    last = np.minimum(first + BLOCK, start[of + 1]) - 1
    block_max = np.maximum.reduceat(impact, first) if len(first) else impact
    word_max = np.append(np.maximum.reduceat(impact, start[:-1]) if len(words) else [], 0).astype(np.float32)
    grouped = word.astype(np.int64) * (len(kept) // GROUP + 1) + item // GROUP
    cut = np.flatnonzero(np.diff(grouped, prepend=-1))
    group_start = np.concatenate([[0], np.cumsum(np.bincount(word[cut], minlength=len(words)))]) if len(words) else np.zeros(1, np.int64)
    group_max = np.maximum.reduceat(impact, cut) if len(cut) else impact
    return Index([i for i, _, _ in kept], [p for _, _, p in kept], window, words, start, item, impact, block_start, item[last], block_max, word_max, group_start, item[cut] // GROUP, group_max)


def _hopeful(index: Index, word: np.ndarray, at: np.ndarray, ends: np.ndarray, floor: float) -> np.ndarray:
    """The windows (words at..ends) whose words could lift some item to ``floor``, by their largest impacts in each run of items."""
    n_groups = len(index.item_ids) // GROUP + 1
    n = np.append(index.group_start[1:] - index.group_start[:-1], 0)[word]
    load = np.add.reduceat(n, at) + n_groups
    cuts = np.flatnonzero(np.diff(np.cumsum(load) // BOUNDS_AT_ONCE, prepend=-1))
    good = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
        own = word[at[a] : ends[b - 1]]
        m = n[at[a] : ends[b - 1]]
        posted = np.repeat(index.group_start[own] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        window = np.repeat(np.arange(b - a), np.add.reduceat(m, at[a:b] - at[a]))
        bounds = np.bincount(window * n_groups + index.groups[posted], index.group_max[posted], (b - a) * n_groups)
        good.append(a + np.flatnonzero(bounds.reshape(b - a, n_groups).max(1) >= floor))
    return np.concatenate(good)


def wand(index: Index, words: list[int], floor: float) -> list[tuple[int, float]]:
    """(item's number, score) of every item that the words lift to ``floor``, by block-max WAND."""
    items, impacts = memoryview(index.items), memoryview(index.impacts)
    block_last, block_max = memoryview(index.block_last), memoryview(index.block_max)
    end = len(index.item_ids)
    # cursors: item, posting, end of postings, first block, end of blocks, largest impact
    live = [[0, int(index.start[w]), int(index.start[w + 1]), int(index.block_start[w]), int(index.block_start[w + 1]), float(index.word_max[w])] for w in words]
    for c in live:
        c[0] = items[c[1]]
    found = []
    while live:
        live.sort(key=itemgetter(0))
        reach, k = 0.0, -1
        while reach < floor:
            k += 1
            if k == len(live):
                return found
            reach += live[k][5]
        pivot = live[k][0]
        while k + 1 < len(live) and live[k + 1][0] == pivot:
            k += 1
        bound, skip = 0.0, live[k + 1][0] if k + 1 < len(live) else end
        for c in live[: k + 1]:
            c[3] = bisect_left(block_last, pivot, c[3], c[4])
            if c[3] < c[4]:
                bound += block_max[c[3]]
                skip = min(skip, block_last[c[3]] + 1)
        if bound < floor:
            target = skip
        elif live[0][0] < pivot:
            target = pivot
        else:
            found.append((pivot, sum(impacts[c[1]] for c in live[: k + 1])))
            target = pivot + 1
        for c in live[: k + 1]:
            if c[0] < target:
                c[1] = bisect_left(items, target, c[1], c[2])
                c[0] = items[c[1]] if c[1] < c[2] else end
        live = [c for c in live if c[0] < end]
    return found


def search(index: Index, texts: list[list[bytes]], min_score: float, min_overlap: float, shingle: int) -> list[tuple[int, int, float, float, float]]:
    """(text's number, item, score, question's overlap, answer's overlap) of the leaks; the best window of each item."""
    get, other, step = index.words.get, len(index.words), max(1, index.window // 2)
    floor = min_score - 1e-4  # bounds are sums of floats
    halves = np.array([max(1, -(-len(w) // step)) for w in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(halves)])  # a window starts at each half and ends with the next one
    ids = np.array([get(w, other) for words in texts for w in words], np.int64)
    half = np.concatenate([first[d] + np.arange(len(w)) // step for d, w in enumerate(texts)]) if len(ids) else ids
    half, ids = half[ids != other], ids[ids != other]
    second = ~np.isin(half, first[:-1])
    keys = np.sort(np.concatenate([half * (other + 1) + ids, (half[second] - 1) * (other + 1) + ids[second]]))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys  # each word of a window once
    window, word = keys // (other + 1), keys % (other + 1)
    at = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])) if len(window) else window
    if not len(at):
        return []
    ends = np.append(at[1:], len(window))
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    for k in _hopeful(index, word, at, ends, floor):
        lo, hi = int(at[k]), int(ends[k])
        for col, score in wand(index, word[lo:hi].tolist(), floor):
            score = round(score, 6)
            doc = int(np.searchsorted(first, window[lo], side="right") - 1)
            if score < min_score or ((doc, col) in found and found[doc, col][0] >= score):
                continue
            start = int(window[lo] - first[doc]) * step
            passage = texts[doc][start : start + index.window]
            question, answer = (_shingles(p, shingle) for p in index.parts[col])
            q = _overlap(question, passage)
            a = _overlap(answer, passage) if answer else q
            if q >= min_overlap and a >= min_overlap:
                found[doc, col] = (score, q, a)
    return [(d, index.item_ids[c], *v) for (d, c), v in sorted(found.items())]


def _overlap(wanted: set[tuple[bytes, ...]], window: list[bytes]) -> float:
    if not wanted:
        return 0.0
    size = len(next(iter(wanted)))
    return len(wanted & {tuple(window[i : i + size]) for i in range(len(window) - size + 1)}) / len(wanted)


@functools.lru_cache(maxsize=32)
def _loaded(name: str, k: int, raw: bytes) -> Index:
    """A worker's index of part k of a benchmark."""
    return pickle.loads(raw)


def _run(shared: Broadcast, options: tuple[float, float, int], incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, parts = shared.value

    def flush(rows: list[tuple[int, int]], texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        hits = [(*rows[d], *rest) for k, raw in enumerate(parts) for d, *rest in search(_loaded(name, k, raw), texts, *options)]
        if hits:
            types = [pa.int64()] * 3 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), types, strict=True)], ["_row", "doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    for batch in incoming:
        rows: list[tuple[int, int]] = []
        texts: list[list[bytes]] = []
        size = 0
        for i in range(batch.num_rows):
            text = batch.column(2)[i].as_py()
            if text:
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
                texts.append(words_of(text))
                size += len(texts[-1])
                if size >= WORDS_AT_ONCE:
                    yield from flush(rows, texts)
                    rows, texts, size = [], [], 0
        if texts:
            yield from flush(rows, texts)


def _item_words(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, text) to (part, word) for each different word of an item, and (part, null, number of words) for each item."""
    for batch in incoming:
        parts, words, sizes = [], [], []
        for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = words_of(text)
            different = sorted(set(own))
            parts += [part] * (len(different) + 1)
            words += [None, *different]
            sizes += [len(own), *[None] * len(different)]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(words, pa.binary()), pa.array(sizes, pa.int64())], ["part", "word", "n"])


def index_parts(work: Work, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The benchmark's index: (part, index: pickled :class:`Index`), none if it has no item with words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    items = work.write(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "items")
    words = work.write(items.select("part", "text").mapInArrow(_item_words, "part long, word binary, n long"), "words")
    n, mean, longest = words.where("n > 0").agg(F.count("*"), F.avg("n"), F.max("n")).first()
    schema = "part long, index binary"
    if not n:
        return work.spark.createDataFrame([], schema)
    df = work.write(words.where("word is not null").groupBy("word").agg(F.count("*").alias("df")), "frequencies")
    known = words.where("word is not null").select("part", "word").distinct().join(df, "word")

    def built(group: pa.Table, known: pa.Table) -> pa.Table:
        own = sorted(zip(group.column("item_id").to_pylist(), group.column("text").to_pylist(), strict=True))
        index = build(own, dict(zip(known.column("word").to_pylist(), known.column("df").to_pylist(), strict=True)), n, mean, 2 * longest)
        part = group.column("part")[:1]
        return pa.table({"part": part, "index": pa.array([pickle.dumps(index)], pa.binary())}) if group.num_rows else pa.table({"part": pa.array([], pa.int64()), "index": pa.array([], pa.binary())})

    return work.write(items.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(built, schema), "index")


def _leaks(work: Work, rows: DataFrame, benchmark: DataFrame, min_score: float, min_overlap: float, shingle: int, part_bytes: int, broadcast_bytes: int) -> DataFrame:
    schema = "_row long, doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    texts = rows.select(F.col("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.select("_row", "doc_id", F.lit(0).cast("long").alias("item_id"), *[F.lit(0.0).alias(c) for c in ("score", "question_overlap", "answer_overlap")]).limit(0)
    share: list[bytes] = []

    def searched() -> DataFrame:
        shared = work.spark.sparkContext.broadcast((f"{work.path}/{id(share)}/{len(share)}", list(share)))
        share.clear()
        return texts.mapInArrow(functools.partial(_run, shared, (min_score, min_overlap, shingle)), schema)

    passes = []
    for r in index_parts(work, benchmark, part_bytes).toLocalIterator():
        if share and sum(map(len, share)) + len(r["index"]) > broadcast_bytes:
            passes.append(searched())
        share.append(bytes(r["index"]))
    if share:
        passes.append(searched())
    return functools.reduce(DataFrame.unionByName, passes) if passes else found


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP, shingle: int = SHINGLE, part_bytes: int = PART_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every leak; rows with repeated doc_ids are searched each."""
    work = Work(docs.sparkSession, "leaks")
    rows = docs.select(F.lit(0).cast("long").alias("_row"), "doc_id", "text")
    return _leaks(work, rows, benchmark, min_score, min_overlap, shingle, part_bytes, broadcast_bytes).drop("_row")


def clean(work: Work, docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP, shingle: int = SHINGLE, part_bytes: int = PART_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs``, all their columns, in which no item leaks."""
    rows = with_rows(work, whole_rows(docs))
    bad = _leaks(work, rows, benchmark, min_score, min_overlap, shingle, part_bytes, broadcast_bytes).select("_row").distinct()
    return rows.join(bad, "_row", "left_anti").select("own.*")
