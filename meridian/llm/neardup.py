"""MinHash near-dedup of word shingles: ProbMinHash sketches, banding, verification.

A document is its set of five-word shingles, all of weight 1 however often they occur, as pairs are
decided by the Jaccard similarity of the sets.  A shingle's arrivals form a Poisson process with its
weight as rate; every arrival goes to a random register, and a register holds the shingle that came
first.  Registers of two documents agree with their probability Jaccard similarity, which with equal
weights is the Jaccard similarity of the sets.  A process is cut off once its next arrival comes later than every
register's (early termination), so long documents cost little more than one arrival a shingle.

Documents with the same shingles are one class.  Classes that agree in all registers of
a band share a bucket.  Each member of a bucket is held against the bucket's first, by the exact
Jaccard similarity of the shingle sets, and what reaches ``threshold`` is linked.  Buckets whose
members then lie in different components are searched, by their sketches, for pairs across
components that come near the threshold.  The members of such pairs get their shingle sets, and the
pairs are verified inside the bucket, the likeliest first, until they lie in one component.  So no
pair is sent anywhere, and pairs inside a component are never looked at.

Classes are named by 64-bit hashes.  Documents without words (null, empty, white space) link with
nothing and are kept.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import Work, components, whole_rows, with_rows

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 25
ROWS = 5
#: Estimates this far under the threshold are still verified: over four standard deviations.
MARGIN = 0.15
#: Members of a bucket that are compared with one another in one piece of work.
BLOCK = 512
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, occurrences) of at most 1024 texts, sorted by document and shingle; shingles have 54 bits."""
    parts = [hashing.shingles(hashing.words(t), size) for t in texts]
    doc = np.repeat(np.arange(len(parts), dtype=np.uint64), [len(p) for p in parts])
    key = np.sort((doc << np.uint64(54)) | (np.concatenate(parts) >> np.uint64(10))) if parts else np.empty(0, np.uint64)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    counts = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(54)).astype(np.int64), key & np.uint64((1 << 54) - 1), counts


def sketches(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """ProbMinHash registers (n_docs x registers, uint32); zero where a document has no shingle."""
    first = np.full(n_docs * registers, np.inf)
    held = np.zeros(n_docs * registers, np.uint32)
    name = (hashing.mix(shingle * _GOLDEN) >> np.uint64(32)).astype(np.uint32)
    active, at, state = np.arange(len(doc)), np.zeros(len(doc)), hashing.mix(shingle + _GOLDEN)
    while len(active):
        state = hashing.mix(state + _GOLDEN)
        gap = -np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        at = at + gap / weight[active]
        register = (hashing.mix(state ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(registers)).astype(np.int64)
        slot = doc[active] * registers + register
        np.minimum.at(first, slot, at)
        won = first[slot] == at
        held[slot[won]] = name[active[won]]
        last = first.reshape(n_docs, registers).max(1)
        going = at < last[doc[active]]
        active, at, state = active[going], at[going], state[going]
    return held.reshape(n_docs, registers)


def _pieces(batch: pa.RecordBatch, column: int, max_bytes: int = hashing.CHUNK, max_rows: int = 1000) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of small runs of rows; a long text is a run of its own."""
    texts: list[bytes] = []
    size, start = 0, 0
    for i in range(batch.num_rows):
        raw = (batch.column(column)[i].as_py() or "").encode()
        if texts and (size + len(raw) > max_bytes or len(texts) >= max_rows):
            yield start, texts
            texts, size, start = [], 0, i
        texts.append(raw)
        size += len(raw)
    if texts:
        yield start, texts


def _sketch(size: int, registers: int, incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row, text) to (_row, c: name of the class, null without words; n: shingles; s: sketch)."""
    for batch in incoming:
        for start, texts in _pieces(batch, 1):
            doc, shingle, _ = shingle_sets(texts, size)
            held = sketches(doc, shingle, np.ones(len(doc)), len(texts), registers)
            n = np.bincount(doc, minlength=len(texts))
            sums = np.zeros(len(texts), np.uint64)
            np.add.at(sums, doc, hashing.mix(hashing.mix(shingle) + _GOLDEN))
            name = hashing.mix(sums + n.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, len(texts)), pa.array(name, mask=n == 0), pa.array(n), pa.array([h.tobytes() if k else None for h, k in zip(held, n, strict=True)], pa.binary())],
                ["_row", "c", "n", "s"],
            )


def _keys(held: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for every band of every sketch."""
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(held), 1))
    for r in range(rows):
        keys = hashing.mix(keys * _GOLDEN + held[:, r : bands * rows : rows].astype(np.uint64))
    return keys


def _bands(bands: int, rows: int, incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        if batch.num_rows:
            held = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            keys = _keys(held, bands, rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], ["k", "c"])


def _sets(size: int, incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, text) to (c, set: the sorted shingles)."""
    for batch in incoming:
        for start, texts in _pieces(batch, 1):
            doc, shingle, _ = shingle_sets(texts, size)
            bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array([shingle[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())], ["c", "set"])


def _similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Exact Jaccard similarity of two sorted sets against the threshold."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= threshold * (len(both) - common)


def _verify(threshold: float, incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        good = [_similar(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), threshold) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))


def by_key(function: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable:
    """For mapInArrow on rows sorted by their first column: ``function`` on the rows of each key, which must be few."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in incoming:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if rest and rest[-1].column(0)[0] != part.column(0)[0]:
                    out = function(pa.Table.from_batches(rest))
                    if out is not None and out.num_rows:
                        yield out
                    rest = []
                rest.append(part)
        if rest:
            out = function(pa.Table.from_batches(rest))
            if out is not None and out.num_rows:
                yield out

    return run


def _candidates(floor: float, ratio: float, bands: int, rows: int, g: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a bucket, or of two of its blocks, that lie in different components and may reach the threshold, with estimates.

    A pair is a candidate in the first band it shares only, and not if it was held against the bucket's first before.
    """
    key, side, c, m, comp, n = (g.column(x).to_numpy() for x in ("k", "side", "c", "m", "comp", "n"))
    held = np.frombuffer(b"".join(g.column("s").to_pylist()), np.uint32).reshape(len(c), -1)
    band = int(np.flatnonzero(_keys(held[:1], bands, rows)[0].view(np.int64) == key[0])[0])
    blocks = (side != 0).any()
    us, vs, es = [], [], []
    for i in np.flatnonzero(side < 0) if blocks else range(len(c)):
        js = np.flatnonzero(side > 0) if blocks else np.arange(i + 1, len(c))
        js = js[(comp[js] != comp[i]) & (c[js] != m[js]) & (c[i] != m[i])]
        js = js[np.minimum(n[js], n[i]) >= ratio * np.maximum(n[js], n[i])]
        if len(js):
            equal = held[js] == held[i]
            estimate = equal.mean(1)
            fine = (estimate >= floor) & ~equal[:, : band * rows].reshape(len(js), band, rows).all(2).any(1)
            us.append(np.full(int(fine.sum()), i))
            vs.append(js[fine])
            es.append(estimate[fine])
    none = np.empty(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs), np.concatenate(es)) if us else (none, none, none)


def _open(floor: float, ratio: float, bands: int, rows: int, group: pa.Table) -> pa.RecordBatch | None:
    """The members of a bucket that are in some candidate pair."""
    g = group.combine_chunks()
    u, v, _ = _candidates(floor, ratio, bands, rows, g)
    return g.take(pa.array(np.unique(np.concatenate([u, v])))).combine_chunks().to_batches()[0] if len(u) else None


def _settle(threshold: float, floor: float, bands: int, rows: int, group: pa.Table) -> pa.RecordBatch | None:
    """Links across components among members that come with their shingle sets, the likeliest pairs first.

    Pairs whose components a link has joined meanwhile needn't be looked at.
    """
    g = group.combine_chunks()
    u, v, e = _candidates(floor, threshold, bands, rows, g)
    c, comp = g.column("c").to_numpy(), g.column("comp").to_pylist()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in g.column("set")]
    joined: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := joined.get(x, x)) != x:
            joined[x] = x = joined.get(up, up)
        return x

    links = []
    for k in np.lexsort((c[v], c[u], -e)):
        i, j = int(u[k]), int(v[k])
        a, b = root(comp[i]), root(comp[j])
        if a != b and _similar(sets[i], sets[j], threshold):
            joined[max(a, b)] = min(a, b)
            links.append((int(max(c[i], c[j])), int(min(c[i], c[j]))))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["u", "v"]) if links else None


def classes(work: Work, docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, margin: float = MARGIN, block: int = BLOCK) -> DataFrame:
    """(``_row``, ``g``) for rows (``_row``, ``text``): the same ``g`` for rows of one near-duplicate class, null without words."""
    texts = docs.select("_row", F.col("text").cast("string").alias("text"))
    sketched = work.write(texts.mapInArrow(functools.partial(_sketch, shingle, bands * rows), "_row long, c long, n long, s binary"), "sketches")
    reps = work.write(sketched.where("c is not null").select("c", "n", "s").dropDuplicates(["c"]), "classes")
    banded = reps.select("c", "s").mapInArrow(functools.partial(_bands, bands, rows), "k long, c long")
    buckets = banded.groupBy("k").agg(F.min("c").alias("m"), F.count("*").alias("size")).where("size > 1")
    buckets = work.write(buckets, "buckets")  # written, as all that a crowded key is joined to: Spark can split such a join
    members = work.write(banded.join(buckets, "k"), "members")

    one = sketched.where("c is not null").groupBy("c").agg(F.min("_row").alias("_row"))
    wanted = one.join(members.select("c").distinct(), "c", "left_semi")
    sets = texts.join(wanted, "_row").select("c", "text").mapInArrow(functools.partial(_sets, shingle), "c long, set binary")
    sets = work.write(sets, "sets")
    sizes = reps.select("c", "n")

    def verified(pairs: DataFrame) -> DataFrame:
        near = pairs.join(sizes.toDF("u", "nu"), "u").join(sizes.toDF("v", "nv"), "v").where(F.least("nu", "nv") >= F.lit(threshold) * F.greatest("nu", "nv"))
        both = near.select("u", "v").join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v").select("u", "v", "a", "b")
        return both.mapInArrow(functools.partial(_verify, threshold), "u long, v long")

    links = work.write(verified(members.where("c <> m").select(F.col("c").alias("u"), F.col("m").alias("v")).distinct()), "links")
    found = components(work, links).select(F.col("node").alias("c"), F.col("component").alias("comp"))
    placed = members.join(found, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    # a bucket's first has no row in ``found`` if it is the smallest of its component
    mixed = placed.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("size").alias("size")).where("lo <> hi and size > 2").select("k")
    mixed = work.write(mixed, "mixed")
    placed = placed.join(mixed, "k").join(reps, "c").select("k", "c", "m", "comp", "n", "s", "size")
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = placed.withColumn("own", F.pmod(F.xxhash64("c"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(i == j, 0).when(F.col("own") == i, -1).otherwise(1)
    dealt = dealt.select(F.xxhash64("k", i, j).alias("g"), "k", side.alias("side"), "c", "m", "comp", "n", "s")
    options = (threshold - margin, threshold, bands, rows)
    asked = dealt.repartition("g").sortWithinPartitions("g").mapInArrow(by_key(functools.partial(_open, *options)), dealt.schema)
    asked = work.write(asked, "open")
    full = asked.join(sets, "c").select(*asked.columns, "set")
    more = full.repartition("g").sortWithinPartitions("g").mapInArrow(by_key(functools.partial(_settle, threshold, threshold - margin, bands, rows)), "u long, v long")
    more = work.write(more, "links")
    work.drop(asked, sets, members)
    if not more.isEmpty():
        found = components(work, links.unionByName(more)).select(F.col("node").alias("c"), F.col("component").alias("comp"))
    return sketched.select("_row", "c").join(found, "c", "left").select("_row", F.coalesce("comp", "c").alias("g"))


def near_duplicates(work: Work, docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and kept (one row of each class) for every row of ``docs``.

    Rows without words are classes of their own.  ``options``: those of :func:`classes`.
    """
    rows = with_rows(work, docs.select("doc_id", "text"))
    return _judged(work, rows, options).select("doc_id", "class_id", "kept")


def _judged(work: Work, rows: DataFrame, options: dict) -> DataFrame:
    placed = work.write(classes(work, rows, **options), "placed")
    placed = placed.join(rows.select("_row", F.col("doc_id").cast("long").alias("doc_id")), "_row")
    first = placed.where("g is not null").groupBy("g").agg(F.min(F.struct("doc_id", "_row")).alias("f"))
    first = work.write(first, "first")
    judged = placed.join(first, "g", "left")
    return judged.select("_row", "doc_id", F.coalesce("f.doc_id", "doc_id").alias("class_id"), F.coalesce(F.col("f._row") == F.col("_row"), F.lit(True)).alias("kept"))


def dedup(work: Work, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all their columns, of which one of each class stays: the one with the smallest doc_id."""
    rows = with_rows(work, whole_rows(docs))
    gone = _judged(work, rows, options).where("not kept").select("_row")
    return rows.join(gone, "_row", "left_anti").select("own.*")
