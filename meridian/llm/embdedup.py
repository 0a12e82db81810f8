"""Embedding near-dedup by cosine, with binary codes that say which pairs need exact recomputation.

Vectors are normalised and turned by a random rotation.  The signs of a turned vector ``r`` are its
code, ``s = sign(r) / sqrt(D)``, and ``f = <r, s>`` its stored correction factor.  For a vector q,
``<q, s> / f`` estimates the inner product of q and r without bias, within
``EPS * sqrt((1 - f**2) / f**2) / sqrt(D - 1)`` with high confidence.  A pair is recomputed exactly,
in double precision, unless a bound taken from either side lies under the threshold.

Pairs are sought in the buckets of sign hashes: bands of signs of further random projections.  The
number of signs in a band follows the logarithm of the number of vectors, so that buckets stay
small, and the number of bands follows from the chance that a pair just at the threshold shares
none of them (``MISS``).  A pair is looked at in the first band it shares only, so links are counted
where they are found, and no pair is ever sent anywhere: a bucket sends each member's number of links and
its root.  Buckets of more than ``BLOCK`` members are dealt out as pairs of blocks.

Equal vectors are one class and are compared once.  Vectors that are null, zero, or hold null or
non-finite components link with nothing; vectors of different lengths don't link.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, components, with_rows
from .neardup import by_key

THRESHOLD = 0.9
#: Chance that a pair at the threshold is missed.
MISS = 5e-4
#: Width of the confidence bounds.
EPS = 3.0
BLOCK = 1024
#: Members that a bucket of unrelated vectors has on average, as a power of two.
CROWD = 5
#: Rows of a table that may be broadcast.
SMALL = 20_000


@functools.lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(d)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


@functools.lru_cache(maxsize=8)
def projections(d: int, n: int) -> np.ndarray:
    """Columns of random rotations: better spread than independent directions."""
    rng = np.random.Generator(np.random.PCG64(7919 * d + n))
    return np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-n // d))], 1)[:, :n]


def plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(signs in a band, bands) for n vectors."""
    signs = min(30, max(6, math.ceil(math.log2(max(n, 2))) - CROWD))
    same = 1 - math.acos(threshold) / math.pi
    return signs, math.ceil(math.log(miss) / math.log1p(-(same**signs)))


def _unit(raw: list, d: int) -> np.ndarray:
    x = np.array(raw, np.float64).reshape(len(raw), d)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _deal(signs: int, bands: int, with_vectors: bool, incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, size, e) to a row for each band."""
    for batch in incoming:
        vectors = batch.column(2).to_pylist()
        by: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by.setdefault(len(v), []).append(i)
        for d, rows in by.items():
            for a in range(0, len(rows), 512):
                part = rows[a : a + 512]
                x = _unit([vectors[i] for i in part], d)
                bits = (x @ projections(d, signs * bands) > 0).reshape(len(part), bands, signs)
                keys = (bits.astype(np.uint32) << np.arange(signs, dtype=np.uint32)).sum(2, dtype=np.uint32)
                k = ((np.int64(d) << 48) | (np.arange(bands, dtype=np.int64) << 32)[None, :] | keys.astype(np.int64)).ravel()
                c, size = (batch.column(j).take(pa.array(np.repeat(part, bands))) for j in (0, 1))
                if not with_vectors:
                    yield pa.RecordBatch.from_arrays([pa.array(k)], ["k"])
                    continue
                turned = x @ rotation(d)
                f = np.abs(turned).sum(1) / math.sqrt(d)
                codes = np.packbits(turned > 0, axis=1)
                raw = [codes[i].tobytes() + np.float64(f[i]).tobytes() + keys[i].tobytes() + x[i].tobytes() for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([pa.array(k), c, size, pa.array([r for r in raw for _ in range(bands)], pa.binary())], ["k", "c", "size", "v"])


def _bucket(threshold: float, bands: int, eps: float, group: pa.Table) -> pa.RecordBatch | None:
    """(g, k, side, c, size, v) of a bucket, or of two of its blocks, to (c, root, links)."""
    if group.num_rows < 2:
        return None
    group = group.combine_chunks()
    k, side, c, size = (group.column(x).to_numpy() for x in ("k", "side", "c", "size"))
    m, d, band = len(c), int(k[0] >> 48), int(k[0] >> 32 & 0xFFFF)
    raw = np.frombuffer(b"".join(group.column("v").to_pylist()), np.uint8).reshape(m, -1)
    at = np.cumsum([0, -(-d // 8), 8, 4 * bands, 8 * d])
    codes, f, keys, x = (raw[:, a:b] for a, b in zip(at, at[1:], strict=False))
    f, keys, x = f.copy().view(np.float64)[:, 0], keys.copy().view(np.uint32)[:, :band], x.copy().view(np.float64)
    s = (np.unpackbits(codes, axis=1)[:, :d] * 2.0 - 1) / math.sqrt(d)
    turned = x @ rotation(d)
    error = eps * np.sqrt(np.maximum(1 - f * f, 0)) / f / math.sqrt(max(d - 1, 1))
    links, root = np.zeros(m, np.int64), np.arange(m)
    blocks = (side != 0).any()
    us, vs = [], []
    for a in range(0, m, 256):
        rows = np.arange(a, min(m, a + 256))
        most = np.minimum((turned[rows] @ s.T) / f + error, (s[rows] @ turned.T) / f[rows, None] + error[rows, None])
        near = most >= threshold
        near &= (side[rows][:, None] < side[None, :]) if blocks else (rows[:, None] < np.arange(m)[None, :])
        u, v = np.nonzero(near)
        u = u + a
        if len(u) and band:
            new = np.concatenate([~(keys[u[i : i + 65536]] == keys[v[i : i + 65536]]).any(1) for i in range(0, len(u), 65536)])
            u, v = u[new], v[new]
        if len(u):
            exact = np.concatenate([np.einsum("ij,ij->i", x[u[i : i + 65536]], x[v[i : i + 65536]]) for i in range(0, len(u), 65536)])
            u, v = u[exact >= threshold], v[exact >= threshold]
            us.append(u)
            vs.append(v)
    if not us:
        return None
    u, v = np.concatenate(us), np.concatenate(vs)
    if not len(u):
        return None
    np.add.at(links, u, size[v])
    np.add.at(links, v, size[u])
    while True:  # smallest label of each linked set
        before = root.copy()
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        root = root[root]
        if (root == before).all():
            break
    told = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(c[told]), pa.array(c[root[told]]), pa.array(links[told])], ["c", "root", "links"])


def near_duplicates(work: Work, vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, eps: float = EPS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Rows whose vec_id repeats or is null are vectors of their own; components are named by the
    smallest vec_id in them, and with repeated ids every row of that id is kept.
    """
    rows = with_rows(work, vectors.select(F.col("vec_id").alias("doc_id"), "embedding"))
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    good = F.coalesce((F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = rows.select("_row", "doc_id", F.when(good, e).alias("e")).withColumn("h", F.when(F.col("e").isNotNull(), F.xxhash64("e"))).withColumn("h2", F.when(F.col("e").isNotNull(), F.xxhash64(F.lit(31), F.reverse("e"))))
    same = rows.where("e is not null").groupBy("h", "h2").agg(F.min("_row").alias("c"), F.count("*").alias("size"))
    same = work.write(same, "classes")
    unlike = work.write(rows.select("_row", "e").join(same.select(F.col("c").alias("_row"), "size"), "_row").select(F.col("_row").alias("c"), "size", "e"), "vectors")
    signs, bands = plan(unlike.count(), threshold, miss)
    keys = unlike.mapInArrow(functools.partial(_deal, signs, bands, False), "k long")
    large = work.write(keys.groupBy("k").count().where(F.col("count") > block).withColumnRenamed("count", "members"), "large")
    dealt = unlike.mapInArrow(functools.partial(_deal, signs, bands, True), "k long, c long, size long, v binary")
    n_large = large.count()
    if n_large:
        dealt = dealt.join(F.broadcast(large) if n_large <= SMALL else large, "k", "left")
        blocks = F.ceil(F.coalesce("members", F.lit(1)) / block).cast("int")
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("c"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        i, j = F.least("own", "other"), F.greatest("own", "other")
        side = F.when(i == j, 0).when(F.col("own") == i, -1).otherwise(1)
        dealt = dealt.select(F.when(blocks == 1, F.col("k")).otherwise(F.xxhash64("k", i, j)).alias("g"), "k", side.alias("side"), "c", "size", "v")
    else:
        dealt = dealt.select(F.col("k").alias("g"), "k", F.lit(0).alias("side"), "c", "size", "v")
    found = dealt.repartition("g").sortWithinPartitions("g").mapInArrow(by_key(functools.partial(_bucket, threshold, bands, eps)), "c long, root long, links long")
    found = work.write(found, "links")
    linked = components(work, found.select(F.col("c").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    known = same.join(counts, "c", "left").join(linked.select(F.col("node").alias("c"), "component"), "c", "left")
    known = known.select("h", "h2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("g"))
    known = work.write(known, "known")  # written, so that Spark can split the join at a vector with many copies
    placed = work.write(rows.select("_row", "doc_id", "h", "h2").join(known, ["h", "h2"], "left").select("_row", "doc_id", "n_links", F.coalesce("g", "_row").alias("g")), "placed")
    names = placed.groupBy("g").agg(F.min("doc_id").alias("component_id"))
    names = work.write(names, "names")
    named = placed.join(names, "g")
    return named.select(F.col("doc_id").cast("long").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u AS vec_id, min(v) AS component_id FROM r GROUP BY u),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM l GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
