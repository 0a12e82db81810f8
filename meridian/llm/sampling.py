"""Bounded, repeatable samples of labelled rows for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work

#: Default bounds of a training sample.
ROWS = 12_000
BYTES = 48 << 20


#: The largest text that is an example, as a share of the byte bound, where a caller names no size.
LARGEST = 1 / 64
_HASHES = 1 << 40


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, where: Column | None = None, rows: int = ROWS, max_bytes: int = BYTES, largest: int | None = None) -> list[tuple[int, str]]:
    """At most ``rows`` pairs (label, whole text), drawn by a hash of the id, of at most ``max_bytes`` of text in all.

    Null labels, ids and texts are no examples, nor is a text of more than ``largest`` bytes (by default a 64th of ``max_bytes``).
    An id that is labelled more than once counts once, with its smallest label; an id of several
    documents counts once, with the text of the smallest hash.  The draw is the same at every size:
    ids in the order of their hashes, until either bound is reached.
    """
    work = Work(docs.sparkSession, "sample")
    known = labels.where((F.lit(True) if where is None else where) & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    known = known.select(F.col("doc_id").alias("id"), "y", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(_HASHES)).alias("h"))
    n = known.count()
    share = min(_HASHES, int(_HASHES * 1.1 * rows / max(n, 1)) + 1)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("t"))
    texts = texts.where(F.col("t").isNotNull() & (F.octet_length("t") <= (int(max_bytes * LARGEST) if largest is None else largest)))
    picked = texts.join(known.where(F.col("h") < share), "id").groupBy("h", "id", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    picked = work.write(picked.withColumn("n", F.octet_length("t")), "picked")
    total, last = 0, -1
    for r in picked.select("h", "id", "n").orderBy("h", "id").limit(rows).collect():
        total += r["n"]
        if total > max_bytes:
            break
        last = r["h"]
    out = [(r["h"], r["id"], r["y"], r["t"]) for r in picked.where(F.col("h") <= last).toLocalIterator()]
    work.close()
    return [(y, t) for _, _, y, t in sorted(out)[:rows]]
