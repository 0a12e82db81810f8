"""What the operators share: reading tables, a shared work folder, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session whose tasks run in its own process gets a temporary folder; others must set it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="meridian-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: While a table is written: shuffle files go as soon as it is complete, and Python gets whole texts in batches of few rows.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


class Work:
    """A folder for the written tables of one query.  A written table cuts lineage and outlives executors.

    Tables that a result still reads stay until the session ends; :meth:`close` removes them earlier.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/meridian/{name}-{uuid.uuid4().hex}"
        self.n = 0
        path, system = self._file(self.path)
        system.deleteOnExit(path)

    def _file(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes ``df`` and reads it back; the plan before it, and its shuffle files, are released."""
        self.n += 1
        path = f"{self.path}/{self.n}-{name}"
        before = {k: self.spark.conf.get(k) for k in WHILE_WRITING}
        for k, v in WHILE_WRITING.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Removes the files of written tables that nothing reads any more."""
        for df in frames:
            for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                if self.path.split("://")[-1].lstrip("/") in file:
                    path, system = self._file(file)
                    system.delete(path, True)

    def close(self) -> None:
        """Removes every table; frames that read them can't be used any more."""
        path, system = self._file(self.path)
        system.delete(path, True)


def batches(function: Callable[[pa.RecordBatch], pa.RecordBatch | None], max_bytes: int = 8 << 20) -> Callable:
    """For mapInArrow: ``function`` on pieces of at most about ``max_bytes``, whatever Spark's batch holds."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            step = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
            for k in range(0, batch.num_rows, step):
                out = function(batch.slice(k, step))
                if out is not None and out.num_rows:
                    yield out

    return run


def whole_rows(docs: DataFrame) -> DataFrame:
    """``own``: each row of ``docs`` as one struct, beside its ``doc_id`` and ``text``; no other column can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")).select("own", "own.doc_id", F.col("own.text").cast("string").alias("text"))


def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null ids: null)."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % parts


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Edges of a graph that one file of a written round holds, where there are more files than cores.
EDGES_A_FILE = 500_000


def components(work: Work, edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph with long node ids (columns ``u``, ``v``).

    Alternating large-star and small-star rounds; each round is aggregations and equi-joins and is
    written to the shared folder.  Every round but the last moves some edge to a smaller node, and
    O(log(n)**2) rounds are enough (Kiveris et al., 2014), so the loop has no bound of its own.  Returns ``node``, ``component`` (the smallest node reachable) for
    every node with an edge to another node.  Null ends and loops are ignored.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = work.write(edges, "edges")
    mark = _mark(edges)
    if not mark[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        # what follows has about as many rows: tables of few are written as few files, whatever the number of shuffle partitions
        files = max(work.spark.sparkContext.defaultParallelism, mark[0] // EDGES_A_FILE)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that Spark can split the join at a node with many edges
        low = work.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(files), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = work.write(large.where("u <> v").distinct().coalesce(files), "large")  # u > v from here on
        work.drop(low)
        low = work.write(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(files), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = work.write(small.select("e.u", "e.v").where("u <> v").distinct().coalesce(files), "small")
        now = _mark(small)
        work.drop(edges, large, low)
        edges = small
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now


def with_rows(work: Work, docs: DataFrame, ordered: bool = False) -> DataFrame:
    """``docs`` with a unique long ``_row``: the doc_id where all are different and none is null, else a written number.

    ``ordered``: in the order of doc_id (nulls first), then text.  ``docs`` has no column of that name.
    """
    doubtful = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if doubtful.isEmpty():
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    if ordered:
        docs = docs.orderBy(F.col("doc_id").asc_nulls_first(), "text")
    return work.write(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
