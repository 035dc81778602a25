"""Helpers that the training-data operators share.

Nothing here keeps rows on the driver: lineage is cut with ``checkpoint()`` into the
folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the batches that Python gets. Spark's own limit is by rows, whatever these hold.
BATCH_BYTES = 11 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
LOWER_BYTES = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. It is set here only where none is set and all run in this process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "typeloom-checkpoints")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this package's own under the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def limit_batches(spark: SparkSession) -> None:
    """From now on this session's batches for Python hold about ``BATCH_BYTES``; a lower limit stays."""
    parsed = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < parsed(spark.conf.get(BATCH_LIMIT)) <= BATCH_BYTES:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)


def in_limited_batches(f):
    """``f``, whose first argument is a table, with :func:`limit_batches` for the jobs that it runs itself."""

    @wraps(f)
    def run(docs: DataFrame, *args, **options):
        conf = docs.sparkSession.conf
        before = conf.get(BATCH_LIMIT, None)
        limit_batches(docs.sparkSession)
        try:
            return f(docs, *args, **options)
        finally:
            if before is None:
                conf.unset(BATCH_LIMIT)
            else:
                conf.set(BATCH_LIMIT, before)

    return run


def give_back(results):
    """``results``; then the memory that is free goes back to the system, as Python workers are kept for later tasks."""
    yield from results
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, made longer until no table has a column of that name in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_of_id(id_col: str):
    """crc32 of a document's id written as text."""
    return F.crc32(F.col(id_col).cast("string"))


def word_count(col):
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def _forest(batches):
    """Spanning forest (child, root) of the edges of one partition, by union-find."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, dtype=np.int64, count=len(parent))
    roots = np.fromiter((find(int(x)) for x in nodes), dtype=np.int64, count=len(nodes))
    kept = nodes != roots
    for i in range(0, int(kept.sum()), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[kept][i : i + 65536]), pa.array(roots[kept][i : i + 65536])], names=["a", "b"])


def components(edges: DataFrame, one_task: int = 100_000) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``; root is the smallest node.

    Each partition first reduces its edges to a spanning forest, so that dense groups
    shrink to one edge a node before anything is shuffled. If at most ``one_task`` edges are left, one task
    joins the forests. Beyond that, large-star and
    small-star rounds alternate until no edge changes; only sums travel to the driver.
    Every step is a min-aggregation with map-side combining and a join on the node,
    so that a hub's edges are never gathered in one task.
    """
    work = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInArrow(_forest, "a long, b long"))

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        side = both.filter("b > a") if large else both.filter("b < a")
        out = side.join(lowest, side.a == lowest.k).select(F.col("b").alias("x"), "m")
        if not large:
            out = out.union(lowest.filter("m <> k").select(F.col("k").alias("x"), "m"))
        return out.filter("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()

    def digest(e: DataFrame):
        row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return row.n, row.s

    before = digest(work)
    if before[0] <= one_task:
        return cut(work.coalesce(1).mapInArrow(_forest, "a long, b long")).select(F.col("a").alias("node"), F.col("b").alias("root"))
    while (after := digest(work := cut(star(star(work, True), False)))) != before:
        before = after
    # At the fixed point every edge is (node, smallest node of its component).
    return work.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
