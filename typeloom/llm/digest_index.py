"""Exact deduplication against a persistent digest index (operator 9).

The index is a Parquet table in a shared folder, bucketed and sorted by digest. New
documents are reduced to one row a digest before anything is shuffled; the sort-merge
anti-join with the index then needs no shuffle of the index, and digests that are new
are appended to it.

Defined cases: null counts as the empty text; of equal texts in one batch the row with
the largest id stays (a null id only if no row has an id; of rows that repeat the id of
the one that stays, all are marked kept, as they are one document); a text that an earlier batch
indexed is a duplicate of that batch's row, so no row of the new batch stays; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, remove_folder, shared_dir, unused


class DigestIndex:
    """Digests seen so far: ``(digest string, keep_id long, group_size long)``, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int | None = None):
        """``location``: the folder to keep the index in (a new one under the shared folder by default).

        ``buckets`` must be the same each time a location is opened; it defaults to the
        session's shuffle partitions, so that joins with new data keep the bucketing.
        """
        self.spark = spark
        self.location = location or f"{shared_dir(spark).rstrip('/')}/digest-index/{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, f"{self.location}#{self.buckets}").hex
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, groups: DataFrame) -> None:
        """Append ``groups(digest, keep_id, group_size)`` whose digests the index does not have."""
        new = groups.select("digest", "keep_id", "group_size").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)

    def drop(self, files: bool = False) -> None:
        """Forget the table's name; the files stay at the location unless ``files`` is set."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if files:
            remove_folder(self.spark, self.location)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest)``: SHA-256 of each whole text in UTF-8, in lowercase hex."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(text, 256).alias("digest"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 1000, hot_share: int = 10_000) -> DataFrame:
    """Deduplicate ``docs`` against ``index`` and themselves; append what is new.

    Returns a row per document: ``(id_col, keep_id, group_size, kept, text_sha256)``.
    ``group_size`` counts the equal rows of the batch that brought the text in. Without an ``index`` that is to
    stay, one is made for this call and removed.
    """
    own_index = index is None
    index = index or DigestIndex(docs.sparkSession)
    ids = cut(digests(docs, id_col, text_col))
    groups = cut(ids.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    seen = cut(index.rows().select("digest").join(groups.select("digest"), "digest", "left_semi").withColumn("old", F.lit(True)))
    index.add(groups)
    # Texts with more than a `hot_share`-th of the rows are fewer than `hot_share`: they go to every task, so that
    # their many rows need not meet in one.
    hot = cut(groups.filter(F.col("group_size") > max(hot_rows, ids.count() // hot_share)).select("digest"))
    known = index.rows().hint("merge").join(seen, "digest", "left")
    cold = ids.join(F.broadcast(hot), "digest", "left_anti").join(known, "digest")
    heated = ids.join(F.broadcast(index.rows().join(F.broadcast(hot), "digest", "left_semi").join(seen, "digest", "left")), "digest")
    own = cold.unionByName(heated)
    kept = F.col("old").isNull() & F.col("id").eqNullSafe(F.col("keep_id"))
    out = own.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))
    if own_index:
        out = cut(out)
        index.drop(files=True)
    return out


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each id and text."""
    id_, digest = unused("kept_id", docs), unused("kept_digest", docs)
    marked = exact_dedup(docs, index, id_col, text_col).filter("kept").select(F.col(id_col).alias(id_), F.col("text_sha256").alias(digest)).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.sha2(text, 256) == F.col(digest))
    return docs.join(marked, same, "left_semi")
