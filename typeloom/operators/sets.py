"""Keep-last upserts, deletions, sampling, splitting, batching and other table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of the rows with equal keys the one that comes last in ``order`` (ascending columns)."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order]))
    return rows.withColumn("__last", last).filter("__last = 1").drop("__last")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with rows replaced by ``new`` rows of equal keys; the sides are not windowed, so a key is free to be hot."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_matching(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def prefer(rows: DataFrame, keys: list[str], *preferred: Column) -> DataFrame:
    """Per key, rows for which the conditions hold, each unless that leaves none."""
    for condition in preferred:
        best = rows.groupBy(*keys).agg(F.max(condition.cast("int")).alias("__any"))
        rows = rows.join(best, keys).filter(condition | (F.col("__any") == 0)).drop("__any")
    return rows


def only_modules(rows: DataFrame, modules: list[str] | None, column: str = "module_id") -> DataFrame:
    """Rows of the modules; of all if none are named."""
    return rows.filter(F.col(column).isin(list(modules))) if modules else rows


def top_k(rows: DataFrame, k: int, *order, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(k) if offset else rows.orderBy(*order).limit(k)


def shuffled_key(key: list[str], seed: int) -> Column:
    """What a repeatable shuffle is ordered by: a digest of the seed and the key, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def sample_exactly(rows: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """``n`` rows (all if there are fewer) with equal chances, repeatable for the same seed and key."""
    return rows.withColumn("__h", shuffled_key(key, seed)).orderBy("__h", *key).limit(n).drop("__h")


def split_half(rows: DataFrame, key: list[str], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A repeatable random split in two halves of sizes that differ by at most one, without sorting in one task.

    Rows are numbered in the order of their digests: first its leading digits' counts are summed, then each such part is numbered by itself.
    """
    both = rows.withColumn("__h", shuffled_key(key, seed)).withColumn("__p", F.left("__h", F.lit(3)))
    counts = both.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")  # 4,096 rows at most
    inside = F.row_number().over(Window.partitionBy("__p").orderBy("__h", *key))
    numbered = both.withColumn("__i", inside).join(F.broadcast(before), "__p").withColumn("__r", F.col("__before") + F.col("__i"))
    return tuple(numbered.filter(F.col("__r") % 2 == odd).drop("__h", "__p", "__i", "__before", "__r") for odd in (1, 0))


def batches(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Rows with the number of their batch of ``n``, in order, without sorting in one task.

    Rows are range-partitioned and written or kept as they lie, as partitions are then counted and numbered in
    two passes; offsets of the partitions come from their counts.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    context = rows.sparkSession.sparkContext
    shared = rows.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared and not context.getCheckpointDir():
        context.setCheckpointDir(shared)
    parts = parts.checkpoint() if shared else parts.persist()
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    counts = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")
    numbered = parts.withColumn("__i", inside).join(F.broadcast(before), "__p")
    return numbered.withColumn("batch", F.floor((F.col("__before") + F.col("__i") - 1) / n).cast("long")).drop("__p", "__i", "__before")


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of ``right`` takes one equal row away."""
    return left.exceptAll(right)


def group_results(results: DataFrame, key: list[str], score: str = "score", tie: str = "value_id") -> DataFrame:
    """Groups of results in order of their best member: best, size, and how many more there are."""
    best = F.max_by(F.struct(*[c for c in results.columns if c not in key]), F.struct(F.col(score), -F.col(tie)))
    return results.groupBy(*key).agg(best.alias("best"), F.count(F.lit(1)).alias("members")).withColumn("more", F.col("members") - 1).orderBy(F.desc(f"best.{score}"), F.asc(f"best.{tie}"))
