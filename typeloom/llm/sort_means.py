"""Centroid clustering by sort-means (operator 11).

Vectors and centroids are whole numbers, so every distance and every mean is exact and no
result depends on the order of rows. Each round sorts, for every centroid, the other centroids by
their distance from it. A vector begins with the centroid it had before, at distance d, and scans the
others in that centroid's order; one that is strictly farther than 2d from it, and all that follow, are
farther than d from the vector, so the scan stops there. (At exactly 2d a tie is still possible, and the
smaller number wins ties.)

The vectors are written once, bucketed and sorted by row number. What a round adds, the row's centroid, is
a narrow table with the same buckets, so that the next round joins the two without a shuffle of either. The same
pass sums the vectors of each centroid in its task; one row a centroid and batch is summed up further,
and one row a centroid comes to the driver. Rounds end early once no centroid moves, since all later ones would
repeat it. The tables are in the shared folder and are removed at the end.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left out;
with fewer kept vectors than ``k`` there are as many centroids as vectors; an empty table gives no rows;
repeated rows are vectors of their own; of rows that repeat an id the one with the lesser components is the first
centroid; a null id is written as nothing in what is hashed. Components whose whole number is not within
``LARGEST`` are an error, as their squared distances do not fit a long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, remove_folder, shared_dir

#: Four times a squared distance of vectors of 64 components within this bound fits a long.
LARGEST = 1 << 26
STATE = "row long, id long, cluster int, distance long, n long, sums array<long>"


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: float) -> DataFrame:
    """``(id, v)``: the vectors that are kept, each component x as floor(scale * x)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    good = (F.size("x") == dims) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("x", lambda x: F.floor(x * F.lit(float(scale))))
    return rows.filter(F.coalesce(good, F.lit(False))).select("id", whole.alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``, in that order: a distributed top-k."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in kept.orderBy(order, "v").limit(k).select("v").collect()], dtype=np.int64)


class Order:
    """The centroids, and for each the others in the order of their distance from it."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        apart = np.array([((centroids - c) ** 2).sum(axis=1) for c in centroids])
        numbers = np.arange(len(centroids))
        self.others = np.array([[j for j in np.lexsort((numbers, apart[i])) if j != i] for i in numbers], dtype=np.int64).reshape(len(centroids), -1)
        self.apart = np.take_along_axis(apart, self.others, axis=1)

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and squared distance of each row of ``x``, scanning from ``before``; and how many distances that took."""
        best = before.astype(np.int64)
        least = ((x - self.centroids[best]) ** 2).sum(axis=1)
        reach, scanning, computed = 4 * least, np.arange(len(x)), len(x)  # all in squares: twice the distance is four times
        for step in range(self.others.shape[1]):
            start = before[scanning]
            scanning = scanning[self.apart[start, step] <= reach[scanning]]
            if not len(scanning):
                break
            other = self.others[before[scanning], step]
            d = ((x[scanning] - self.centroids[other]) ** 2).sum(axis=1)
            computed += len(scanning)
            better = (d < least[scanning]) | ((d == least[scanning]) & (other < best[scanning]))
            at = scanning[better]
            best[at], least[at] = other[better], d[better]
        return best, least, computed


def _matrix(column, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), dims)


def _pass(order: Order, dims: int):
    """A pass over ``(row, id, v, cluster)``: a row for each vector, then one for each centroid of the batch with its sums.

    A sum's ``row`` is one of its batch, so that it falls into the batch's bucket.
    """

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            row, x = np.asarray(b.column(0)), _matrix(b.column(2), dims)
            best, least, _ = order.assign(x, np.asarray(b.column(3)).astype(np.int64))
            found = np.unique(best)
            sums = np.array([x[best == c].sum(axis=0) for c in found])
            n = np.array([(best == c).sum() for c in found])
            each, more = len(row), len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([row, np.full(more, row[0])])), pa.concat_arrays([b.column(1), pa.nulls(more, pa.int64())]), pa.array(np.concatenate([best, found]).astype(np.int32)), pa.concat_arrays([pa.array(least), pa.nulls(more, pa.int64())]),
                    pa.concat_arrays([pa.nulls(each, pa.int64()), pa.array(n)]), pa.concat_arrays([pa.nulls(each, pa.list_(pa.int64())), pa.array(list(sums), pa.list_(pa.int64()))]),
                ],
                names=["row", "id", "cluster", "distance", "n", "sums"],
            )

    return run


class _Buckets:
    """Tables bucketed and sorted by row number, in a folder of their own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.key = spark, uuid.uuid4().hex
        self.place = f"{shared_dir(spark).rstrip('/')}/sort-means/{self.key}"
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: list[str] = []

    def write(self, rows: DataFrame, name: str, columns: str) -> DataFrame:
        name = f"sort_means_{self.key}_{name}"
        where = f"{self.place}/{name}".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (row) SORTED BY (row) INTO {self.n} BUCKETS LOCATION '{where}'")
        self.names.append(name)
        rows.write.insertInto(name)
        return self.spark.table(name)

    def drop(self, names: list[str] | None = None) -> None:
        for name in self.names if names is None else names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_folder(self.spark, f"{self.place}/{name}")
        if names is None:
            remove_folder(self.spark, self.place)


def sort_means(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: float = 1024, seed: int = 3) -> DataFrame:
    """Clusters of ``vectors`` after ``rounds`` rounds: ``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, a row for each kept vector."""
    spark = vectors.sparkSession
    schema = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    kept = whole_vectors(vectors, id_col, vector_col, dims, scale)
    buckets = _Buckets(spark)
    try:
        numbered = kept.select(F.monotonically_increasing_id().alias("row"), "id", "v").repartition(buckets.n, "row")
        table = buckets.write(numbered, "vectors", "row long, id long, v array<long>")
        largest = table.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0]
        if largest is None:
            return spark.createDataFrame([], schema)
        if largest > LARGEST:
            raise OverflowError(f"a component of {largest} has no squared distances within a long; the largest is {LARGEST}")
        centroids = first_centroids(table, k, seed)
        before = None
        for turn in range(rounds + 1):
            if before is None:
                known = table.withColumn("cluster", F.lit(0))
            else:
                known = table.join(before.filter("n is null").select("row", "cluster").hint("merge"), "row").select("row", "id", "v", "cluster")
            after = buckets.write(known.mapInArrow(_pass(Order(centroids), dims), STATE), f"round{turn}", STATE)
            if before is not None:
                buckets.drop(buckets.names[-2:-1])
            before = after
            # Grouped by row, so that each task reads a bucket: the sums are as few a task as clusters.
            parts = before.filter("n is not null").groupBy("row", "cluster", "n").agg(F.max("sums").alias("sums")).select("cluster", "n", F.posexplode("sums").alias("i", "s"))
            sums = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
            moved = centroids.copy()
            for r in sums:
                moved[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
            if turn == rounds or (moved == centroids).all():
                break  # the vectors were assigned to these very centroids
            centroids = moved
        each = before.filter("n is null")
        of = {r["cluster"]: int(r["s"]) for r in each.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
        digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
        totals = spark.createDataFrame([(c, of[c], sum(of.values()), digests[c]) for c in of], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        rows = each.select(F.col("id").alias(id_col), "cluster", "distance")
        return cut(rows.join(F.broadcast(totals), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
    finally:
        buckets.drop()
