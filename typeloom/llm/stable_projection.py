"""Approximate nearest neighbours by stable projections and kd-trees (operator 10).

Nearness is the inner product. Each vector gets one more component that brings all to the same
length, so that the largest inner products are the smallest Euclidean distances. ``dims`` Gaussian projections
multiply a squared distance d2 by a chi-square variable with ``dims`` degrees of freedom. Cells of a
kd-tree over the projections are visited in order of their distance from the query's
projection, and in them the projected neighbours in order of their own distance r2, each verified exactly, until r2 >= c * d2_k for the k-th best distance so far, where
c is the chi-square quantile of ``recall``: a true neighbour that has not been seen by
then has a chance of at most 1 - ``recall`` to exist beyond.

The outer tree is fitted on at most ``sample_rows`` rows (those with the smallest hash of the id) and
indexes every row. Cells are cut into chunks of about ``chunk_rows`` rows, in which an inner tree of leaves
is built. A query first searches a chunk of its own cell, which bounds its k-th distance, and
then every chunk that the stopping test cannot rule out. Identical vectors are indexed once, with
their ``k + 1`` smallest ids, as no more can be among anyone's k nearest.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part, as queries or candidates; ties go to the smaller id; all rows with the
query's id are left out for it; rows with a null id take no part; a query with fewer candidates gets
all of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut


def chi_square_quantile(p: float, dof: int) -> float:
    """Quantile of the chi-square distribution for an even number of degrees of freedom, by bisection."""

    def cdf(x):
        half, term, total = x / 2, 1.0, 1.0
        for k in range(1, dof // 2):
            term *= half / k
            total += term
        return 1 - math.exp(-half) * total

    lo, hi = 0.0, 100.0 * dof
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class KdTree:
    """Median splits of points down to ``cells`` cells; boxes are bounded by the splits alone."""

    def __init__(self, points: np.ndarray, cells: int):
        dims = points.shape[1]
        self.split: list[tuple[int, float, int, int]] = []  # dimension, value, left, right; a leaf is ~cell
        self.low, self.high = [], []
        self.members: list[np.ndarray] = []
        self.root = self._grow(points, np.arange(len(points)), cells, np.full(dims, -np.inf), np.full(dims, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, points, rows, cells, low, high) -> int:
        spread = points[rows].max(axis=0) - points[rows].min(axis=0) if len(rows) else np.zeros(points.shape[1])
        if cells <= 1 or len(rows) < 2 or spread.max() == 0:
            self.low.append(low)
            self.high.append(high)
            self.members.append(rows)
            return ~(len(self.members) - 1)
        d = int(spread.argmax())
        value = float(np.median(points[rows, d]))
        goes = points[rows, d] < value
        if not goes.any():
            value = float(points[rows, d].max())
            goes = points[rows, d] < value
        at = len(self.split)
        self.split.append(None)
        below, above = high.copy(), low.copy()
        below[d] = above[d] = value
        left = self._grow(points, rows[goes], cells // 2, low, below)
        right = self._grow(points, rows[~goes], cells - cells // 2, above, high)
        self.split[at] = (d, value, left, right)
        return at

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int32)

        def walk(node, rows):
            if node < 0:
                out[rows] = ~node
            else:
                d, value, left, right = self.split[node]
                goes = points[rows, d] < value
                walk(left, rows[goes])
                walk(right, rows[~goes])

        walk(self.root, np.arange(len(points)))
        return out

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point from each cell's box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(axis=1)


class Space:
    """The projections: ``dims`` Gaussian directions over the vectors with their extra component."""

    def __init__(self, length: int, longest: float, dims: int, seed: int):
        self.longest = longest
        self.directions = np.random.default_rng(seed).standard_normal((length + 1, dims))

    def indexed(self, v: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.longest**2 - (v * v).sum(axis=1), 0))
        return v @ self.directions[:-1] + extra[:, None] * self.directions[-1]

    def queried(self, q: np.ndarray) -> np.ndarray:
        """Queries are scaled to the common length, which keeps their order of inner products."""
        return self._scaled(q) @ self.directions[:-1]

    def _scaled(self, q: np.ndarray) -> np.ndarray:
        return q * (self.longest / np.sqrt((q * q).sum(axis=1)))[:, None]

    def squared_distance(self, score: np.ndarray, q_length: np.ndarray) -> np.ndarray:
        """Distance in the common space from an inner product with the unscaled query."""
        return np.maximum(2 * self.longest**2 - 2 * score * (self.longest / q_length), 0)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(vectors, first_ids, queries, bounds, space: Space, k: int, c: float, leaf_rows: int):
    """Best ``k`` vectors for each query, as lists of (row, score, verified); ``bounds`` are k-th distances known so far, and verified vectors are counted."""
    points = space.indexed(vectors)
    tree = KdTree(points, max(1, len(points) // leaf_rows))
    low = np.array([points[m].min(axis=0) for m in tree.members])
    high = np.array([points[m].max(axis=0) for m in tree.members])
    sizes = np.array([len(m) for m in tree.members])
    order = np.concatenate(tree.members)
    placed = points[order]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    vectors, ids = vectors[order], first_ids[order]
    projected, lengths = space.queried(queries), np.sqrt((queries * queries).sum(axis=1))
    out = []
    for q, p, length, bound in zip(queries, projected, lengths, bounds, strict=True):
        verified = 0
        gap = np.maximum(np.maximum(low - p, p - high), 0)
        r2 = (gap * gap).sum(axis=1)
        leaves = np.argsort(r2, kind="stable")
        best = np.zeros(0, dtype=np.int64)
        scores = np.zeros(0)
        at, step = 0, 4
        while at < len(leaves) and r2[leaves[at]] < c * bound:
            rows = np.concatenate([np.arange(begins[x], begins[x + 1]) for x in leaves[at : at + step]])
            apart = placed[rows] - p
            apart = np.einsum("ij,ij->i", apart, apart)
            near = np.flatnonzero(apart < c * bound)
            near = near[np.argsort(apart[near], kind="stable")]
            rows, apart = rows[near], apart[near]
            i, take = 0, 4 * k
            while i < len(rows) and apart[i] < c * bound:
                part = rows[i : i + take]
                verified += len(part)
                some, got = np.concatenate([best, part]), np.concatenate([scores, vectors[part] @ q])
                if len(some) > k:
                    least = np.partition(got, len(got) - k)[len(got) - k]
                    keep = got >= least
                    some, got = some[keep], got[keep]
                top = np.lexsort((ids[some], -got))[:k]
                best, scores = some[top], got[top]
                if len(best) == k:
                    bound = min(bound, float(space.squared_distance(scores[-1:], length)[0]))
                i += take
                take *= 2
            at += step
            step *= 2
        exact = (vectors[best] * q).sum(axis=1)
        out.append((order[best], exact, verified))
    return out


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))


def nearest(
    vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, dims: int = 24, recall: float = 0.9,
    sample_rows: int = 20_000, cell_rows: int = 4096, chunk_rows: int = 50_000, query_block: int = 50_000, leaf_rows: int = 128, seed: int = 42,
) -> DataFrame:
    """The ``k`` nearest of every row for which ``is_query`` (a column over vec_id) holds: ``(query_id, rank, vec_id, score)``."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    clean = _clean(vectors, id_col, vector_col)
    lengths = sorted(clean.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)"))).alias("longest")).collect(), key=lambda r: (-r["n"], -r["d"]))
    if not lengths:
        return spark.createDataFrame([], schema)
    d, longest = lengths[0]["d"], lengths[0]["longest"]
    clean = clean.filter(F.size("v") == d)

    # Distinct vectors with their smallest ids; row_number <= k + 1 is applied before the shuffle too.
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = clean.distinct().withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    distinct = cut(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = distinct.count()

    space = Space(d, longest, dims, seed)
    c = chi_square_quantile(recall, dims)
    sample = distinct.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(sample_rows).select("v").toArrow()
    tree = KdTree(space.indexed(_matrix(sample["v"])), min(1024, max(1, -(-n // cell_rows))))
    tree.members = None

    def placed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.cell_of(space.indexed(_matrix(b.column(0))))), b.column(0), b.column(1)], names=["cell", "v", "ids"])

    cells = cut(distinct.select("v", "ids").mapInArrow(placed, "cell int, v array<double>, ids array<long>"))
    held = {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = np.array([max(1, -(-held.get(i, 0) // chunk_rows)) for i in range(len(tree.low))])
    of_cell = F.create_map(*[x for i, m in enumerate(chunks.tolist()) for x in (F.lit(i), F.lit(m))])
    index = cells.withColumn("chunk", F.pmod(F.xxhash64(F.col("ids")[0]), of_cell[F.col("cell")]).cast("int"))

    queries = clean.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()
    blocks = max(1, -(-queries.count() // query_block))
    queries = cut(queries.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(blocks)).cast("int")))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def routed(batches):  # to one chunk of the query's own cell
        for b in batches:
            own = tree.cell_of(space.queried(_matrix(b.column(1))))
            chunk = np.asarray(b.column(0)) % chunks[own]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(own), pa.array(chunk.astype(np.int32)), pa.array(np.full(len(own), np.inf))], names=["query_id", "q", "block", "cell", "chunk", "bound"])

    def found(left, right):
        rows = {"query_id": [], "qhash": [], "ids": [], "score": []}
        if len(left) and len(right):
            queries_ = _matrix(right["q"])
            ids = left["ids"].to_pylist()
            first = np.array([x[0] for x in ids], dtype=np.int64)
            hits = search(_matrix(left["v"]), first, queries_, np.asarray(right["bound"]), space, k + 1, c, leaf_rows)
            for query, (at, score, _) in zip(right["query_id"].to_pylist(), hits, strict=True):
                rows["query_id"] += [query] * len(at)
                rows["ids"] += [ids[i] for i in at]
                rows["score"] += score.tolist()
            # tells apart queries that share an id
            rows["qhash"] = [h for h, (at, *_) in zip(right["qhash"].to_pylist(), hits, strict=True) for _ in at]
        return pa.table({"query_id": pa.array(rows["query_id"], pa.int64()), "qhash": pa.array(rows["qhash"], pa.int64()), "ids": pa.array(rows["ids"], pa.list_(pa.int64())), "score": pa.array(rows["score"], pa.float64())})

    keys = ["cell", "chunk", "block"]
    route = "query_id long, q array<double>, block int, cell int, chunk int, bound double"
    hit = "query_id long, qhash long, ids array<long>, score double"

    def searched(routed_):
        return index.groupBy(*keys).cogroup(routed_.withColumn("qhash", F.xxhash64("q")).groupBy(*keys)).applyInArrow(found, hit)

    home = cut(searched(queries.mapInArrow(routed, route)))
    # The k-th distance so far of each query; infinite if its chunk had fewer vectors.
    kth = home.groupBy("query_id", "qhash").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    known = queries.withColumn("qhash", F.xxhash64("q")).join(kth, ["query_id", "qhash"], "left").select("query_id", "q", "block", F.when(F.col("n") > k, F.col("least")).alias("least"))

    def onward(batches):
        for b in batches:
            q = _matrix(b.column(1))
            p, length = space.queried(q), np.sqrt((q * q).sum(axis=1))
            least = np.asarray(b.column(3).to_numpy(zero_copy_only=False), dtype=np.float64)
            bound = np.where(np.isnan(least), np.inf, space.squared_distance(least, length))
            own = tree.cell_of(p)
            ids = np.asarray(b.column(0))
            rows, cell, chunk = [], [], []
            for i in range(len(q)):
                for x in np.flatnonzero(tree.distances(p[i]) < c * bound[i]):
                    for y in range(chunks[x]):
                        if x != own[i] or y != ids[i] % chunks[x]:
                            rows.append(i)
                            cell.append(x)
                            chunk.append(y)
            rows = np.array(rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows), pa.array(cell, pa.int32()), pa.array(chunk, pa.int32()), pa.array(bound[rows])], names=["query_id", "q", "block", "cell", "chunk", "bound"])

    hits = home.union(searched(known.mapInArrow(onward, route)))
    each = hits.select("query_id", "qhash", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "qhash").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
