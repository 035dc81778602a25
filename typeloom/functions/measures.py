"""Weights, means and retrieval metrics as column and DataFrame expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def itf(frequency: Column, base: float = 2.7, floor: float = 0.001) -> Column:
    """Inverse type frequency with a floor."""
    if base == 0:
        return F.lit(1.0)
    return F.greatest(F.log(F.lit(base) / (frequency * base + (1 - frequency))) / math.log(base), F.lit(floor))


def neutral_itf(frequency: Column, base: float = 2.0) -> Column:
    """The language-neutral engine's variant: rare terms get more, and nothing is floored."""
    return F.log(F.lit(base) / (frequency * base + 1.1 * (1 - frequency))) / math.log(base)


def boost(fraction: Column, distance: Column, frequency: Column, base: float = 2.7, distance_weight: float = 0.2) -> Column:
    return F.coalesce(fraction, F.lit(1.0)) * (1 - distance_weight * distance) * itf(frequency, base)


def neutral_boost(fraction: Column, distance: Column, frequency: Column, base: float = 2.0, distance_weight: float = 0.05) -> Column:
    return fraction * neutral_itf(frequency, base) * F.pow(1 - 0.1 * distance, F.lit(distance_weight))


def final_score(fingerprint: Column, penalty: Column, doc: Column, penalty_weight: float = 0.1, doc_boost: float = 0.1) -> Column:
    return fingerprint / (1 + penalty_weight * penalty) + doc_boost * F.log(doc + 1)


def arithmetic_mean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(w)


def geometric_mean(x: Column, w: Column) -> Column:
    return F.exp(F.sum(w * F.log(x)) / F.sum(w))


def harmonic_mean(x: Column, w: Column) -> Column:
    return F.sum(w) / F.sum(w / x)


def ranks(results: DataFrame, relevant: DataFrame, on: list[str]) -> DataFrame:
    """First rank (or null) of every relevant item. ``results`` has the columns ``on`` and rank."""
    best = results.groupBy(*on).agg(F.min("rank").alias("rank"))
    return relevant.join(best, on, "left")


def query_metrics(ranked: DataFrame, query: str = "query_id", at: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Average precision, recall and recall at n of each query, from one row per relevant item with its rank or null.

    The k-th hit adds k / rank; the sum is divided by the number of relevant items, hits or not.
    """
    hit = F.row_number().over(Window.partitionBy(query).orderBy(F.col("rank").asc_nulls_last()))
    each = ranked.withColumn("gain", F.when(F.col("rank").isNotNull(), hit / F.col("rank")).otherwise(0.0))
    n = F.count(F.lit(1))
    columns = [n.alias("relevant"), F.count("rank").alias("found"), (F.sum("gain") / n).alias("ap"), (F.count("rank") / n).alias("recall")]
    columns += [(F.coalesce(F.sum((F.col("rank") <= k).cast("int")), F.lit(0)) / F.least(n, F.lit(k))).alias(f"recall_{k}") for k in at]
    return each.groupBy(query).agg(*columns)


def precision(found: Column, retrieved: Column) -> Column:
    """0 if nothing was retrieved."""
    return F.when(retrieved > 0, found / retrieved).otherwise(F.lit(0.0))


def run_metrics(queries: DataFrame, at: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Means over queries; the geometric mean of average precision is the n-th root of the product."""
    gmap = F.when(F.min("ap") > 0, F.exp(F.avg(F.log("ap")))).otherwise(F.lit(0.0))
    extra = [F.avg("duration_ms").alias("mean_duration_ms")] if "duration_ms" in queries.columns else []
    return queries.agg(F.avg("ap").alias("map"), gmap.alias("gmap"), *[F.avg(f"recall_{k}").alias(f"mean_recall_{k}") for k in at], *extra)


def best_run(runs: DataFrame, by: str, run: str = "run_id") -> Column:
    """The run with the largest value, the smallest id among equals; for use in ``agg``."""
    return F.max_by(run, F.struct(F.col(by), -F.col(run)))


def below_cutoff(leaves: DataFrame, cutoff: float, query: str = "query_id") -> DataFrame:
    """Terms of each query kept under the frequency cutoff, as :func:`plans.expansion.candidate_terms` keeps them.

    One row a query: the number of leaves is bounded by the query's clause limit.
    """
    distinct = leaves.groupBy(query, "term", "frequency").agg(F.max("boost").alias("boost"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("boost")).alias("o"), "term", "frequency")))
    fold = f"aggregate(leaves, named_struct('sum', 0D, 'kept', cast(array() as array<string>)), (a, x) -> if(a.sum + x.frequency < {cutoff}D, named_struct('sum', a.sum + x.frequency, 'kept', array_append(a.kept, x.term)), a), a -> a.kept)"
    return distinct.groupBy(query).agg(ordered.alias("leaves")).select(query, F.expr(fold).alias("terms"))
