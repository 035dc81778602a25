"""View graphs in tables: one hop, views from any type, bounded closure, and retained information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_hop(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """``(start, target, kept)``: ``starts(start, node, kept)`` through ``edges(source, target, retained)``."""
    return starts.join(edges, starts.node == edges.source).select("start", "target", (F.col("kept") * F.col("retained")).alias("kept"))


def from_any(starts: DataFrame, generic: DataFrame) -> DataFrame:
    """Views that start from a bare parameter fit every start of their variance, at full information."""
    return starts.join(generic, starts.variance == generic.variance).select("start", generic.target, F.lit(1.0).alias("kept"))


def closure(starts: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """What ``starts(start, node, kept)`` reach in one to ``steps + 1`` hops, with the most that any way retains.

    Each round keeps one row a start and node, so that a graph's many ways do not multiply.
    """
    front, found = starts, None
    for _ in range(steps + 1):
        hop = one_hop(front, edges).groupBy("start", "target").agg(F.max("kept").alias("kept"))
        found = hop if found is None else found.union(hop)
        front = hop.withColumnRenamed("target", "node")
    return found.groupBy("start", "target").agg(F.max("kept").alias("kept"))


def retained(source: Column, target: Column) -> Column:
    """Share of a source's nodes that its target keeps, from preorder arrays; 1 if the source is a parameter."""
    given = F.transform(F.filter(target, lambda n: n["is_param"]), lambda n: n["name"])
    lost = F.filter(source, lambda n: n["is_param"] & ~F.array_contains(given, n["name"]))
    return F.when(source[0]["is_param"], F.lit(1.0)).otherwise((F.size(source) - F.size(lost)) / F.size(source))
