"""Golden queries against an engine: timed searches, metrics, and a random search over settings."""

from __future__ import annotations

import math
import random
import time
from dataclasses import replace

from pyspark.sql import DataFrame

from .engine import Engine
from .functions import measures
from .operators.sets import split_half
from .plans.errors import QueryError
from .settings import QuerySettings
from .sources.files import append_csv

#: Ranges that settings are drawn from.
RANGES = {"penalty_weight": (0.0, 0.3), "doc_boost": (0.0, 0.5), "distance_weight": (0.0, 0.3)}


def timed(f):
    """What ``f()`` gives, and the milliseconds it took."""
    began = time.perf_counter()
    out = f()
    return out, (time.perf_counter() - began) * 1000


def run(engine: Engine, golden: DataFrame, modules: list[str] | None = None) -> DataFrame:
    """``(query, relevant, found, ap, recall, recall_5, recall_10, duration_ms)`` of ``golden(query, relevant_signature)``.

    The queries are a list of judgements made by hand, searched one after the other; a query that fails finds nothing.
    """
    spark, results, took = engine.spark, [], []
    for row in golden.select("query").distinct().orderBy("query").collect():
        try:
            found, ms = timed(lambda q=row["query"]: engine.search(q, modules, engine.query_settings.max_results).select("signature").collect())
        except QueryError:
            found, ms = [], 0.0
        results += [(row["query"], r["signature"], i) for i, r in enumerate(found, 1)]
        took.append((row["query"], ms))
    ranked = spark.createDataFrame(results, "query string, relevant_signature string, rank int")
    metrics = measures.query_metrics(measures.ranks(ranked, golden.select("query", "relevant_signature").distinct(), ["query", "relevant_signature"]), "query")
    return metrics.join(spark.createDataFrame(took, "query string, duration_ms double"), "query")


def benchmark(engine: Engine, golden: DataFrame, path: str, modules: list[str] | None = None) -> DataFrame:
    """Run, append each query's line to the CSV at ``path``, and give the means."""
    lines = run(engine, golden, modules).persist()
    append_csv(lines.select("query", "ap", "recall_5", "recall_10", "duration_ms").orderBy("query").coalesce(1), path)
    return measures.run_metrics(lines)


def normal(rng: random.Random, mean: float, deviation: float) -> float:
    """A normally distributed number from two uniform ones."""
    return mean + deviation * math.sqrt(-2 * math.log(1 - rng.random())) * math.cos(2 * math.pi * rng.random())


def draw(rng: random.Random, base: QuerySettings) -> QuerySettings:
    """Settings drawn from :data:`RANGES`, the base of the frequency weight around that of ``base``."""
    drawn = {k: rng.uniform(*r) for k, r in RANGES.items()}
    return replace(base, frequency_weight=max(1.1, normal(rng, base.frequency_weight, 0.5)), **drawn)


def random_search(engine: Engine, golden: DataFrame, n: int, seed: int = 42) -> tuple[QuerySettings, DataFrame]:
    """The best of ``n`` random settings by mean average precision on one half of the queries, and its metrics on the other."""
    train, test = split_half(golden.select("query").distinct(), ["query"], seed)
    rng, best, old = random.Random(seed), (-1.0, engine.query_settings), engine.query_settings
    try:
        for i in range(n):
            engine.query_settings = old if i == 0 else draw(rng, old)
            score = measures.run_metrics(run(engine, golden.join(train, "query", "left_semi"))).first()["map"] or 0.0
            best = max(best, (score, engine.query_settings), key=lambda x: x[0])
        engine.query_settings = best[1]
        return best[1], measures.run_metrics(run(engine, golden.join(test, "query", "left_semi")))
    finally:
        engine.query_settings = old
