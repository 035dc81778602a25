"""Candidates, scores and ranking of a planned query, as one job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.expansion import Tree, candidate_terms
from ..plans.scoring import Scorer, final_score
from ..settings import QuerySettings
from .sets import only_modules


#: The last place of a page that holds all results.
EVERY = 2**31 - 1


def candidates(postings: DataFrame, terms: list[str], modules: list[str] | None = None) -> DataFrame:
    """Ids of the values with any of the terms; the term filter reaches the scan of the sorted postings."""
    return only_modules(postings, modules).filter(F.col("term").isin(terms)).select("value_id").distinct()


def scored(values: DataFrame, tree: Tree, settings: QuerySettings) -> DataFrame:
    """``(value_id, score, explanation)`` of ``values(value_id, terms, doc_score)``; only these columns go to Python."""

    def run(frames):
        scorer = Scorer(tree)
        for frame in frames:
            found = [scorer.score([(t["term"], t["optional"]) for t in terms]) for terms in frame["terms"]]
            doc = frame["doc_score"].fillna(0.0).to_numpy()
            score = final_score([x[0] for x in found], [x[1] for x in found], doc, settings.penalty_weight, settings.doc_boost)
            why = [f"{s:.4f} = {f:.4f} / (1 + {settings.penalty_weight:g} * {p:.2f}) + {settings.doc_boost:g} * ln({d:.4f} + 1); " + " ".join(f"{t}^{g:.4f}" for t, g in gains) for s, (f, p, gains), d in zip(score, found, doc, strict=True)]
            yield pd.DataFrame({"value_id": frame["value_id"], "score": score, "explanation": why if settings.explain else None})

    return values.select("value_id", "terms", "doc_score").mapInPandas(run, "value_id long, score float, explanation string")


def ranked(values: DataFrame, postings: DataFrame, tree: Tree | None, keyword_hits: DataFrame | None, modules: list[str] | None, settings: QuerySettings, n: int, offset: int = 0) -> DataFrame:
    """The page of results from ``offset`` on, best first, ties by id; wide columns are joined to the few that remain."""
    if tree is None:
        top = only_modules(keyword_hits.withColumnRenamed("id", "value_id").join(values.select("value_id", "module_id"), "value_id"), modules)
        top = top.select("value_id", F.col("doc_score").cast("float").alias("score"), F.lit(None).cast("string").alias("explanation"))
    else:
        found = candidates(postings, candidate_terms(tree, settings.cutoff), modules)
        narrow = only_modules(values, modules).select("value_id", "terms")
        if keyword_hits is not None:
            hits = keyword_hits.withColumnRenamed("id", "value_id")
            found = found.union(hits.select("value_id")).distinct()
            narrow = narrow.join(found, "value_id", "left_semi").join(hits, "value_id", "left")
        else:
            narrow = narrow.join(found, "value_id", "left_semi").withColumn("doc_score", F.lit(0.0))
        top = scored(narrow, tree, settings)
    last = min(offset + n, settings.max_results)
    if last >= EVERY and not offset:  # a limit would take all results through one task, and a broadcast to all of them
        return values.join(top, "value_id").orderBy(F.desc("score"), "value_id")
    page = top.orderBy(F.desc("score"), "value_id").limit(last).offset(offset)
    return values.join(F.broadcast(page), "value_id").orderBy(F.desc("score"), "value_id")
