"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing.

Each stage works on all that its predecessor kept. Apart from the last they return the
columns of ``documents``; :func:`run` writes each stage's result as Parquet into the shared
folder and reads it again for the next, which done it removes it; what the last one wrote stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm.digest_index import drop_exact_duplicates
from typeloom.llm.langid import identify, train
from typeloom.llm.mixing import mixed_documents
from typeloom.llm.packing import best_fit_packing
from typeloom.llm.shared import limit_batches, remove_folder, shared_dir
from typeloom.llm.simhash import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without letters or with a narrow margin go."""
    limit_batches(spark)  # the result is read after this returns, so the limit stays
    return identify(docs, train(docs)).filter("not rejected").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    limit_batches(spark)
    return drop_near_duplicates(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights, in the order of the schedule."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in packed sequences."""
    return best_fit_packing(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL can express neither compression, fingerprints and components, nor packing; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    place = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{place}/{name}"
        docs = spark.read.parquet(before)
    return docs
