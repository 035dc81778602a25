"""Queries over more rows than a page holds, and work that is done once for rows that ask the same."""

import os
import uuid

import duckdb
import pytest

import __spark_entry__  # noqa: F401
from tests.conftest import TABLES
from typeloom import registry, registry_types
from typeloom.plans.resolve import standard_names


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """The small tables with 300 times the suppliers: more in a region than a page of results holds."""
    where = tmp_path_factory.mktemp("many")
    for f in os.listdir(TABLES):
        os.symlink(f"{TABLES}/{f}", where / f)
    (where / "supplier.parquet").unlink()
    duckdb.sql(
        f"COPY (SELECT * EXCLUDE (i) REPLACE (s_suppkey + 1000 * i AS s_suppkey, 'Supplier#' || lpad((s_suppkey + 1000 * i)::VARCHAR, 9, '0') AS s_name) FROM '{TABLES}/supplier.parquet', (SELECT range AS i FROM range(300)) r) TO '{where}/supplier.parquet'"
    )
    return str(where)


@pytest.fixture(scope="module")
def con(many):
    c = duckdb.connect()
    for f in os.listdir(many):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{many}/{f}'")
    return c


@pytest.mark.parametrize("name", ["engine_search", "engine_search_grouped", "engine_similar_values", "service_calls"])
def test_all_results(spark, con, many, name):
    got = registry.QUERIES[name](spark, many)
    wanted = con.sql(registry.SQL[name])
    at = [wanted.columns.index(c) for c in got.columns]
    rows = sorted(tuple(r[i] for i in at) for r in wanted.fetchall())
    assert sorted(map(tuple, got.collect())) == rows
    assert len(rows) > 100 or name == "service_calls"


def test_equal_rows_are_worked_out_once_a_task(spark):
    rows = spark.range(2000).selectExpr("id", "id % 3 AS asked").coalesce(1)
    got = registry_types.through(rows, lambda asked: (f"{asked} {uuid.uuid4().hex}",), "id long, outcome string", keys=1).collect()
    assert sorted(r["id"] for r in got) == list(range(2000)) and all(r["outcome"].split()[0] == str(r["id"] % 3) for r in got)
    tasks = registry_types.dealt(rows).rdd.getNumPartitions()
    assert tasks >= 2 * spark.sparkContext.defaultParallelism
    assert len({r["outcome"] for r in got}) <= 3 * tasks


def test_forgotten_results_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(registry_types, "FOUND", 1)
    got = registry_types.through(spark.range(50).selectExpr("id", "id % 7 AS asked"), lambda asked: (asked * 2,), "id long, twice long", keys=1).collect()
    assert sorted(map(tuple, got)) == [(i, i % 7 * 2) for i in range(50)]


def test_standard_names_are_made_once():
    assert standard_names() is standard_names()


def test_items_of_a_task_are_bounded(spark, monkeypatch):
    from typeloom import registry as r

    monkeypatch.setattr(r, "ITEMS", 500)
    n = r.table(spark, TABLES, "lineitem").count()
    parts = r.corpus_terms(spark, TABLES).rdd.glom().map(len).collect()
    assert sum(parts) == n and len(parts) >= n // 500 and max(parts) < 1500


def test_types_that_stay_as_they_are_are_not_made_anew():
    from typeloom.functions.types import normalize, read_type

    t = read_type("+Map[-A, +List[+B]]")
    assert normalize(t).args[0] is t and t.transform(lambda x: x) is t


def test_texts_of_a_task_that_counts_tokens_are_bounded(spark, monkeypatch):
    from typeloom.functions import text

    monkeypatch.setattr(text, "CHARS", 2000)
    docs = spark.range(1000).selectExpr("id % 900 AS id", "concat('aB aB word', id) AS name").coalesce(1)
    chars = docs.selectExpr("sum(length(name))").first()[0]
    counts = text.term_counts(docs, "id", docs["name"]).select("id", "token", "tf")
    parts = counts.rdd.glom().map(len).collect()
    assert len(parts) >= chars // 2000 and max(parts) < 5500 // len(parts) * 3
    wanted = docs.selectExpr("id", "explode(flatten(transform(split(name, ' '), w -> if(w = 'aB', array('ab', 'a', 'b'), array(w, 'word', regexp_extract(w, '[0-9]+', 0)))))) AS token").groupBy("id", "token").count()
    assert counts.exceptAll(wanted).isEmpty() and wanted.exceptAll(counts).isEmpty()


def test_texts_of_a_project_are_dealt_out_and_outlined_once(spark, monkeypatch):
    from typeloom.sources import symbols

    tasks, keep, views = [], symbols.kept, symbols.base_views

    def counted(rows, f=lambda rows: rows):
        tasks.append((rows.rdd.getNumPartitions(), rows.columns))
        return f(rows)

    monkeypatch.setattr(symbols, "kept", lambda rows: counted(rows, keep))
    monkeypatch.setattr(symbols, "base_views", lambda made, bases: counted(views(made, bases)))
    texts = spark.range(40).selectExpr("concat('t', id) AS artifact", "'' AS inner_path", "concat('package p\\nclass A', id, if(id % 4 > 0, concat(' extends A', id - 1), ''), ' {\\n  def a', id, ': A0\\n}\\n') AS text").coalesce(1)
    found = symbols.read_project(texts)
    least = 2 * spark.sparkContext.defaultParallelism
    outlines, made = tasks[:2]
    assert "candidates" in outlines[1] and outlines[0] >= least and made[0] >= least and tasks[-1][0] >= least
    kinds = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    assert kinds["type"] == 40 and found.filter("kind = 'value' and name like 'p.A39.a%'").count() == 4


def test_definitions_of_a_batch_are_made_once_by_all_cores(spark, tmp_path):
    from pyspark.sql import functions as F

    from typeloom.engine import Engine
    from typeloom.sources.definitions import read_lines

    lines = spark.range(50).selectExpr("concat('p.a', id, ': scala.Int') AS value").coalesce(1)
    found = read_lines(lines, builtins=False)
    least = 2 * spark.sparkContext.defaultParallelism
    assert found.rdd.getNumPartitions() >= least
    e = Engine(spark, f"file://{tmp_path}/made")
    e.index("a", found.withColumn("module_id", F.udf(lambda: uuid.uuid4().hex).asNondeterministic()()))
    built = e._batches("a")
    assert built["values"].count() == 50 and built["values"].select("module_id").exceptAll(built["modules"].select("module_id")).isEmpty()
    assert sorted(n for n in os.listdir(tmp_path / "made" / "a") if not n.startswith(".")) == ["building"]
    e.finalize("a")
    assert e.table("values").count() == 50 and e.table("values").select(F.input_file_name()).distinct().count() >= least // 2
