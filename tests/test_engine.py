import pathlib

import pytest
from pyspark.sql import functions as F

from typeloom.engine import Engine, without
from typeloom.functions.types import Type
from typeloom.plans.errors import NameAmbiguous, NameNotFound, QueryError
from typeloom.settings import IndexSettings, QuerySettings
from typeloom.sources.definitions import definitions, read_lines, value_row

M1, M2, STD = "test:m1:0.1.0", "test:m2:0.1.0", "test:std:1"
LINES = [
    ("type scala.Int", STD), ("type scala.Float", STD), ("type scala.collection.immutable.List[+A]", STD),
    ("type p.C", M1), ("p.O.m: scala.Int", M1), ("p.O.c: p.C", M1), ("p.O.foo: <methodInvocation1>[scala.Int, scala.Int]", M1),
    ("type q.C", M2), ("type q.D <: q.C", M2), ("q.O.m: scala.Int", M2), ("q.O.c: q.C", M2), ("q.O.d: q.D", M2), ("q.O.f: scala.Float", M2), ("broken [: x", M2),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("index")), query=QuerySettings(explain=True))
    assert e.status() == {"state": "empty"}
    e.index("main", read_lines(spark.createDataFrame(LINES, "value string, m string"), module="m"))
    assert e.status("main")["state"] == "busy"
    f = value_row("p.O.f", Type("+", "scala.Float"), comment="<p>Creates a <b>float</b></p>", module_id=M1)
    e.index("main", definitions(spark, [f], builtins=False))
    assert e.finalize("main") == 1  # the line that cannot be read
    return e


def found(engine, query, modules=None, **more):
    return [r["name"] for r in engine.search(query, modules, **more).collect()]


def test_searches(engine):
    assert {"p.O.m", "q.O.m"} <= set(found(engine, "Int"))
    assert "q.O.m" not in found(engine, "Int", [M1, STD]) and "p.O.m" in found(engine, "Int", [M1, STD])
    assert found(engine, "Int => Int")[0] == "p.O.foo"
    assert found(engine, "C", [M1]) == ["p.O.c"]
    assert found(engine, "create") == ["p.O.f"]
    assert found(engine, "float: A")[0] == "p.O.f"
    assert found(engine, "C", [M2]) == ["q.O.c", "q.O.d"]  # a subtype comes after the type


def test_problems(engine):
    with pytest.raises(NameAmbiguous) as problem:
        found(engine, "C")
    assert "p.C" in problem.value.message() and "q.C" in problem.value.message()
    for q in ("List => Xyz", "List[Xyz]", "(List, Xyz)"):
        with pytest.raises(NameNotFound):
            found(engine, q)
    with pytest.raises(QueryError):
        found(engine, "(A")


def test_pages_and_groups(engine):
    every = found(engine, "Int", n=50)
    assert found(engine, "Int", n=1, offset=1) == every[1:2]
    groups = engine.search_grouped("Int").collect()
    assert groups[0]["members"] == 2 and groups[0]["more"] == 1
    assert "ln(" in engine.search("Int").first()["explanation"]


def test_catalogue(engine):
    assert set(engine.status()["modules"]) == {"builtin", M1, M2, STD}
    assert engine.default_modules() == []
    assert not engine.needs_rebuild("main")
    assert Engine(engine.spark, engine.folder.path, IndexSettings(polarized=False)).needs_rebuild("main")
    with pytest.raises(ValueError):
        engine.finalize("unknown")
    assert [r["name"] for r in engine.find_by_name("O foo").collect()] == ["p.O.foo"]
    every = {r["name"] for r in engine.table("values").collect()}
    assert {r["name"] for r in engine.find_by_name(" . ").collect()} == every and engine.find_by_name("O foo absent").count() == 0
    assert engine.find_by_name("foo O foo").count() == 1 and engine.find_by_name("O foo", [M2]).count() == 0
    plan = engine.find_by_name("O foo")._jdf.queryExecution().executedPlan().toString()
    assert "name_postings" in plan and "PushedFilters: [In(token" in plan
    types = {r["name"]: r for r in engine.table("type_defs").collect()}
    assert types["scala.Nothing"]["f_co"] == 1.0 and 0 < types["scala.Int"]["f_co"] < 1
    assert all(r["from_key"] for r in engine.table("views").collect())


def test_view_keys_match_types(engine):
    for r in engine.table("views").collect():
        assert r["from_key"] == Type.decode(r["source"]).key()


def test_values_like_a_value(engine):
    assert "p.O.m" in [r["name"] for r in engine.like(Type("+", "scala.Int")).collect()]


def test_feedback(engine):
    engine.assess_positively("Int", [M1], "p.O.m: scala.Int")
    engine.log("succeeded", "Int", None, 0)
    assert engine.interactions().groupBy("outcome").count().count() == 2


def test_deletions_and_rebuilding(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))
    e.index("a", read_lines(spark.createDataFrame(LINES, "value string, m string"), module="m"))
    e.finalize("a")
    e.delete_module(M2)
    assert set(found(e, "Int")) == {"p.O.m", "p.O.foo"} and M2 not in e.status()["modules"]
    more = definitions(spark, [value_row("r.x", Type("+", "scala.Int"), module_id=M1, artifact="a.scala")], builtins=False)
    e.index("a", more)
    assert set(found(e, "Int")) == {"p.O.m", "p.O.foo"}  # the old version is searched meanwhile
    e.finalize("a")
    assert "r.x" in found(e, "Int")
    e.delete_artifact("a.scala")
    assert "r.x" not in found(e, "Int")
    e.reset()
    assert e.status() == {"state": "empty"}


def _files(e):
    """Sizes of all data files of an index."""
    return {f: f.stat().st_size for f in pathlib.Path(e.folder.path).rglob("*.parquet")}


def _rows(e, kind):
    return sorted(str(sorted(r.asDict(True).items())) for r in e.table(kind).drop("batch").collect())


def test_segments(spark, tmp_path):
    def lines(*modules):
        return read_lines(spark.createDataFrame([x for x in LINES if x[1] in modules], "value string, m string"), module="m")

    e = Engine(spark, str(tmp_path / "grown"))
    e.index("a", lines(STD, M1))
    e.finalize("a")
    first = _files(e)
    planned = e.table("values")
    e.index("a", lines(M2, M1))  # values of the first are there already
    e.finalize("a")
    assert len(e._version("a")["segments"]) == 2 and first.items() <= _files(e).items()
    assert e.table("values").count() == 7 == e._version("a")["values"]
    whole = Engine(spark, str(tmp_path / "whole"))
    whole.index("a", lines(STD, M1, M2))
    whole.finalize("a")
    kinds = ("values", "postings", "name_postings", "doc_terms", "views", "type_defs", "suffixes", "frequencies", "modules")
    assert all(_rows(e, k) == _rows(whole, k) for k in kinds)
    before = _files(e)
    e.delete_module(M1)
    assert _files(e) == before  # no table is written
    assert planned.count() == 3 and e.table("values").count() == 4 == e._version("a")["values"]
    for kind in ("values", "postings", "name_postings", "doc_terms", "views", "type_defs", "suffixes", "modules"):
        assert e.table(kind).filter(f"module_id = '{M1}'").count() == 0
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = e.table("postings").filter("term = '+scala.Int'")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(term" in plan and f"Not(EqualTo(module_id,{M1}))" in plan  # both reach the scan
    e.index("a", lines(M1))
    e.finalize("a")  # what was deleted comes back only with a later batch
    assert all(_rows(e, k) == _rows(whole, k) for k in kinds)
    assert len(e._version("a")["segments"]) == 3
    e.compact("a")
    assert len(e._version("a")["segments"]) == 1 and all(_rows(e, k) == _rows(whole, k) for k in kinds)
    e.delete_module(M1)
    e.delete_module(M2)
    e.delete_module(STD)
    assert e.table("values").count() == 0 and found(e, "create") == []
    e.index("a", lines(M1))
    e.finalize("a")  # more was deleted than is left: one segment again
    assert len(e._version("a")["segments"]) == 1 and e.table("values").count() == 3


def test_conditions_of_deletions(spark):
    rows = spark.createDataFrame([("m", "x", 1.0), ("m", None, 3.0), ("n", "x", 3.0)], "module_id string, artifact string, batch double")
    shown = lambda gone: sorted((r["module_id"], r["artifact"]) for r in without(rows, gone).na.fill("-").collect())
    assert shown([["module_id", "m"]]) == [("n", "x")] and shown([["artifact", "x"]]) == [("m", "-")]
    assert shown([["artifact", "x", 2.0]]) == [("m", "-"), ("n", "x")] and shown([["other", "x"]]) == shown([])


def test_rows_of_types_are_replaced(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))
    e.index("a", read_lines(spark.createDataFrame(LINES, "value string, m string"), module="m"))
    e.finalize("a")
    segments, values = e._version("a")["segments"], _rows(e, "values")
    new = e.table("type_defs").filter("name = 'q.C'").select("name", "params", "comment", "attributes", "module_id")
    e.add("type_defs", new.withColumn("comment", F.lit("new")), ["module_id", "name"])
    assert [r["comment"] for r in e.type_named("q.C").collect()] == ["new"] and e._version("a")["segments"] == segments
    e.add("values", e.table("values").filter("name = 'q.O.m'").withColumn("comment", F.lit("said")), ["name"])
    assert e.table("values").filter("comment = 'said'").count() == 1 and len(_rows(e, "values")) == len(values)


def test_settings_are_checked():
    with pytest.raises(ValueError):
        QuerySettings(doc_boost=-1)
