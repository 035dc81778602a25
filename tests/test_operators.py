import math

import pytest
from pyspark.sql import functions as F

from typeloom.functions import measures, text
from typeloom.functions.types import TREE, Type, View, read_type
from typeloom.neutral import Definition, DocumentStore, NeutralEngine, definition_views, term_frequencies, type_frequencies, view_keys
from typeloom.operators import sets, views
from typeloom.settings import NeutralSettings
from typeloom.streaming import events as ev


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("wanted, ap", [(range(1, 11), 1), ([100], 0), ([1], 1), ([2], 0.5), ([1, 100], 0.5), ([9, 10], (1 / 9 + 2 / 10) / 2)])
def test_average_precision(spark, wanted, ap):
    results = spark.createDataFrame([(0, i, i) for i in range(1, 11)], "query_id int, item int, rank int")
    relevant = spark.createDataFrame([(0, i) for i in wanted], "query_id int, item int")
    got = measures.query_metrics(measures.ranks(results, relevant, ["query_id", "item"])).first()
    assert got["ap"] == pytest.approx(ap)


@pytest.mark.parametrize("wanted, recall", [(range(1, 101), 1), ([1000], 0), ([1], 1), ([2], 1), ([1, 1000], 0.5), ([9, 10], 1)])
def test_recall(spark, wanted, recall):
    results = spark.createDataFrame([(0, i, i) for i in range(1, 101)], "query_id int, item int, rank int")
    relevant = spark.createDataFrame([(0, i) for i in wanted], "query_id int, item int")
    assert measures.query_metrics(measures.ranks(results, relevant, ["query_id", "item"])).first()["recall_10"] == pytest.approx(recall)


def test_run_metrics(spark):
    runs = spark.createDataFrame([(1, 0.5, 1.0, 1.0, 10), (2, 0.125, 0.0, 0.5, 30)], "id int, ap double, recall_5 double, recall_10 double, duration_ms long")
    got = measures.run_metrics(runs).first()
    assert (got["map"], got["gmap"], got["mean_duration_ms"]) == (0.3125, pytest.approx(0.25), 20)


def test_names(spark):
    assert one(spark, text.suffixes(F.lit("p.A#b"))) == ["p.A#b", "A#b", "b"]
    assert one(spark, text.short_name(F.lit("p.A#b"))) == "b"
    assert one(spark, text.tokens(F.lit("somePkg.AnotherObj.myValue"))) == ["somepkg", "some", "pkg", "anotherobj", "another", "obj", "myvalue", "my", "value"]
    assert {"::", "++"} <= set(one(spark, text.tokens(F.lit("p.::.++"))))
    assert one(spark, text.strip_html(F.lit("<p>a\n<b class='x'>b</b></p>"))) == "a\nb"
    assert [one(spark, text.stem(F.lit(w))) for w in ("creates", "created", "creating", "create", "queries", "class", "is", "glasses", "mapped", "map", "string", "added", "red")] == ["creat", "creat", "creat", "creat", "query", "class", "is", "glass", "map", "map", "string", "ad", "red"]


def test_retained(spark):
    v = View(read_type("+Box[+T]", {"T"}), read_type("+CBox"))
    row = spark.createDataFrame([(v.source.encode(), v.target.encode())], "s array<struct<variance:string,name:string,arity:int,is_param:boolean>>, t array<struct<variance:string,name:string,arity:int,is_param:boolean>>")
    assert row.select(views.retained(F.col("s"), F.col("t")).alias("x")).first()["x"] == v.retained == 0.5


def test_sampling(spark):
    rows = spark.range(100)
    assert sets.sample_exactly(rows, 200, ["id"]).count() == 100 and sets.sample_exactly(rows, 0, ["id"]).count() == 0
    a, b = (sets.sample_exactly(rows, 10, ["id"], seed).collect() for seed in (1, 1))
    assert a == b and len(a) == 10
    left, right = sets.split_half(rows, ["id"])
    assert left.count() == right.count() == 50 and left.union(right).distinct().count() == 100


def test_batches(spark):
    got = sets.batches(spark.range(25), 10, ["id"]).groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("lo")).orderBy("batch").collect()
    assert [(r["batch"], r["n"], r["lo"]) for r in got] == [(0, 10, 0), (1, 10, 10), (2, 5, 20)]


def test_preferences(spark):
    rows = spark.createDataFrame([("a", "scala.X"), ("a", "p.X"), ("b", "p.Y")], "k string, name string")
    assert {tuple(r) for r in sets.prefer(rows, ["k"], F.col("name").rlike("^scala")).select("k", "name").collect()} == {("a", "scala.X"), ("b", "p.Y")}


def test_frequencies_by_list_and_by_table(spark):
    from typeloom.operators import index as ix
    from typeloom.sources.definitions import read_lines

    lines = ["type p.A", "type p.B <: p.A", "type p.C <: p.B", "type p.Box[+T]", "type p.MyBox[+T] <: p.Box[T]", "p.x: p.A", "p.y: <methodInvocation1>[p.C, p.B]", "p.z[Q]: <methodInvocation1>[p.Box[Q], p.MyBox[p.A]]"]
    kinds = ix.split_kinds(read_lines(spark.createDataFrame([(x,) for x in lines], "value string")))
    values = kinds["values"].withColumn("value_id", F.xxhash64("name"))
    table = ix.with_view_keys(kinds["views"])
    listed = [View(Type.decode(r["source"]), Type.decode(r["target"])) for r in table.collect()]
    a, b = (sorted(map(tuple, ix.type_frequencies(values, v, 3).collect())) for v in (listed, table))
    assert a == b
    found = {v + n: round(f, 4) for v, n, f in a}
    assert found["+scala.Nothing"] == 1.0 and found["+p.A"] == 0.6667 and found["+p.C"] == 1.0 and found["-p.A"] == 0.3333


@pytest.mark.parametrize("generic", [10_000, 0])
def test_frequencies_agree_on_cyclic_views(spark, monkeypatch, generic):
    """A key that was passed is not passed again, whichever way the views are held."""
    from typeloom.operators import index as ix
    from typeloom.sources.definitions import read_lines

    monkeypatch.setattr(ix, "FEW_GENERIC", generic)
    p = Type("", "P", (), True)
    views = [View(Type("+", "A", (p,)), Type("+", "B", (p,))), View(Type("+", "B", (p,)), Type("+", "A", (Type("", "Opt", (p,)),))), View(Type("+", "B", (Type("", "Opt", (p,)),)), Type("+", "C", (p,))), View(Type("+", "_", (), True), Type("+", "Z"))]
    values = ix.split_kinds(read_lines(spark.createDataFrame([("p.a: A[Int]",), ("p.b: B[A[Int]]",)], "value string"), builtins=False))["values"].withColumn("value_id", F.xxhash64("name"))
    values = values.withColumn("tpe", F.transform("tpe", lambda n: F.struct(F.when(n["name"] == "Int", "").otherwise(n["variance"]).alias("variance"), n["name"].alias("name"), n["arity"].alias("arity"), n["is_param"].alias("is_param"))))
    schema = f"source {TREE.simpleString()}, target {TREE.simpleString()}"
    table = ix.with_view_keys(spark.createDataFrame([(v.source.encode(), v.target.encode()) for v in views], schema))
    a, b = (sorted(map(tuple, ix.type_frequencies(values, v, 3).collect())) for v in (views, table))
    assert a == b and ("+", "Z", 1.0) in a and ("+", "B", 1.0) in a


TYPES = [Definition("Long", read_type("+Long"), is_type=True), Definition("Int", read_type("+Int"), is_type=True, supertypes=(read_type("+Long"),))]


def test_neutral_searches(spark):
    e = NeutralEngine(spark)
    e.index([*TYPES, Definition("foo", read_type("+<methodInvocation0>[+Int]")), Definition("bar", read_type("+<methodInvocation0>[+Long]"))])
    e.finalize()
    assert [r["name"] for r in e.search(read_type("+Int")).collect()] == ["foo"]
    assert [r["name"] for r in e.search(read_type("+Long")).collect()] == ["bar", "foo"]
    assert {"+Int": 2, "/Int": 1, "+Long": 1, "/Long": 1, "+<bottom0>": 2}.items() <= dict(e.counts.collect()).items()
    assert e.store.by_keys(["+Int"]).count() == 1 and e.store.count(["+Int", "+Long"]) == 0
    assert 0 < e.frequency("-Nope") < 1e-300


@pytest.mark.parametrize(
    "args, counts",
    [(("-Int", "-Long"), {"-Int": 1, "/Int": 1, "-Long": 2, "/Long": 1, "-<top0>": 2}), (("-Array[/Int]", "-Array[/Long]"), {"/Int": 1, "/Long": 1, "/<unknown0>": 2})],
)
def test_neutral_frequencies(spark, args, counts):
    e = NeutralEngine(spark)
    e.index([*TYPES, *(Definition(a, Type("+", "<methodInvocation1>", (read_type(a), read_type("+Unit")))) for a in args)])
    e.finalize()
    found = dict(e.counts.collect())
    assert counts.items() <= found.items()
    for term, n in found.items():
        assert n <= found.get({"+": "+<bottom0>", "-": "-<top0>", "/": "/<unknown0>"}[term[0]], math.inf)


def test_neutral_frequencies_of_a_table(spark):
    """Types in a table give what the list gives; a type without a text has no views, keys count once, sources without keys lead nowhere."""
    docs = DocumentStore(spark.createDataFrame([("f", ["-A", "-A", "+B"], "m"), ("g", ["+B"], "m"), ("h", [], "m")], "name string, keys array<string>, source string"))
    rows = spark.createDataFrame([("+A", ["+B"]), ("+B", None), (None, ["+B"])], "type string, supertypes array<string>")
    listed = [Definition("A", Type("+", "A"), (), (Type("+", "B"),), True), Definition("B", Type("+", "B"), is_type=True)]
    views = view_keys(rows, NeutralSettings())
    table = dict(term_frequencies(docs, views).collect())
    assert table == dict(type_frequencies(docs, listed, [v for d in listed for v in definition_views(d)]).collect())
    assert table["+B"] == 2 and table["+A"] == 2 and table["-A"] == 1 and table["-B"] == 1
    assert dict(term_frequencies(docs, views.unionByName(spark.createDataFrame([([], ["+X"])], views.schema))).collect()) == table
    assert term_frequencies(docs, views.limit(0)).count() == 0


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def drain(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_changed_values_of_a_stream(spark, tmp_path):
    rows = [("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b"), ("v", 4, "b"), ("u", 5, "a")]
    s = stream(spark, tmp_path, rows, "user string, ts long, value string")
    got = drain(spark, ev.distinct_until_changed_stream(s, "user", "ts", "value"), tmp_path, "changed")
    assert sorted(r["ts"] for r in got.collect()) == [1, 3, 4, 5]


def test_latest_of_a_stream(spark, tmp_path):
    rows = [("k", 1, "q", "x"), ("k", 2, "m", "y"), ("k", 3, "q", "z")]
    s = stream(spark, tmp_path, rows, "key string, ts long, side string, value string")
    got = drain(spark, ev.combine_latest_stream(s, ["q", "m"]), tmp_path, "latest")
    assert sorted((r["ts"], r["q"], r["m"]) for r in got.collect()) == [(2, "x", "y"), (3, "z", "y")]


def test_debounced_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1)
    rows = [("k", at + timedelta(seconds=s), s) for s in (0, 1, 2, 60, 61, 4000)]
    s = stream(spark, tmp_path, rows, "key string, ts timestamp, n int")
    got = drain(spark, ev.debounce_stream(s, ["key"], "ts", "10 seconds", "1 second"), tmp_path, "quiet")
    assert {2, 61} <= {r["n"] for r in got.collect()}


def test_ingested_stream(spark, tmp_path):
    from typeloom.engine import Engine
    from typeloom.sources.definitions import read_lines

    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.txt").write_text("type scala.Int\ntype scala.Long\np.x: scala.Int\np.y: scala.Long\n")
    e = Engine(spark, str(tmp_path / "index"))
    ev.ingest(spark.readStream.text(str(tmp_path / "lines")), e, "s", str(tmp_path / "cp"), read_lines)
    assert [r["name"] for r in e.search("Int").collect()] == ["p.x"]


def test_norms_in_a_byte(spark):
    """Against the format of 32-bit floating-point numbers itself: exponent and two digits of the fraction."""
    import struct

    lengths = [0, 1, 5, 6, 7, 8, 17, 70, 245, 246, 247, 4086, 100_000, 10**9, 10**15]
    got = spark.createDataFrame([(n,) for n in lengths], "n long").select("n", text.norm_byte(F.col("n")).alias("b"))
    for r in got.select("n", "b", text.norm_of(F.col("b")).alias("norm")).collect():
        bits = struct.unpack(">I", struct.pack(">f", (r["n"] + 10) ** -0.25))[0] >> 21
        assert r["b"] == bits - (96 << 2) and r["norm"] == struct.unpack(">f", struct.pack(">I", bits << 21))[0]
    known = {r["n"]: r["norm"] for r in got.select("n", text.norm_of(F.col("b")).alias("norm")).collect()}
    assert (known[6], known[7], known[8], known[246], known[247]) == (0.5, 0.4375, 0.4375, 0.25, 0.21875)
