"""Reading many texts that use each other's names: scopes, base types, inherited members; trees as columns."""

import pytest
from pyspark.sql import functions as F

from typeloom.functions import trees
from typeloom.functions.types import Type, read_type
from typeloom.sources.definitions import TREE
from typeloom.sources.symbols import read_project

SOURCE = "artifact string, inner_path string, text string"


def project(spark, texts, **options):
    rows = spark.createDataFrame([(f"{i}.scala", "", t) for i, t in enumerate(texts)], SOURCE)
    out = {}
    for r in read_project(rows, **options).collect():
        shown = Type.decode(r["tpe"]).signature(True) if r["tpe"] else r["error"] or ""
        if r["kind"] == "view":
            shown = f"{Type.decode(r['tpe']).annotated()} -> {Type.decode(r['target']).annotated()}"
        out.setdefault((r["kind"], r["name"]), []).append(shown)
    return out


def test_trees_as_columns(spark):
    shown = ["+A", "+A[+B, -C[/D[+E], +F], +G]", "+M[-A[+B[+C[+D]]], +<methodInvocation2>[-X, -Y[+Z], +R]]", "+P[+Q[+R[+S]]]"]
    types = [read_type(x) for x in shown]
    df = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(types)], "i int, t " + TREE.simpleString())
    got = df.select("i", trees.rendered(F.col("t")).alias("r"), trees.arguments(F.col("t")).alias("a")).collect()
    for r in got:
        t = types[r["i"]]
        assert r["r"] == str(t) and [Type.decode([tuple(n) for n in a]) for a in r["a"]] == list(t.args)


def test_substitution_is_that_of_types(spark):
    t = read_type("+M[-A[+X], +F[-Y, +X]]", {"X", "Y"})
    to = {"X": read_type("+L[+I]"), "Y": read_type("-K")}
    df = spark.createDataFrame([(t.encode(), list(to), [x.encode() for x in to.values()])], f"t {TREE.simpleString()}, n array<string>, v array<{TREE.simpleString()}>")
    got = df.select(trees.substitute(F.col("t"), F.col("n"), F.col("v")).alias("s")).first()["s"]
    assert Type.decode([tuple(n) for n in got]) == t.substitute(to)


def test_scopes(spark):
    found = project(
        spark,
        [
            "package a\nclass One\nclass Two { class In }",
            "package a.b\nclass One\nclass Deep",
            "package c\nimport a.{One => First, Two}\nimport a.b._\nclass X { def f: First = ???; def one: One = ???; def i: Two.In = ???; def d: Deep = ???; def no: Gone = ??? }",
            "package a\npackage b\nclass Y { def two: Two = ???; def one: One = ??? }",
            "package a.b\nclass Z { def two: Two = ??? }",
            "package c\nobject O { class Own; def own: Own = ??? }\nclass W { import a.One\n def one: One = ???; def own: O.Own = ???; def root: _root_.a.b.Deep = ??? }",
        ],
    )
    signature = {k[1]: v[0].split(", ", 1)[-1].rstrip("]") for k, v in found.items() if k[0] == "value" and "memberAccess" in v[0]}
    assert signature == {"c.X.f": "a.One", "c.X.one": "a.b.One", "c.X.i": "a.Two.In", "c.X.d": "a.b.Deep", "a.b.Y.two": "a.Two", "a.b.Y.one": "a.b.One", "c.W.one": "a.One", "c.W.own": "c.O.Own", "c.W.root": "a.b.Deep"}
    assert found["value", "c.O.own"] == ["c.O.Own"]
    # `package a.b` does not see what is in `a`.
    assert {k[1]: v for k, v in found.items() if k[0] == "error"} == {"c.X.no": ["type Gone not found"], "a.b.Z.two": ["type Two not found"]}


def test_base_types_and_members(spark):
    found = project(
        spark,
        [
            "package p\ntrait Top[+T] { def t: T; def both(i: Int): Int; def both(s: String): T }",
            "package p\ntrait Left[+A] extends Top[List[A]] { def l: A; def t: List[A] }\ntrait Right[+B] extends Top[B] { def r(b: Int): B }",
            "package q\nimport p._\nclass Box[C >: Int] extends Left[C] with Right[List[C]] { def both(i: Int): Int = 1 }\nobject Box extends Left[Int]",
            "package q\nclass Loop extends Loop2\nclass Loop2 extends Loop { def x: Int = 1 }",
            "package q\nclass Lost extends Nowhere { def y: Int = 1 }",
        ],
    )
    member = lambda name: [v.removeprefix("<memberAccess>[q.Box[C], ").removesuffix("]") if "memberAccess" in v else "static " + v for v in sorted(found["value", name], reverse=True)]
    lists = "scala.collection.immutable.List"
    # Right comes before Left; Top after both.
    assert member("q.Box.t") == ["static " + f"{lists}[scala.Int]", f"{lists}[C]"]
    assert member("q.Box.r") == [f"<methodInvocation1>[scala.Int, {lists}[C]]"]
    assert sorted(member("q.Box.both")) == sorted(["<methodInvocation1>[scala.Int, scala.Int]", f"<methodInvocation1>[java.lang.String, {lists}[C]]", "static <methodInvocation1>[scala.Int, scala.Int]", f"static <methodInvocation1>[java.lang.String, {lists}[scala.Int]]"])
    assert member("q.Box.l") == ["static scala.Int", "C"]
    views = found["view", "q.Box"]
    for base in ("p.Left[+C]", f"p.Right[+{lists}[+C]]", f"p.Top[+{lists}[+C]]"):
        assert views.count(f"+{base} -> +q.Box[C]") == 1
    assert found["error", "q.Lost"] == ["type Nowhere not found"] and ("type", "q.Lost") in found and ("value", "q.Lost.y") in found
    assert ("value", "q.Loop.x") in found


def test_library_and_no_texts(spark):
    library = spark.createDataFrame([("lib.Known", [])], "name string, params array<struct<name:string,variance:string>>")
    found = project(spark, ["import lib.Known\nclass A { def k: Known = ??? }"], library=library)
    assert found["value", "A.k"] == ["<memberAccess>[A, lib.Known]"]
    assert read_project(spark.createDataFrame([("a", "", None)], SOURCE)).collect() == []


@pytest.mark.parametrize("text", ["", "package", "import", "import a.{", "class A[T >: ] extends", "}}}"])
def test_broken_texts(spark, text):
    assert isinstance(project(spark, [text]), dict)
