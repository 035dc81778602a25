import zipfile

from typeloom.functions.types import Type
from typeloom.sources.declarations import read_declarations
from typeloom.sources.definitions import conversion_views, golden_frame, jobs, modules_frame, parse_comment, parse_line, read_archives, read_lines, read_settings, settings_rows, without_errors
from typeloom.sources.files import Folder, append_csv


def test_value_lines():
    row = parse_line("implicit static a.B.conv[+T <: p.Base]: <methodInvocation1>[T, p.D]", "m")[0]
    assert (row["name"], row["flags"], row["module_id"]) == ("a.B.conv", ["implicit", "static"], "m")
    assert row["params"][0]["name"] == "T" and str(Type.decode(row["params"][0]["upper"])) == "-p.Base"
    assert str(Type.decode(row["tpe"])) == "+<methodInvocation1>[-T, +p.D]"
    assert parse_line("a.::: X")[0]["name"] == "a.::"


def test_type_lines():
    rows = parse_line("type p.Box[+T] <: p.Base[T], q.Seq[T]")
    assert [r["kind"] for r in rows][:1] == ["type"]
    shown = {str(Type.decode(r["tpe"])) + " -> " + str(Type.decode(r["target"])) for r in rows[1:]}
    assert "+p.Base[+T] -> +p.Box[+T]" in shown and "-p.Box[-T] -> -p.Base[-T]" in shown
    assert "+scala.<repeated>[+T] -> +p.Box[+T]" in shown and "+p.Box[+T] -> +scala.Nothing" in shown


def test_bad_lines_are_kept_as_errors(spark):
    rows = read_lines(spark.createDataFrame([("x [: y",), ("a.b: C",), ("a.b: C",), (None,), ("  ",)], "value string"), builtins=False)
    good, bad = without_errors(rows)
    assert good.count() == 1 and bad.count() == 1


def test_conversions():
    from typeloom.functions.types import read_type

    t = read_type("<methodInvocation1>[p.A, p.B]", v="+")
    assert {v.name for v in conversion_views("c", t, ["implicit", "static"])} == {"+p.B -> +p.A", "-p.A -> -p.B"}
    assert conversion_views("c", t, ["implicit"]) == []
    assert conversion_views("c", read_type("<methodInvocation2>[p.A, p.C, p.B]", v="+"), ["implicit", "static"]) == []


def test_comments():
    body, attributes = parse_comment("/** Creates '''one''' `x`.\n *\n * {{{\n * code\n * }}}\n * @param a the first\n * @param b\n * @return [[http://x.y it]]\n * @unknown z\n */")
    assert body == "<p>Creates <strong>one</strong> <code>x</code>.</p><pre><code>code</code></pre>"
    assert [k for k, _ in attributes] == ["params", "returns"]
    assert "<dt>a</dt><dd><p>the first</p></dd>" in attributes[0][1] and '<a href="http://x.y">it</a>' in attributes[1][1]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.jar", "w") as z:
        z.writestr("p/A.scala", "class Ä")
        z.writestr("p/A.class", "no")
    (tmp_path / "b.jar").write_bytes(b"broken")
    rows = read_archives(spark, str(tmp_path)).collect()
    assert [r["text"] for r in rows if r["text"]] == ["class Ä"] and sum(r["error"] is not None for r in rows) == 1


def test_settings(spark):
    s = read_settings('{"modules": [{"organization": "o", "name": "n", "revision": "1", "doc_url": ""}], "projects": [{"name": "p", "queries": {"A": ["x", "y"]}}]}')
    m = modules_frame(spark, s)
    assert m.first()["doc_url"] is None
    assert golden_frame(spark, s).count() == 2
    assert jobs(m, m.union(m)).count() == 1
    texts = [('{"modules": [{"organization": "o", "name": "n", "revision": "1", "doc_url": ""}], "projects": [{"name": "p", "queries": {"A": ["x", "y"], "B": []}}]}',), ("{",), (None,), ("{}",)]
    modules, golden = settings_rows(spark.createDataFrame(texts, "value string"))
    assert modules.collect() == m.collect() and golden.columns == golden_frame(spark, s).columns
    assert sorted(golden.collect()) == sorted(golden_frame(spark, s).collect())


def test_files(spark, tmp_path):
    f = Folder(spark, str(tmp_path / "x"))
    assert f.read_json("a", {}) == {} and f.names() == []
    f.write_json("a", {"b": 1})
    f.write_json("a", {"b": 2})
    assert f.read_json("a") == {"b": 2}
    append_csv(spark.range(2), str(tmp_path / "csv"))
    append_csv(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4


def test_fetch_copies_what_is_missing(spark, tmp_path):
    (tmp_path / "a.jar").write_bytes(b"jar")
    folder = Folder(spark, str(tmp_path / "held"))
    assert folder.fetch(f"file://{tmp_path}/a.jar", "b.jar") and not folder.fetch("file:///nowhere", "b.jar")
    assert (tmp_path / "held" / "b.jar").read_bytes() == b"jar"


def test_declarations():
    text = """package a { package b
      /** A box. @param no tag inside a line
        * @tparam T held
        * @todo more
        * @todo and more */
      sealed abstract class Box[+T <: Any] private (x: Int) extends Base(1) with (Int => String) { self =>
        protected[b] def no: Int; def yes(implicit o: Ord[T]): Option[T] = { class Local { def z: Int = 1 }; None }
        lazy val many: (Int, String) => T = ???
        def times(by: => T, rest: T*): Box[T]
        var `type`: Array[Int] = null
        def untyped = 1
      }
      object Box { implicit def unbox[T](b: Box[T]): List[T] = Nil; private object Hidden { val q: Int = 1 } }
    }
    def outside(s: "x" = "}"): Int"""
    rows = read_declarations(text, module_id="m")
    found = {r["name"]: r for r in rows if r["kind"] == "value"}
    shown = {n: Type.decode(r["tpe"]).signature(True) for n, r in found.items()}
    assert shown["a.b.Box.yes"] == "<memberAccess>[a.b.Box[T], <methodInvocation1>[<implicit>[Ord[T]], scala.Option[T]]]"
    assert shown["a.b.Box.many"] == "<memberAccess>[a.b.Box[T], scala.Function2[scala.Int, java.lang.String, T]]"
    assert shown["a.b.Box.times"] == "<memberAccess>[a.b.Box[T], <methodInvocation2>[<byname>[T], scala.<repeated>[T], a.b.Box[T]]]"
    assert shown["a.b.Box.type"] == "<memberAccess>[a.b.Box[T], scala.Array[scala.Int]]"
    assert found["a.b.Box.unbox"]["flags"] == ["implicit", "static"] and found["a.b.Box.unbox"]["doc_link"] == "a.b.Box$@unbox(b:Box[T]):List[T]"
    assert not any(x in n for n in found for x in ("no", "Local", "Hidden", "<init>", ".z", ".q")) and "a.b.Box" in found
    assert [r["name"] for r in rows if r["kind"] == "error"] == ["a.b.Box.untyped"]
    box = next(r for r in rows if r["kind"] == "type")
    assert box["comment"] == "<p>A box. @param no tag inside a line</p>"
    assert [(a["key"], a["value"]) for a in box["attributes"]] == [("typeParams", "<dl><dt>T</dt><dd><p>held</p></dd></dl>"), ("todo", "<ul><li><p>more</p></li><li><p>and more</p></li></ul>")]
    views = [r["name"] for r in rows if r["kind"] == "view"]
    assert views.count("a.b.Box.unbox") == 2 and views.count("a.b.Box") >= 4
    assert read_declarations("") == [] and isinstance(read_declarations("class { ( [ def : } object" * 50), list)
