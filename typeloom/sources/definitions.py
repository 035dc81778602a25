"""Definitions as rows: schemas, and readers of signature lines, source archives and settings."""

from __future__ import annotations

import io
import json
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import ANY, NOTHING, REPEATED, TREE, UNKNOWN, Param, Type, View, both_ways, eta, read_type
from ..functions.variance import CO, CONTRA, INV
from .files import dealt


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


STRING, STRINGS = T.StringType(), T.ArrayType(T.StringType())
PARAM = _struct(name=STRING, variance=STRING, lower=TREE, upper=TREE)
ATTRIBUTES = T.ArrayType(_struct(key=STRING, value=STRING))
#: A mixed stream of definitions. ``kind`` is value, type, view or module; ``target`` is for views.
DEFINITION = _struct(
    kind=STRING, name=STRING, params=T.ArrayType(PARAM), tpe=TREE, target=TREE, comment=STRING, attributes=ATTRIBUTES, flags=STRINGS,
    artifact=STRING, inner_path=STRING, start=T.IntegerType(), stop=T.IntegerType(), organization=STRING, module=STRING, revision=STRING, module_id=STRING, doc_link=STRING, error=STRING,
)

_LINE = re.compile(r"^\s*(?P<flags>(?:(?:implicit|override|static)\s+)*)(?P<name>[^\s\[:](?:[^\s\[]*[^\s\[:])?|\S+?)(?:\[(?P<params>.*?)\])?:\s+(?P<type>.+)$")
_TYPE_LINE = re.compile(r"^\s*type\s+(?P<type>[^\s\[]+(?:\[[^<]*\])?)(?:\s+<:\s+(?P<bases>.+))?\s*$")
_FLAGS = {"override": "overrides"}


def read_params(text: str | None) -> tuple[Param, ...]:
    """``+A, B <: Base``: names with variance and bounds."""
    out = []
    for part in _split(text or ""):
        m = re.match(r"([+-]?)(\S+?)(?:\s+>:\s+(\S+))?(?:\s+<:\s+(\S+))?$", part)
        if not m:
            raise ValueError(f"not a type parameter: {part!r}")
        lower = read_type(m[3], v=CO) if m[3] else Type(CO, NOTHING)
        upper = read_type(m[4], v=CONTRA) if m[4] else Type(CONTRA, ANY)
        out.append(Param(m[2], m[1], lower, upper))
    return tuple(out)


def _split(text: str) -> list[str]:
    """At commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "[") - (c == "]")
        if c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [x for x in [*out, text[start:].strip()] if x]


def param_rows(params) -> list[dict]:
    return [{"name": p.name, "variance": p.variance, "lower": p.lower.encode(), "upper": p.upper.encode()} for p in params]


def params_of(rows) -> list[Param]:
    return [Param(r["name"], r["variance"], Type.decode(r["lower"]), Type.decode(r["upper"])) for r in ([] if rows is None else rows)]


def value_row(name: str, tpe: Type, params=(), flags=(), comment: str = "", attributes=(), **where) -> dict:
    return {"kind": "value", "name": name, "params": param_rows(params), "tpe": tpe.encode(), "flags": sorted(flags), "comment": comment, "attributes": list(attributes), **where}


def type_row(name: str, params=(), comment: str = "", **where) -> dict:
    return {"kind": "type", "name": name, "params": param_rows(params), "comment": comment, "attributes": [], "flags": [], **where}


def view_row(view: View, **where) -> dict:
    return {"kind": "view", "name": view.entity or view.name, "tpe": view.source.encode(), "target": view.target.encode(), "params": [], "attributes": [], "flags": [], **where}


def conversion_views(name: str, tpe: Type, flags, params=()) -> list[View]:
    """A static implicit value that takes one explicit argument lets its parameter be seen as its result."""
    if not {"implicit", "static"} <= set(flags) or any(t.is_implicit for t in tpe.nodes()):
        return []
    f = eta(tpe)
    if not f.name.endswith("Function1") or len(f.args) != 2 or f.args[0].param:
        return []
    return both_ways(f.args[1].at(CO), f.args[0].at(CO), name)


def inheritance_views(sub: Type, bases: list[Type]) -> list[View]:
    """Views between a type and its bases, sequences as repeated arguments, and the arity-indexed top and bottom."""
    out = [v for b in bases for v in both_ways(b, sub, sub.name)]
    out += [v for b in (sub, *bases) if b.name.endswith(".Seq") and len(b.args) == 1 for v in both_ways(Type(CO, REPEATED, b.args), sub, sub.name)]
    n = len(sub.args)
    if n:
        out.append(View(sub.at(CO), Type(CO, f"<bottom{n}>", sub.at(CO).args), sub.name))
        out.append(View(sub.at(CONTRA), Type(CONTRA, f"<top{n}>", sub.at(CONTRA).args), sub.name))
    if sub.variance == CO:
        out.append(View(sub, Type(CO, NOTHING), sub.name))
    return out


def builtin_rows(module_id: str = "builtin") -> list[dict]:
    """Definitions every corpus has: nothing, unknown, repeated arguments, tops and bottoms, and views from any type."""
    where = {"module_id": module_id}
    x = Param("X", CO)
    rows = [type_row(NOTHING, **where), type_row(UNKNOWN, **where), type_row(REPEATED, [x], **where)]
    rows += [type_row(f"<{kind}{n}>", [Param(f"X{i}", CO) for i in range(n)], **where) for kind in ("top", "bottom") for n in range(1, 23)]
    any_ = {v: Type(v, "_", (), True) for v in (CO, CONTRA, INV)}
    pairs = [(any_[CO], Type(CO, NOTHING)), (any_[CONTRA], Type(CONTRA, ANY)), (any_[INV], Type(INV, UNKNOWN))]
    return rows + [view_row(View(a, b, f"{a.variance}any"), **where) for a, b in pairs]


def parse_line(line: str, module_id: str = "") -> list[dict]:
    """Definitions of one line: ``name[params]: type`` (a value), or ``type Name[params] <: Base, Base``.

    What cannot be read is a row with an error.
    """
    where = {"module_id": module_id}
    try:
        m = _TYPE_LINE.match(line)
        if m:
            head = re.match(r"([^\[]+)(?:\[(.*)\])?$", m["type"])
            params = read_params(head[2])
            names = {p.name for p in params}
            me = Type(CO, head[1], tuple(Type(p.variance, p.name, (), True) for p in params))
            bases = [read_type(b, names, CO) for b in _split(m["bases"] or "")]
            return [type_row(head[1], params, **where), *(view_row(v, **where) for v in inheritance_views(me, bases))]
        m = _LINE.match(line)
        if not m:
            raise ValueError(f"not a definition: {line!r}")
        params = read_params(m["params"])
        flags = [_FLAGS.get(f, f) for f in m["flags"].split()]
        tpe = read_type(m["type"], {p.name for p in params}, CO)
        views = conversion_views(m["name"], tpe, flags, params)
        return [value_row(m["name"], tpe, params, flags, **where), *(view_row(v, **where) for v in views)]
    except ValueError as problem:
        return [{"kind": "error", "name": line, "error": str(problem), **where}]


def complete(row: dict) -> dict:
    return {f.name: row.get(f.name) for f in DEFINITION.fields}


def definitions(spark: SparkSession, rows: list[dict], builtins: bool = True) -> DataFrame:
    """A definition table of rows given on the driver."""
    return spark.createDataFrame([complete(r) for r in [*(builtin_rows() if builtins else ()), *rows]], DEFINITION)


def read_lines(lines: DataFrame, column: str = "value", module: str | None = None, builtins: bool = True) -> DataFrame:
    """Definitions of a table of lines, distinct, in parallel; ``module`` names a column with module ids."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = [complete(r) for line, m in zip(frame["line"], frame["module_id"], strict=True) for r in parse_line(line, m)]
            yield pd.DataFrame(rows, columns=[f.name for f in DEFINITION.fields])

    given = lines.select(F.col(column).alias("line"), (F.col(module) if module else F.lit("")).alias("module_id")).filter("line is not null and trim(line) <> ''")
    out = dealt(given.distinct()).mapInPandas(run, DEFINITION)
    return out.unionByName(definitions(lines.sparkSession, [], True)) if builtins else out


def read_archives(spark: SparkSession, path: str, suffix: str = ".scala") -> DataFrame:
    """``(artifact, inner_path, text)`` of the entries of jar or zip files, decoded as UTF-8; broken files give a row with an error."""
    return archive_entries(spark.read.format("binaryFile").load(path).select("path", "content"), suffix)


def archive_entries(files: DataFrame, suffix: str = ".scala") -> DataFrame:
    """The same of a table ``files(path, content)``; entries leave one after the other, so that an archive's texts are not held together."""
    import pandas as pd

    columns = ["artifact", "inner_path", "text", "error"]

    def run(frames):
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for n in z.namelist():
                            if n.endswith(suffix):
                                yield pd.DataFrame([(where, n, z.read(n).decode("utf-8", "replace"), None)], columns=columns)
                except zipfile.BadZipFile as problem:
                    yield pd.DataFrame([(where, None, None, str(problem))], columns=columns)

    return files.mapInPandas(run, "artifact string, inner_path string, text string, error string")


def without_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that were read, and the others with their errors."""
    return rows.filter("error is null"), rows.filter("error is not null")


# --- documentation ----------------------------------------------------------------------

_TAG = re.compile(r"^@(\w+)\s*(.*)$", re.S)
#: Attributes that are kept, by tag (fixed values).
TAGS = {"tparam": "typeParams", "param": "params", "return": "returns", "throws": "throws", "note": "note", "see": "see", "example": "example", "author": "authors", "todo": "todo"}
_INLINE = (
    (re.compile(r"'''(.+?)'''", re.S), r"<strong>\1</strong>"),
    (re.compile(r"''(.+?)''", re.S), r"<em>\1</em>"),
    (re.compile(r"__(.+?)__", re.S), r"<u>\1</u>"),
    (re.compile(r"\^(.+?)\^", re.S), r"<sup>\1</sup>"),
    (re.compile(r",,(.+?),,", re.S), r"<sub>\1</sub>"),
    (re.compile(r"`(.+?)`", re.S), r"<code>\1</code>"),
    (re.compile(r"\[\[(\S+?://\S+?)(?:\s+(.+?))?\]\]", re.S), lambda m: f'<a href="{m[1]}">{m[2] or m[1]}</a>'),
    (re.compile(r"\[\[(\S+?)(?:\s+(.+?))?\]\]", re.S), lambda m: f"<a>{m[2] or m[1]}</a>"),
)


def _html(text: str) -> str:
    """Wiki markup as HTML: code blocks, headings, lists, rules, paragraphs."""
    out = []
    for i, piece in enumerate(re.split(r"\{\{\{(.*?)\}\}\}", text, flags=re.S)):
        if i % 2:
            out.append(f"<pre><code>{piece.strip()}</code></pre>")
            continue
        for block in re.split(r"\n\s*\n", piece):
            lines = [x.strip() for x in block.strip().splitlines() if x.strip()]
            if not lines:
                continue
            inline = " ".join(lines)
            head = re.match(r"(=+)\s*(.+?)\s*=+$", inline)
            marks = re.match(r"(-|1\.|a\.|i\.) ", lines[0])
            for pattern, to in _INLINE:
                inline = pattern.sub(to, inline)
            if head:
                level = len(head[1]) + 2
                out.append(f"<h{level}>{head[2]}</h{level}>")
            elif re.fullmatch(r"-{4,}", inline):
                out.append("<hr />")
            elif marks:
                tag = "ul" if marks[1] == "-" else "ol"
                items = re.split(r"(?:^|\s)(?:-|1\.|a\.|i\.) ", inline)[1:]
                out.append(f"<{tag}>{''.join(f'<li>{x.strip()}</li>' for x in items)}</{tag}>")
            else:
                out.append(f"<p>{inline}</p>")
    return "".join(out)


def parse_comment(text: str) -> tuple[str, list[tuple[str, str]]]:
    """A documentation comment as HTML: body, and attributes in the order of :data:`TAGS`; several of a name make one list."""
    text = re.sub(r"^\s*/\*\*|\*/\s*$", "", text)
    text = "\n".join(re.sub(r"^\s*\* ?", "", line) for line in text.splitlines())
    body, *tags = re.split(r"^\s*(?=@\w)", text, flags=re.M)
    named: dict[str, list[str]] = {}
    for tag in tags:
        m = _TAG.match(tag.strip())
        if m and m[1] in TAGS:
            key, _, rest = m[2].strip().partition(" ")
            named.setdefault(m[1], []).append(f"<dt>{key}</dt><dd>{_html(rest)}</dd>" if m[1] in ("param", "tparam", "throws") else _html(m[2]))
    return _html(body), [(TAGS[k], _listed(k, named[k])) for k in TAGS if k in named]


def _listed(tag: str, found: list[str]) -> str:
    if tag in ("param", "tparam", "throws"):
        return f"<dl>{''.join(found)}</dl>"
    return found[0] if len(found) == 1 else f"<ul>{''.join(f'<li>{x}</li>' for x in found)}</ul>"


def to_json_lines(rows: DataFrame) -> DataFrame:
    """Entities of any table as one JSON text a row (``value``), nulls left out: what is sent or appended elsewhere."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def from_json_lines(lines: DataFrame, schema: T.StructType = DEFINITION) -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("e")).select("e.*")


# --- settings ---------------------------------------------------------------------------


def read_settings(text: str) -> dict:
    """Settings as JSON: modules to extract and evaluation projects with their queries."""
    found = json.loads(text)
    for m in found.get("modules", ()):
        m["doc_url"] = m.get("doc_url") or None
    return found


def modules_frame(spark: SparkSession, settings: dict) -> DataFrame:
    rows = [(m["organization"], m["name"], m["revision"], m.get("artifact"), m["doc_url"]) for m in settings.get("modules", ())]
    return spark.createDataFrame(rows, "organization string, name string, revision string, artifact string, doc_url string")


def golden_frame(spark: SparkSession, settings: dict) -> DataFrame:
    """``(project, query, relevant_signature)`` of the evaluation projects."""
    rows = [(p["name"], q, s) for p in settings.get("projects", ()) for q, wanted in p["queries"].items() for s in wanted]
    return spark.createDataFrame(rows, "project string, query string, relevant_signature string")


_SETTINGS = (
    "modules array<struct<organization:string,name:string,revision:string,artifact:string,doc_url:string>>,"
    "projects array<struct<name:string,queries:map<string,array<string>>>>"
)


def settings_rows(texts: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Modules and judged queries of many settings texts, read where the texts are: the columns of :func:`modules_frame` and :func:`golden_frame`.

    A text that is no JSON object, or null, has neither; an empty address is none.
    """
    read = texts.select(F.from_json(column, _SETTINGS).alias("s"))
    m = read.select(F.explode("s.modules").alias("m")).select("m.*").withColumn("doc_url", F.when(F.col("doc_url") != "", F.col("doc_url")))
    p = read.select(F.explode("s.projects").alias("p")).select(F.col("p.name").alias("project"), F.explode("p.queries").alias("query", "wanted"))
    return m, p.select("project", "query", F.explode("wanted").alias("relevant_signature"))


def jobs(wanted: DataFrame, resolved: DataFrame) -> DataFrame:
    """Resolved modules among those wanted, once each."""
    key = ["organization", "name", "revision"]
    return resolved.join(wanted.select(*key).distinct(), key, "left_semi").dropDuplicates(key)
