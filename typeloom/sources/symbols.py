"""Definitions of many source texts that use each other's names.

1. *Outline.* Each text gives the types it declares, and of each name it mentions the qualified names that it may stand for, by the
   scopes it is in: the types around it, imports by name, imports of all, packages.
2. *Link.* The table of all declared types is joined with the candidates; the first that exists is meant. Libraries
   (the types of another index) are further rows of that table.
3. *Definitions.* Each text is read again with its own names resolved. A name that stands for nothing makes
   an error row of the definition that mentions it.
4. *Base types.* A fixpoint over the table of parents, with type arguments put in for parameters: each round is one
   join, and goes on with what has changed. Every base type gives views, and every member of a base type is a member of the type.

What a text holds together is its own names and rows; all else is joined.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.trees import arguments, at_root, let, rendered, substitute
from ..functions.types import FUNCTION, TUPLE, Param, Type
from ..plans.errors import QueryError
from ..plans.language import Raw
from ..plans.language import read_type as read_raw
from .declarations import STANDARD, Declared, Owner, Reader, Resolver, plain_type, read_declarations
from .definitions import DEFINITION, complete, inheritance_views, view_row
from .files import dealt, kept

#: Roots of names that are never declared in the texts themselves (fixed values).
EXTERNAL = ("scala", "java", "javax")
PARENT = "parent"
_OUTLINE = "source string, what string, name string, ref string, candidates array<string>, params array<struct<name:string,variance:string>>"


def candidates(owner: Owner, name: str, local: set[str]) -> list[str]:
    """Qualified names that ``name`` may stand for inside ``owner``, the closest first."""
    if name.startswith("_root_."):
        return [name[7:]]
    head, _, rest = name.partition(".")
    packages = [s for kind, s, _ in owner.scopes if kind == "package"]
    out: list[str] = []

    def add(path: str, tail: str) -> None:
        whole = f"{path}.{tail}" if tail else path
        out.extend([*(f"{p}.{whole}" for p in packages), whole])

    for kind, path, alias in reversed(owner.scopes):
        if kind == "import" and alias == head:
            add(path, rest)
        elif kind == "type":
            out.append(f"{path}.{name}")
        elif kind == "package" and f"{path}.{head}" in local:
            out.append(f"{path}.{name}")
    for kind, path, _ in reversed(owner.scopes):
        if kind == "all":
            add(path, name)
    out += [f"{p}.{name}" for p in reversed(packages)]
    return list(dict.fromkeys([*out, name]))


def _names(raw: Raw, bound: set[str]) -> set[str]:
    arity = len(raw.args)
    own = raw.name not in bound and raw.name not in (FUNCTION.format(arity - 1), TUPLE.format(arity))
    return ({raw.name} if own else set()).union(*(_names(a, bound) for a in raw.args))


def _mentioned(d: Declared) -> set[str]:
    owner = d.me or d.owner
    bound = {p.name for p in owner.params} | {p[0] for p in d.params}
    texts = [*d.parents, d.result, *(t for _, ps in d.clauses for _, t in ps), *(b for p in (*owner.written, *d.params) for b in p[2:])]
    out: set[str] = set()
    for t in filter(None, texts):
        try:
            out |= _names(read_raw(plain_type(t)), bound)
        except QueryError:
            pass  # reported where the definition is read
    return out


def outline(body: str) -> list[tuple]:
    """``(what, name, ref, candidates, params)`` of one text: its types, and the names it mentions with their scopes."""
    found = Reader(body).found
    rows, local = [], {d.me.name for d in found if d.me is not None}
    for d in found:
        if d.me is not None:
            name = d.me.name + (".type" if d.me.kind == "object" else "")
            rows.append(("type", name, None, None, [{"name": p.name, "variance": p.variance} for p in d.me.params]))
    refs = {}
    for d in found:
        owner = d.me or d.owner
        for name in sorted(_mentioned(d)):
            refs[f"{owner.scope} {name}"] = candidates(owner, name, local)
    return rows + [("name", None, ref, among, None) for ref, among in refs.items()]


class Linked(Resolver):
    """Types of declarations by names that are resolved already."""

    def __init__(self, links: dict[str, tuple[str, tuple[Param, ...]]]):
        self.links, self.scope = links, 0

    def qualified(self, name: str) -> tuple[str, tuple[Param, ...]]:
        hit = self.links.get(f"{self.scope} {name}")
        if hit:
            return hit
        if name in STANDARD or name.split(".")[0] in EXTERNAL:
            return STANDARD.get(name, "") + name, ()
        raise ValueError(f"type {name} not found")


def _texts(sources: DataFrame, text: str, artifact: str, inner: str, module: str | None) -> DataFrame:
    given = sources.select(F.col(text).alias("body"), F.col(artifact).alias("path"), F.col(inner).alias("entry"), (F.col(module) if module else F.lit("")).alias("module"))
    return given.filter("body is not null").distinct().withColumn("source", F.sha2(F.to_json(F.struct("module", "path", "entry", "body")), 256))


def symbol_table(outlines: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """``(name, params)`` of all types that are declared, once each; ``library`` adds such rows."""
    own = outlines.filter("what = 'type'").select("name", "params")
    if library is not None:
        own = own.union(library.select("name", F.transform("params", lambda p: F.struct(p["name"].alias("name"), p["variance"].alias("variance")))))
    return own.groupBy("name").agg(F.min("params").alias("params"))


def link(outlines: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(source, links)``: what the names of each text stand for; the first candidate that is declared."""
    asked = outlines.filter("what = 'name'").select("source", "ref", F.posexplode("candidates").alias("rank", "name"))
    first = asked.join(symbols, "name").groupBy("source", "ref").agg(F.min(F.struct("rank", "name", "params")).alias("to"))
    return first.groupBy("source").agg(F.collect_list(F.struct("ref", "to.name", "to.params")).alias("links"))


def read_project(sources: DataFrame, text: str = "text", artifact: str = "artifact", inner: str = "inner_path", module: str | None = None, library: DataFrame | None = None) -> DataFrame:
    """Definitions of a table of source texts that use each other's names, with base types and inherited members.

    ``library``: ``(name, params)`` of types that are declared elsewhere, such as the type definitions of an index.
    """
    import pandas as pd

    names = [f.name for f in DEFINITION.fields]
    texts = _texts(sources, text, artifact, inner, module)

    def outlined(frames):
        for frame in frames:
            rows = [(s, *r) for s, body in zip(frame["source"], frame["body"], strict=True) for r in outline(body)]
            yield pd.DataFrame(rows, columns=["source", "what", "name", "ref", "candidates", "params"])

    def defined(frames):
        for frame in frames:
            rows = []
            for body, path, entry, m, links in zip(frame["body"], frame["path"], frame["entry"], frame["module"], frame["links"], strict=True):
                known = {x["ref"]: (x["name"], tuple(Param(p["name"], p["variance"]) for p in x["params"])) for x in (() if links is None else links)}
                rows += [complete(r) for r in read_declarations(body, Linked(known), artifact=path, inner_path=entry, module_id=m)]
            yield pd.DataFrame(rows, columns=names)

    outlines = kept(dealt(texts.select("source", "body")).mapInPandas(outlined, _OUTLINE))  # asked for its types, and for its names
    linked = texts.join(link(outlines, symbol_table(outlines, library)), "source", "left")
    made = kept(dealt(linked).mapInPandas(defined, DEFINITION))
    bases = base_types(made.filter(F.col("kind") == PARENT))
    every = made.filter(F.col("kind") != PARENT).unionByName(base_views(made, bases))
    return every.unionByName(inherited_members(made, bases))


# --- base types ---------------------------------------------------------------------------


def base_types(parents: DataFrame) -> DataFrame:
    """``(name, own, static, module_id, base, base_name, path)``: every base type of each type in terms of its own parameters, once each.

    ``parents``: definition rows with the type in ``tpe``, a parent in ``target``, its place among the parents in ``start``. ``path`` orders the
    bases of a type as they are searched for members: parents from the right, a base after all that extend it.
    A type that comes back to itself is not followed.
    """
    edges = parents.select("name", F.col("tpe").alias("own"), F.array_contains("flags", "static").alias("static"), "module_id", F.col("target").alias("base"), F.col("target")[0]["name"].alias("base_name"), (-F.col("start")).alias("turn")).distinct()
    edges = kept(edges)
    up = edges.filter(~F.col("static")).select(F.col("name").alias("base_name"), F.col("own").alias("at"), F.col("base").alias("next"), F.col("base_name").alias("next_name"), F.col("turn").alias("next_turn")).distinct()
    key = ["name", "static", "module_id", "base_name"]
    state = front = edges.withColumn("path", F.array("turn")).withColumn("seen", F.array("name", "base_name")).drop("turn")
    while True:
        given = F.transform(arguments(F.col("at")), lambda a: a[0]["name"])
        hop = front.join(up, "base_name").filter(~F.array_contains("seen", F.col("next_name")))
        hop = hop.select(
            "name", "own", "static", "module_id", let(given, lambda names: let(arguments(F.col("base")), lambda values: substitute(F.col("next"), names, values))).alias("base"), F.col("next_name").alias("base_name"),
            F.array_append("path", F.col("next_turn")).alias("path"), F.array_append("seen", F.col("next_name")).alias("seen"),
        )
        last = F.max_by(F.struct("own", "base", "path", "seen"), "path").alias("r")
        hop = hop.groupBy(*key).agg(last).select(*key, "r.*")
        known = state.groupBy(*key).agg(F.max("path").alias("before"))
        front = kept(hop.join(known, key, "left").filter("before is null or path > before").drop("before").select(*state.columns))
        if front.isEmpty():
            return state.drop("seen")
        state = kept(state.unionByName(front).groupBy(*key).agg(last).select(*key, "r.*").select(*state.columns))


def base_views(made: DataFrame, bases: DataFrame) -> DataFrame:
    """Definition rows of the views between each type and all its base types; those of a type come from one row."""
    import pandas as pd

    types = made.filter("kind = 'type'").select("name", F.array_contains("flags", "static").alias("static"), "module_id", "params", "artifact", "inner_path")
    own = types.select("name", "static", "module_id", "artifact", "inner_path", F.concat(F.array(F.struct(F.lit("+").alias("variance"), F.col("name").alias("name"), F.size("params").alias("arity"), F.lit(False).alias("is_param"))), F.transform("params", lambda p: F.struct(p["variance"].alias("variance"), p["name"].alias("name"), F.lit(0).alias("arity"), F.lit(True).alias("is_param")))).alias("own"))
    objects = made.filter("kind = 'value' and tpe[0].name = concat(name, '.type')").select("name", F.lit(True).alias("static"), "module_id", "artifact", "inner_path", F.col("tpe").alias("own"))
    every = own.unionByName(objects).distinct()
    held = bases.groupBy("name", "static", "module_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("path", "base"))), lambda x: x["base"]).alias("bases"))

    def run(frames):
        names = [f.name for f in DEFINITION.fields]
        for frame in frames:
            rows = []
            for tree, trees, m, path, entry in zip(frame["own"], frame["bases"], frame["module_id"], frame["artifact"], frame["inner_path"], strict=True):
                found = inheritance_views(Type.decode(json.loads(tree)), [Type.decode(t) for t in json.loads(trees or "[]")])
                rows += [complete(view_row(v, module_id=m, artifact=path, inner_path=entry)) for v in found]
            yield pd.DataFrame(rows, columns=names)

    nested = [F.to_json(c).alias(c) for c in ("own", "bases")]
    rows = every.join(held, ["name", "static", "module_id"], "left").select("artifact", "inner_path", "module_id", *nested)
    return dealt(rows).mapInPandas(run, DEFINITION)


def _first_clause(tree: Column) -> Column:
    """The parameter types of a method's first clause, as text; of anything else nothing."""
    method = tree[0]["name"].startswith("<methodInvocation")
    return F.when(method, let(arguments(tree), lambda a: F.array_join(F.transform(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x: rendered(x)), ", "))).otherwise("")


def inherited_members(made: DataFrame, bases: DataFrame) -> DataFrame:
    """Definition rows of the members that types have from their base types, in terms of the type's own parameters.

    A member with the same name and first clause that the type declares itself, or that a base closer to it declares, hides the others.
    """
    values = made.filter("kind = 'value' and tpe[0].name = '<memberAccess>'")
    whole = arguments(F.col("tpe"))
    short = F.element_at(F.split("name", r"\.(?=[^.]*$)"), -1)
    members = values.select("*", whole[0].alias("holder"), whole[1].alias("of"), short.alias("short")).withColumn("base_name", F.col("holder")[0]["name"])
    fields = [c for c in DEFINITION.fieldNames() if c not in ("name", "tpe", "params", "module_id")]
    b = bases.select(F.col("name").alias("sub"), "own", "static", F.col("module_id").alias("sub_module"), "base", "base_name", "path")
    taken = b.join(members, "base_name")
    names = F.transform(arguments(F.col("holder")), lambda a: a[0]["name"])
    of = let(names, lambda ns: let(arguments(F.col("base")), lambda vs: substitute(F.col("of"), ns, vs)))
    taken = taken.withColumn("of", of)
    node = F.struct(F.lit("+").alias("variance"), F.lit("<memberAccess>").alias("name"), F.lit(2).alias("arity"), F.lit(False).alias("is_param"))
    tpe = F.when(F.col("static"), F.col("of")).otherwise(F.concat(F.array(node), at_root("-", F.col("own")), F.col("of")))
    # The type's own parameters, then the method's.
    mine = made.filter("kind = 'type'").select(F.col("name").alias("sub"), F.col("module_id").alias("sub_module"), F.col("params").alias("sub_params")).distinct()
    taken = taken.join(mine, ["sub", "sub_module"], "left")
    none = F.slice("params", 1, 0)
    own_params = F.when(F.col("static"), none).otherwise(F.coalesce("sub_params", none))
    params = F.concat(own_params, F.slice("params", F.size(arguments(F.col("holder"))) + 1, F.size("params")))
    taken = taken.select(F.concat("sub", F.lit("."), "short").alias("name"), tpe.alias("tpe"), params.alias("params"), F.col("sub_module").alias("module_id"), F.array_sort(F.array_distinct(F.concat("flags", F.when(F.col("static"), F.array(F.lit("static"))).otherwise(F.array().cast("array<string>"))))).alias("all_flags"), *fields, "path", "static", _first_clause(F.col("of")).alias("clause"))
    taken = taken.withColumn("flags", F.col("all_flags")).drop("all_flags")
    first = F.min_by(F.struct(*DEFINITION.fieldNames()), F.struct("path", "start")).alias("r")
    key = ["name", "static", "module_id", "clause"]
    taken = taken.groupBy(*key).agg(first)
    own_members = made.filter("kind = 'value'").select("name", (F.col("tpe")[0]["name"] != "<memberAccess>").alias("static"), "module_id", _first_clause(F.when(F.col("tpe")[0]["name"] == "<memberAccess>", whole[1]).otherwise(F.col("tpe"))).alias("clause")).distinct()
    return taken.join(own_members, key, "left_anti").select("r.*").select(*DEFINITION.fieldNames())


def signatures(definitions: DataFrame) -> DataFrame:
    """Definitions with their types as text: ``signature``, and for views ``seen_as``."""
    return definitions.withColumn("signature", rendered(F.col("tpe"))).withColumn("seen_as", rendered(F.col("target")))
