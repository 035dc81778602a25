"""Queries of the type algebra, the query language and planning, and their SQL.

Types and queries are written out from the parts' columns (brand, type, size, name); the SQL spells out what the library makes of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.types import Param, Type, View, both_ways, fingerprint, normalize, read_type, show_terms, structure, unify, without_implicits
from .functions.variance import CO, CONTRA, INV
from .plans import expansion
from .plans.errors import QueryError
from .plans.language import parse
from .plans.resolve import TypeName, resolve, standard_by_name, to_type
from .registry import query, table
from .sources.files import dealt

#: Names of a part: brand, type, and its size as a type.
_P = "p AS (SELECT p_partkey, p_brand AS a, p_type AS b, 'S' || p_size AS s, p_name, p_size FROM part)"


def _parts(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("a"), F.col("p_type").alias("b"), F.concat(F.lit("S"), "p_size").alias("s"), "p_name", "p_size")


#: Results that a task of :func:`through` keeps.
FOUND = 50_000


def through(rows: DataFrame, f: Callable[..., tuple], schema: str, keys: int = 0) -> DataFrame:
    """``f`` of each row's columns, in batches; with ``keys``, the first columns are given back as they are and before what ``f`` makes of the others.

    Rows are dealt out, as a table of many rows can be one file of few bytes. With ``keys``, what ``f`` gave is kept for rows with the same
    columns, which are far fewer than rows.
    """
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        known: dict[tuple, tuple] = {}
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                asked = row[keys:]
                if not keys:
                    out.append(f(*asked))
                    continue
                found = known.get(asked)
                if found is None:
                    if len(known) >= FOUND:
                        known.clear()
                    found = known[asked] = f(*asked)
                out.append(row[:keys] + found)
            yield pd.DataFrame(out, columns=names)

    return dealt(rows).toDF(*[f"c{i}" for i in range(len(rows.columns))]).mapInPandas(run, schema)


# --- type algebra -----------------------------------------------------------------------

_SAME, _FLIPPED, _NONE = "'Box[+' || a || ', -' || b || ', ' || s || ']'", "'Box[-' || a || ', +' || b || ', ' || s || ']'", "'Box[' || a || ', ' || b || ', ' || s || ']'"


@query(
    f"WITH {_P} SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '+' || {_SAME} ELSE '+' || {_FLIPPED} END AS co, CASE WHEN p_partkey % 3 = 1 THEN '-' || {_SAME} ELSE '-' || {_FLIPPED} END AS contra, "
    f"CASE WHEN p_partkey % 3 = 2 THEN {_SAME} ELSE {_NONE} END AS inv, CASE p_partkey % 3 WHEN 0 THEN '+' || {_SAME} WHEN 1 THEN '+' || {_FLIPPED} ELSE {_SAME} END AS position_co, "
    f"CASE p_partkey % 3 WHEN 0 THEN '-' || {_FLIPPED} WHEN 1 THEN '-' || {_SAME} ELSE {_SAME} END AS position_contra, CASE WHEN p_partkey % 3 = 2 THEN {_SAME} ELSE {_NONE} END AS position_inv FROM p"
)
def type_variances(spark, d):
    """A type at each variance, and in a position of each."""
    sign = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("/")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = _parts(spark, d).select("p_partkey", F.concat(sign, F.lit("Box[+"), "a", F.lit(", -"), "b", F.lit(", /"), "s", F.lit("]")))

    def f(text):
        t = read_type(text)
        return (*(str(t.at(v)) for v in (CO, CONTRA, INV)), *(str(t.position(v)) for v in (CO, CONTRA, INV)))

    return through(rows, f, "p_partkey long, co string, contra string, inv string, position_co string, position_contra string, position_inv string", keys=1)


@query(
    f"WITH {_P} SELECT p_partkey, '+Map[-' || a || ', ' || b || ']' AS shown, 'Map[' || a || ', ' || b || ']' AS signature, '+Map[-_, _]' AS key, '+<implicit>[-' || s || ']' AS with_implicit, s AS unwrapped, "
    "lower('Map[' || a || ', ' || b || ']') AS transformed, 3 AS nodes FROM p"
)
def type_rendering(spark, d):
    rows = _parts(spark, d).select("p_partkey", "s", F.concat(F.lit("+Map[-"), "a", F.lit(", /"), "b", F.lit("]")))

    def f(s, text):
        t, wrapped = read_type(text), Type(CO, "<implicit>", (Type(CONTRA, s),))
        return str(t), t.signature(), t.key(), str(wrapped), wrapped.signature(), t.transform(lambda x: replace(x, name=x.name.lower())).signature(), len(list(t.nodes()))

    return through(rows, f, "p_partkey long, shown string, signature string, key string, with_implicit string, unwrapped string, transformed string, nodes int", keys=1)


_FITS = "p_size % 2 = 0"


@query(
    f"WITH {_P} SELECT p_partkey, CASE WHEN {_FITS} THEN 'X=+' || a || ', Y=+' || b END AS bindings, '+Pair[-' || b || ', +' || a || ']' AS substituted, "
    f"CASE WHEN {_FITS} THEN '+Pair[-' || b || ', +' || a || ']' END AS seen_as, CASE WHEN {_FITS} THEN '+Swap[+' || a || ']' END AS composed, 0.75::DOUBLE AS kept, 1 AS distance FROM p"
)
def type_bindings(spark, d):
    """Unification, substitution, application and composition of views, on types that fit every other time."""
    rows = _parts(spark, d).select("p_partkey", "a", "b", F.concat(F.lit("+Map[+"), "a", F.lit(", +"), F.when(F.expr(_FITS), "List").otherwise("Set"), F.lit("[+"), "b", F.lit("]]")))
    pattern, target = read_type("+Map[+X, +List[+Y]]", {"X", "Y"}), read_type("+Pair[-Y, +X]", {"X", "Y"})
    view = View(pattern, target)
    both = view.then(View(read_type("+Pair[-P, +Q]", {"P", "Q"}), read_type("+Swap[+Q]", {"P", "Q"})))

    def f(a, b, text):
        t = read_type(text)
        found, seen, composed = unify(pattern, t), view(t), both(t)
        shown = None if found is None else ", ".join(f"{n}={found[n]}" for n in sorted(found))
        return shown, str(target.substitute({"X": Type(CO, a), "Y": Type(CO, b)})), seen and str(seen), composed and str(composed), both.retained, both.distance

    return through(rows, f, "p_partkey long, bindings string, substituted string, seen_as string, composed string, kept double, distance int", keys=1)


@query(
    f"WITH {_P} SELECT p_partkey, '+<ignored3>[-' || a || ', -<implicit>[-Ord[-' || s || ']], +List[+scala.Nothing]]' AS normalized, '+<methodInvocation1>[-' || a || ', +List[+T]]' AS explicit, "
    "'!+List !+scala.Nothing !-' || a || ' ?-Ord ?-' || s AS fingerprint, '!' || a || ' !List ?Ord ?' || s || ' !scala.Nothing' AS unpolarized, '+scala.Function1[_, +scala.Function1[+<implicit>[_], _]]' AS structure FROM p"
)
def normalized_types(spark, d):
    """A method with an implicit argument and a type parameter: normal form, without implicits, fingerprints, shape."""
    rows = _parts(spark, d).select("p_partkey", F.concat(F.lit("<methodInvocation1>["), "a", F.lit(", <methodInvocation1>[<implicit>[Ord["), "s", F.lit("]], List[T]]]")))
    params = [Param("T")]

    def f(text):
        t = read_type(text, {"T"}, CO)
        return str(normalize(t, params)), str(without_implicits(t)), show_terms(fingerprint(t, params)), show_terms(fingerprint(t, params, False)), str(structure(t))

    return through(rows, f, "p_partkey long, normalized string, explicit string, fingerprint string, unpolarized string, structure string", keys=1)


# --- query language ---------------------------------------------------------------------

_QUERIES = (  # text, keywords, type, as SQL over p
    ("a", "''", "a"),
    ("'find all: List[' || a || ']'", "'find all'", "'List[' || a || ']'"),
    ("'(' || a || ', ' || b || ') => ' || s", "''", "'scala.Function2[' || a || ', ' || b || ', ' || s || ']'"),
    ("a || ' => ' || b || ' => ' || s", "''", "'scala.Function1[' || a || ', scala.Function1[' || b || ', ' || s || ']]'"),
    ("'(' || a || ', ' || b || ')'", "''", "'scala.Tuple2[' || a || ', ' || b || ']'"),
    ("p_name", "p_name", "NULL"),
    ("'() => ' || a", "''", "'scala.Function0[' || a || ']'"),
    ("'p.q.C[' || a || '.N]'", "''", "'p.q.C[' || a || '.N]'"),
    ("'\"to ' || b || '\": (' || a || ')'", "'to ' || b", "a"),
    ("'::[' || a || ', Map[' || b || ', ' || s || ']]'", "''", "'::[' || a || ', Map[' || b || ', ' || s || ']]'"),
)


def _case(place: int) -> str:
    return f"CASE p_partkey % {len(_QUERIES)} " + " ".join(f"WHEN {i} THEN {q[place]}" for i, q in enumerate(_QUERIES)) + " END"


@query(f"WITH {_P} SELECT p_partkey, {_case(0)} AS text, {_case(1)} AS keywords, {_case(2)} AS type FROM p")
def parsed_queries(spark, d):
    rows = _parts(spark, d).select("p_partkey", F.expr(_case(0)))

    def f(text):
        found = parse(text)
        return text, found.keywords, None if found.type is None else str(found.type)

    return through(rows, f, "p_partkey long, text string, keywords string, type string", keys=1)


def _known(name: str) -> list[TypeName]:
    """Two lists, an ambiguous name, and whatever begins as the parts' names do."""
    item = Param("A", CO)
    held = {"List": [TypeName("coll.List", (item,)), TypeName("scala.List", (item,))], "Both": [TypeName("p.Both"), TypeName("q.Both")], "Array": [TypeName("scala.Array", (Param("A", INV),))]}
    own = standard_by_name().get(name)
    return held.get(name) or (own and [own]) or ([TypeName(name)] if name[:1] in "BSEMPL" and len(name) > 1 else [])


@query(
    f"WITH {_P} SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '+scala.Function1[-scala.List[-' || a || '], +' || s || ']' WHEN 1 THEN '+scala.Function1[-scala.Any, +' || a || ']' WHEN 2 THEN '+scala.List[+scala.Nothing]' "
    "WHEN 3 THEN '+scala.Array[' || a || ']' ELSE '+scala.Tuple2[+scala.Array[<unknown>], +scala.Nothing]' END AS type FROM p"
)
def resolved_queries(spark, d):
    """Names to types: the preferred of several, single letters as any type, arguments left out, signs by the parameters."""
    text = "CASE p_partkey % 5 WHEN 0 THEN 'List[' || a || '] => ' || s WHEN 1 THEN 'T => ' || a WHEN 2 THEN 'List' WHEN 3 THEN 'Array[' || a || ']' ELSE '(Array[_], Z)' END"
    return through(_parts(spark, d).select("p_partkey", F.expr(text)), lambda q: (str(to_type(resolve(parse(q).type, _known))),), "p_partkey long, type string", keys=1)


@query(
    f"WITH {_P} SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Syntax error: expected '']'', found ''the end''' WHEN 1 THEN 'Type x' || a || ' not found.' WHEN 2 THEN 'Type Both is ambiguous: it could be any of p.Both, q.Both.' "
    "WHEN 3 THEN 'Type List takes 1 arguments, but 2 are given.' ELSE 'The query expands to more than ' || p_size || ' clauses; please use more specific types.' END AS message FROM p"
)
def query_errors(spark, d):
    """What users are told of queries that cannot be answered."""
    text = "CASE p_partkey % 5 WHEN 0 THEN 'List[' || a WHEN 1 THEN 'x' || a || ' => ' || b WHEN 2 THEN 'Both' WHEN 3 THEN 'List[' || a || ', ' || b || ']' ELSE a || repeat(' => ' || a, 60) END"

    def f(size, text):
        try:
            expansion.expand(to_type(resolve(parse(text).type, _known)), lambda t: (), size)
            return ("none",)
        except QueryError as problem:
            return (problem.message(),)

    return through(_parts(spark, d).select("p_partkey", "p_size", F.expr(text)), f, "p_partkey long, message string", keys=1)


@query(f"WITH {_P} SELECT 'Type x' || a || ' not found.' AS outcome, count(*) AS n FROM p GROUP BY a")
def error_report(spark, d):
    """Failures by message: each query is read once, and stands for as many as asked it."""

    def f(text):
        try:
            return (str(resolve(parse(text).type, _known)),)
        except QueryError as problem:
            return (problem.message(),)

    asked = _parts(spark, d).groupBy(F.concat(F.lit("x"), "a").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return through(asked.select("n", "text"), f, "n long, outcome string", keys=1).groupBy("outcome").agg(F.sum("n").alias("n"))


@query("WITH x AS (SELECT doc_id, string_split(text, ' ')[1] AS w FROM documents) SELECT doc_id, CASE WHEN regexp_matches(w, '^[\\p{L}_]$') THEN '+<unknown>' ELSE 'Type ' || w || ' not found.' END AS type FROM x WHERE regexp_matches(w, '^[\\p{L}_]+$')")
def wildcard_names(spark, d):
    """Single letters stand for any type; other names must be known."""
    rows = table(spark, d, "documents").select("doc_id", F.split("text", " ")[0].alias("w")).filter(F.col("w").rlike(r"^[\p{L}_]+$"))

    def f(w):
        try:
            return (str(to_type(resolve(parse(w).type, lambda _: []))),)
        except QueryError as problem:
            return (problem.message(),)

    return through(rows, f, "doc_id long, type string", keys=1)


@query(f"WITH {_P} SELECT p_partkey, '+scala.Pair[+' || a || ', -' || b || ']' AS bound FROM p")
def positional_bindings(spark, d):
    """Arguments go to parameters by their place, and take their signs."""
    pair = TypeName("scala.Pair", (Param("A", CO), Param("B", CONTRA)))

    def f(a, b):
        return (str(to_type(resolve(parse(f"Pair[{a}, {b}]").type, lambda n: [pair] if n == "Pair" else [TypeName(n)]))),)

    return through(_parts(spark, d).select("p_partkey", "a", "b"), f, "p_partkey long, bound string", keys=1)


# --- planning ---------------------------------------------------------------------------


def _views() -> expansion.Alternatives:
    x = frozenset({"X"})
    return expansion.views_between(both_ways(read_type("+List[+X]", x), read_type("+Vec[+X]", x)))


@query(
    f"WITH {_P} SELECT p_partkey, 'sum(max(sum(+List^0.5, max(sum(+' || a || '^0.5))), sum(+Vec^0.4, max(sum(+' || a || '^0.5)))))' AS expanded, 'sum(max(sum(max(+List^0.5, +Vec^0.4), max(+' || a || '^0.5))))' AS minimized, "
    "'sum(sum(max(+List^0.5, +Vec^0.4), +' || a || '^0.5))' AS smallest, '+' || a || ' +List +Vec' AS terms FROM p"
)
def expanded_queries(spark, d):
    """A type with the alternatives of its root: as it expands, with what both share taken out, and unwrapped."""

    views = _views()

    def f(a):
        tree = expansion.weigh(expansion.expand(read_type(f"+List[+{a}]"), views), lambda _: 0.0)
        small = expansion.minimize(tree)
        return str(tree), str(small), str(expansion.fixpoint(small)), " ".join(sorted({x.term for x in expansion.leaves(small)}))

    return through(_parts(spark, d).select("p_partkey", "a"), f, "p_partkey long, expanded string, minimized string, smallest string, terms string", keys=1)


@query(f"WITH {_P} SELECT p_partkey, CASE WHEN p_size < 8 THEN 'The query expands to more than ' || p_size || ' clauses; please use more specific types.' ELSE 'expanded' END AS outcome FROM p")
def clause_limit(spark, d):
    """The tree of :func:`expanded_queries` has eight clauses."""

    views = _views()

    def f(a, size):
        try:
            expansion.expand(read_type(f"+List[+{a}]"), views, size)
            return ("expanded",)
        except QueryError as problem:
            return (problem.message(),)

    return through(_parts(spark, d).select("p_partkey", "a", "p_size"), f, "p_partkey long, outcome string", keys=1)


_SHARED = """q AS (SELECT o_custkey AS query_id, 'o' || (o_orderkey % 4) AS own, 'x' || (o_custkey % 3) AS joint, count(*) AS n FROM orders GROUP BY ALL),
    g AS (SELECT query_id, joint, count(*) AS n, string_agg(own, ', ' ORDER BY own) AS owns FROM q GROUP BY query_id, joint)"""


@query(f"WITH {_SHARED} SELECT query_id, CASE WHEN n = 1 THEN '[' || owns || ', ' || joint || ']' ELSE '[{{' || owns || '}}, ' || joint || ']' END AS shape FROM g")
def shared_parts(spark, d):
    """Alternatives that share a part: it is taken out once, and what is left of them stands beside it as alternatives."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("o"), F.col("o_orderkey") % 4).alias("own"), F.concat(F.lit("x"), F.col("o_custkey") % 3).alias("joint")).distinct()
    each = orders.groupBy("query_id", "joint").agg(F.sort_array(F.collect_set("own")).alias("own"))

    def shown(t) -> str:
        if isinstance(t, expansion.Leaf):
            return t.term
        inner = ", ".join(map(shown, t.parts))
        if len(t.parts) == 1:
            return inner
        return f"[{inner}]" if isinstance(t, expansion.Sum) else "{" + inner + "}"

    def f(k, joint, own):
        tree = expansion.Max(tuple(expansion.Sum((expansion.Leaf(o), expansion.Leaf(joint))) for o in own))
        return k, shown(expansion.minimize(tree))

    return through(each, f, "query_id long, shape string")
