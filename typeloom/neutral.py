"""The language-neutral engine: definitions and views in internal names over any store of keyed documents.

It has no keywords. Invariant terms are written with ``/``. A language is given by patterns for its top, bottom and
function types.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.types import Type, View, read_type
from .functions.variance import CO, CONTRA, INV
from .plans.expansion import Leaf, Max, Sum, Tree, candidate_terms, fixpoint, leaves
from .plans.scoring import Scorer
from .settings import NeutralSettings

FN, TOP, BOTTOM, UNKNOWN, IGNORED = "<fn{}>", "<top{}>", "<bottom{}>", "<unknown{}>", "<ignored{}>"
#: The frequency of a term that no document leads to: the smallest positive number.
RARE = 5e-324


def made(kind: str, v: str, args=()) -> Type:
    args = tuple(args)
    return Type(v, kind.format(len(args) - (kind == FN)), args)


def is_fn(t: Type) -> bool:
    return bool(t.args) and t.name == FN.format(len(t.args) - 1)


@dataclass(frozen=True)
class Bound:
    """A type parameter with optional bounds."""

    name: str
    lower: Type | None = None
    upper: Type | None = None


@dataclass(frozen=True)
class Definition:
    """A value, or a type with its supertypes."""

    name: str
    type: Type
    params: tuple[Bound, ...] = ()
    supertypes: tuple[Type, ...] = ()
    is_type: bool = False
    implicit: bool = False
    source: str = ""


def internal(t: Type, s: NeutralSettings) -> Type:
    """A language's names for top, bottom and functions as internal ones, from the root down."""
    for pattern, kind in ((s.top, TOP), (s.bottom, BOTTOM)):
        if re.fullmatch(pattern, t.name):
            t = made(kind, t.variance, t.args)
            break
    if t.args and re.fullmatch(s.function, t.name):
        t = made(FN, t.variance, t.args)
    return replace(t, args=tuple(internal(a, s) for a in t.args))


def bounded(t: Type, params: Iterable[Bound]) -> Type:
    """Parameters as what is known of them in their place."""
    by = {p.name: p for p in params}

    def go(x: Type) -> Type:
        p = by.get(x.name)
        if p is None:
            return replace(x, args=tuple(map(go, x.args)))
        if x.variance == CO:
            return p.lower or made(BOTTOM, CO, x.args)
        if x.variance == CONTRA:
            return p.upper or made(TOP, CONTRA, x.args)
        return made(UNKNOWN, INV, x.args)

    return go(t)


def clean(t: Type) -> Type:
    """Curried inside, and with the outermost functions joined into one."""

    def curry(x: Type) -> Type:
        if is_fn(x) and len(x.args) > 2:
            head, *rest, out = x.args
            return made(FN, x.variance, (head, curry(made(FN, x.variance, (*rest, out)))))
        return replace(x, args=tuple(map(curry, x.args)))

    parts, out = [], curry(t)
    v = out.variance
    while is_fn(out) and out.variance == CO:
        parts += out.args[:-1]
        out = out.args[-1]
    return made(FN, v, (*parts, out)) if parts else out


def key(t: Type) -> str:
    return (t.variance or "/") + t.name


def fingerprint(t: Type) -> list[str]:
    """Terms of all nodes but ignored ones, in preorder."""
    own = [] if t.name == IGNORED.format(len(t.args)) else [key(t)]
    return own + [x for a in t.args for x in fingerprint(a)]


def open_function(t: Type) -> Type:
    return made(IGNORED, t.variance, t.args) if is_fn(t) else t


def value_keys(d: Definition) -> list[str]:
    return fingerprint(open_function(clean(bounded(d.type, d.params))))


def elementary(t: Type) -> list[Type]:
    """What any type can be seen as in its position."""
    extreme = {CO: BOTTOM, CONTRA: TOP}.get(t.variance)
    if extreme is None:
        out = [t, made(UNKNOWN, INV), made(UNKNOWN, INV, t.args)]
    else:
        out = [t, made(extreme, t.variance), made(UNKNOWN, INV), t.position(INV), made(extreme, t.variance, t.args)]
    return list(dict.fromkeys(out))


def positions(t: Type) -> list[Type]:
    t = clean(t)
    return [t.position(v) for v in (CO, CONTRA, INV)]


def definition_views(d: Definition) -> list[View]:
    """Views between a type and its supertypes, or by an implicit conversion."""
    names = {p.name for p in d.params}

    def mark(t: Type) -> Type:
        return t.transform(lambda x: replace(x, param=x.name in names))

    if d.is_type:
        sub = clean(mark(d.type))
        supers = [clean(mark(s)) for s in d.supertypes]
        return [v for s in supers if s != made(TOP, CO) for v in (View(s, sub, d.name), View(sub.position(CONTRA), s.position(CONTRA), d.name))]
    t = clean(mark(d.type))
    if d.implicit and is_fn(t) and len(t.args) == 2 and t.args[1] != made(TOP, CO):
        arg, out = t.args
        return [View(out, arg.position(CO), d.name), View(arg, out.position(CONTRA), d.name)]
    return []


def elementary_views(d: Definition) -> list[View]:
    names = {p.name for p in d.params}
    marked = d.type.transform(lambda x: replace(x, param=x.name in names))
    return [View(p, e, d.name) for p in positions(marked) for e in elementary(p)]


def itf(frequency: float, base: float = 2.0) -> float:
    return math.log(base / (frequency * base + 1.1 * (1 - frequency))) / math.log(base)


def expand(t: Type, params: Iterable[Bound], views: list[View]) -> Tree:
    """All the ways in which documents can match; identity comes from the elementary views alone."""
    params = list(params)
    by: dict[str, list[View]] = {}
    for v in views:
        by.setdefault(key(v.source) if not v.source.param else "_", []).append(v)

    def seen_as(x: Type):
        out = {}
        for v in by.get(key(x), []) + by.get("_", []) + [View(x, e) for e in elementary(x)]:
            y = v(x)
            if y is not None:
                out.setdefault((bounded(y, params), v.distance, v.retained))
        return list(out)

    def parts(x: Type, outer: frozenset, share: float, distance: int) -> Tree:
        if x.name == IGNORED.format(len(x.args)):
            return Sum(tuple(either(a, outer, share / len(x.args)) for a in x.args))
        each = share / (1 + len(x.args))
        below = tuple(Leaf(key(a), each, 1) if a in outer else either(a, outer, each) for a in x.args)
        return Sum((Leaf(key(x), each, distance), *below))

    def either(x: Type, outer: frozenset, share: float) -> Tree:
        found = seen_as(x)
        outer = outer | {y for y, _, _ in found}
        return Max(tuple(parts(y, outer, share * kept, d) for y, d, kept in found))

    t = open_function(clean(bounded(t, params)))
    t = t if t.name == IGNORED.format(len(t.args)) else made(IGNORED, CO, [t])
    return fixpoint(parts(t, frozenset(), 1.0, 0))


def weigh(tree: Tree, frequency, s: NeutralSettings) -> Tree:
    if isinstance(tree, Leaf):
        f = frequency(tree.term)
        boost = tree.fraction * itf(f, s.frequency_weight) * (1 - 0.1 * tree.distance) ** s.distance_weight
        return replace(tree, boost=boost, frequency=f)
    return type(tree)(tuple(weigh(p, frequency, s) for p in tree.parts))


class DocumentStore:
    """Documents ``(name, keys, source)`` in a table, found by their keys."""

    def __init__(self, docs: DataFrame):
        self.docs = docs

    @classmethod
    def of(cls, spark: SparkSession, definitions: Iterable[Definition]) -> DocumentStore:
        rows = [(d.name, value_keys(d), d.source) for d in definitions if not d.is_type]
        return cls(spark.createDataFrame(rows, "name string, keys array<string>, source string"))

    def by_keys(self, keys: list[str]) -> DataFrame:
        """Documents with all the keys."""
        return self.docs.filter(F.forall(F.lit(list(keys)), lambda k: F.array_contains("keys", k)))

    @classmethod
    def read(cls, rows: DataFrame, settings: NeutralSettings) -> DocumentStore:
        """Documents of ``rows(name, type, source)`` with types as text, read where the rows are."""
        import pandas as pd

        def run(frames):
            for frame in frames:
                keys = [value_keys(Definition(n, internal(read_type(t), settings))) for n, t in zip(frame["name"], frame["type"], strict=True)]
                yield pd.DataFrame({"name": frame["name"], "keys": keys, "source": frame["source"]})

        return cls(rows.select("name", "type", "source").mapInPandas(run, "name string, keys array<string>, source string"))

    def postings(self) -> DataFrame:
        """``(key, name, source)``: each document under each of its keys."""
        return self.docs.select(F.explode(F.array_distinct("keys")).alias("key"), "name", "source")

    def by_any(self, keys: list[str]) -> DataFrame:
        """Documents with any of the keys, once each."""
        found = self.postings().filter(F.col("key").isin(list(keys))).select("name", "source").distinct()
        return self.docs.join(found, ["name", "source"], "left_semi") if keys else self.docs.limit(0)

    def count(self, keys: list[str]) -> int:
        return self.by_keys(keys).count()


def view_keys(rows: DataFrame, settings: NeutralSettings) -> DataFrame:
    """``(keys array<string>, terms array<string>)`` of all views of the types in ``rows(type, supertypes)``, read where the rows are.

    A view's keys are the terms of its source, its terms those of its target. Types and supertypes are texts; a null type
    has no views, null supertypes count as none.
    """
    import pandas as pd

    def run(frames):
        for frame in frames:
            found = []
            for t, supers in zip(frame["type"], frame["supertypes"], strict=True):
                if t is not None:
                    d = Definition("", internal(read_type(t), settings), (), tuple(internal(read_type(x), settings) for x in (supers if supers is not None else ())), True)
                    found += [*elementary_views(d), *definition_views(d)]
            yield pd.DataFrame({"keys": [sorted(set(fingerprint(v.source))) for v in found], "terms": [fingerprint(v.target) for v in found]}, dtype=object)

    return rows.select("type", "supertypes").mapInPandas(run, "keys array<string>, terms array<string>")


def term_frequencies(store: DocumentStore, views: DataFrame) -> DataFrame:
    """``(term, tf)``: the documents that the sources of a term's ``views(keys, terms)`` lead to, summed over views.

    Each source counts once the documents that hold all its keys, however many views it has; a source without keys leads to none. Only
    the sources' keys of the documents take part, and nothing is collected.
    """
    sources = views.select(F.array_sort(F.array_distinct("keys")).alias("keys"), "terms").withColumn("source", F.xxhash64(F.to_json("keys")))
    per_term = sources.select("source", F.explode("terms").alias("term")).groupBy("source", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = sources.select("source", F.size("keys").alias("need"), F.explode("keys").alias("key")).distinct()
    docs = store.docs.select(F.xxhash64("name", "source", F.to_json("keys")).alias("doc"), F.explode(F.array_distinct("keys")).alias("key"))
    hits = docs.join(asked, "key").groupBy("source", "doc").agg(F.count(F.lit(1)).alias("has"), F.first("need").alias("need")).filter("has = need")
    counts = hits.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return per_term.join(counts, "source").groupBy("term").agg(F.sum(F.col("n") * F.col("times")).alias("tf"))


def type_frequencies(store: DocumentStore, types: Iterable[Definition], views: Iterable[View]) -> DataFrame:
    """As :func:`term_frequencies`, for the elementary views of listed types and for listed views."""
    rows = [(sorted(set(fingerprint(v.source))), fingerprint(v.target)) for v in [*(e for t in types for e in elementary_views(t)), *views]]
    return term_frequencies(store, store.docs.sparkSession.createDataFrame(rows, "keys array<string>, terms array<string>"))


class NeutralEngine:
    """Batches of definitions, then searches."""

    def __init__(self, spark: SparkSession, settings: NeutralSettings = NeutralSettings()):
        self.spark, self.settings = spark, settings
        self.definitions: list[Definition] = []
        self.values: list[DocumentStore] = []

    def index(self, definitions: Iterable[Definition]) -> None:
        s = self.settings
        for d in definitions:
            self.definitions.append(replace(d, type=internal(d.type, s), supertypes=tuple(internal(x, s) for x in d.supertypes)))

    def index_values(self, rows: DataFrame) -> None:
        """Values of a table ``(name, type, source)``, which stay there; types and conversions come by :meth:`index`."""
        self.values.append(DocumentStore.read(rows, self.settings))

    def finalize(self) -> None:
        self.store = DocumentStore.of(self.spark, self.definitions)
        for more in self.values:
            self.store.docs = self.store.docs.unionByName(more.docs)
        self.store.docs = self.store.docs.persist()
        self.views = list(dict.fromkeys(v for d in self.definitions for v in definition_views(d)))
        self.counts = type_frequencies(self.store, [d for d in self.definitions if d.is_type], self.views).persist()

    def frequencies(self, terms: Iterable[str]) -> dict[str, float]:
        """Relative frequencies of the terms of a query, by one filtered read."""
        bottom = "+" + BOTTOM.format(0)
        found = {r["term"]: r["tf"] for r in self.counts.filter(F.col("term").isin(sorted({*terms, bottom}))).collect()}
        most = found.get(bottom, 0)
        return {t: found[t] / most if most and t in found else RARE for t in terms}

    def frequency(self, term: str) -> float:
        return self.frequencies([term])[term]

    def search(self, t: Type, params: Iterable[Bound] = (), more: DataFrame | None = None) -> DataFrame:
        """Documents by score, best first, with their penalties; ``more`` candidates are scored as well."""
        s = self.settings
        tree = expand(internal(t, s), params, self.views)
        tree = weigh(tree, self.frequencies({leaf.term for leaf in leaves(tree)}).__getitem__, s)
        found = self.store.by_any(candidate_terms(tree, s.cutoff))
        if more is not None:
            found = found.unionByName(more).dropDuplicates(["name", "source"])

        def run(frames):
            scorer = Scorer(tree)
            for frame in frames:
                got = [scorer.score([(k, False) for k in sorted(keys)]) for keys in frame["keys"]]
                yield frame[["name", "source"]].assign(score=[g[0] for g in got], penalty=[g[1] for g in got])

        return found.mapInPandas(run, "name string, source string, score float, penalty float").orderBy(F.desc("score"), "name")
