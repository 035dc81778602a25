"""The engine: named indexes that are built in batches, finalized, and searched.

An index is built in a folder of its own and becomes visible when a new version is complete, so a reader
never meets half an index, and searches go on while an index is built again.

A version names its folders. Tables with rows for each value stand in segments: new batches become a segment of
their own, and those before stay as they are. What is deleted is a condition on the rows of the segments there are,
which readers put to their scans. The small tables of types are derived from all batches. Segments are
made one again (:meth:`Engine.compact`) by itself when there are many, or much in them is deleted.
"""

from __future__ import annotations

import functools
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.types import UNKNOWN, Param, Type, View, normalize
from .functions.variance import INV
from .operators import index as ix
from .operators.search import ranked
from .operators.sets import group_results, only_modules, upsert
from .plans import expansion
from .plans.errors import NameNotFound, QueryError, TooUnspecific
from .plans.language import Raw, RawQuery, parse
from .plans.resolve import TypeName, names, resolve, standard_by_name, to_type
from .settings import IndexSettings, QuerySettings
from .sources.definitions import DEFINITION, params_of
from .sources.files import Folder, parts

EMPTY, BUSY, READY = "empty", "busy", "ready"
#: At most so many views are held on the driver; beyond, those of a query are looked up by key.
DRIVER_VIEWS = 100_000
DEFAULT_MODULES = ("scala-library", "scalaz")


BASE = ("values", "type_defs", "views", "modules", "errors")
#: Tables with rows for each value, in segments.
OF_VALUES = ("values", "postings", "name_postings", "doc_terms")
#: What makes a row of a table of types the same as one of an earlier batch.
SAME = {"type_defs": ["module_id", "name"], "views": ["module_id", "name", "source", "target"], "modules": ["module_id"]}
#: With more segments, or more deleted rows than live ones, segments are made one again.
MAX_SEGMENTS = 8


def without(rows: DataFrame, gone: list[list]) -> DataFrame:
    """Rows but those that ``gone``, ``[column, value]`` or ``[column, value, time]``, deletes; all of a table without the column.

    With a time, only rows of batches until then are deleted. A missing value is never deleted.
    """
    for column in sorted({g[0] for g in gone} & set(rows.columns)):
        own = [g for g in gone if g[0] == column]
        always = sorted({g[1] for g in own if len(g) == 2})
        if always:
            rows = rows.filter(F.col(column).isNull() | ~F.col(column).isin(always))
        for _, value, until in (g for g in own if len(g) == 3):
            rows = rows.filter(F.col(column).isNull() | (F.col(column) != value) | (F.col("batch") > until))
    return rows


def _type(nodes) -> Type:
    return Type.decode(nodes)


class Engine:
    def __init__(self, spark: SparkSession, path: str, index: IndexSettings = IndexSettings(), query: QuerySettings = QuerySettings()):
        self.spark, self.folder = spark, Folder(spark, path)
        self.index_settings, self.query_settings = index, query
        self._cache: dict = {}

    # --- building ------------------------------------------------------------------------

    def index(self, name: str, definitions: DataFrame) -> None:
        """Add a batch of definitions to the index that is being built under ``name``."""
        self.folder.write_json(f"{name}.state", {"state": BUSY})
        batch = f"{name}/batch-{uuid.uuid4().hex}"
        self.folder.write(batch, definitions.select(*DEFINITION.fieldNames()))  # read or made once for all tables
        for kind, rows in ix.split_kinds(self.folder.table(batch)).items():
            self.folder.write(f"{self._building(name)}/{kind}", rows.withColumn("batch", F.lit(time.time())), "append")
        self.folder.delete(batch)

    def _building(self, name: str) -> str:
        """The folder of all batches of an index."""
        return self.folder.read_json(f"{name}.building", {"at": f"{name}/building"})["at"]

    def _batches(self, name: str) -> dict[str, DataFrame]:
        """All batches of an index, without what was deleted after they came."""
        where, gone = self._building(name), self.folder.read_json(f"{name}.building", {}).get("gone", [])
        if not self.folder.has(f"{where}/values"):
            raise ValueError(f"nothing was indexed under {name!r}")
        return {k: without(self.folder.table(f"{where}/{k}"), gone) for k in BASE}

    def finalize(self, name: str) -> int:
        """Make what was indexed searchable: a segment of the batches that came since the last version, and the tables of types anew.

        Batches of an index come one after the other, none while it is finalized.
        """
        built, version = self._batches(name), self._version(name)
        if version is None or version["settings"] != self.index_settings.fingerprint() or self._wants_compaction(version):
            self._publish_whole(name, built)
        else:
            self._publish_delta(name, built, version)
        self.folder.write_json("active", {"index": name})
        errors = built["errors"].count()
        self.folder.write_json(f"{name}.state", {"state": READY, "errors": errors})
        return errors

    def rebuild(self, name: str, others: list[str] | tuple[str, ...] = ()) -> bool:
        """Derive an index again if it was built with other settings, with the definitions of ``others`` added; whether it was."""
        if not others and not self.needs_rebuild(name):
            return False
        built = self._batches(name)
        for other in others:
            built = {k: rows.unionByName(self._batches(other)[k], allowMissingColumns=True) for k, rows in built.items()}
        self._replace_base(name, built)
        self._publish_whole(name, self._batches(name))
        return True

    def compact(self, name: str | None = None) -> None:
        """Batches and segments of an index as one, without what was deleted."""
        name = name or self.active()
        self._replace_base(name, self._batches(name))
        self._publish_whole(name, self._batches(name))

    @staticmethod
    def _wants_compaction(version: dict) -> bool:
        return len(version["segments"]) >= MAX_SEGMENTS or version["written"] > 2 * max(version["values"], 1)

    def _version(self, name: str) -> dict | None:
        return self.folder.read_json(f"{name}.version")

    def _next(self, name: str) -> int:
        """The number of the next version; what a failed attempt at it wrote is written over."""
        return (self._version(name) or {"version": 0})["version"] + 1

    def _publish_whole(self, name: str, built: dict[str, DataFrame]) -> None:
        """A version of one segment."""
        segment = {"at": f"{name}/s{self._next(name):06d}", "gone": []}
        self._derive_values(segment["at"], built["values"])
        self._publish(name, built, [segment])

    def _publish_delta(self, name: str, built: dict[str, DataFrame], version: dict) -> None:
        """A version with a segment more: values of later batches that are not there yet."""
        late = built["values"].filter(F.col("batch") > version["until"])
        segments = version["segments"]
        if late.limit(1).count():
            segment = {"at": f"{name}/s{self._next(name):06d}", "gone": []}
            self._derive_values(segment["at"], late, there=self._segments("values", segments).select("value_id"))
            segments = [*segments, segment]
        self._publish(name, built, segments)

    def _publish(self, name: str, built: dict[str, DataFrame], segments: list[dict]) -> None:
        """A new version; folders of the one before stay for searches that were planned on it, older ones go."""
        old = self._version(name) or {"version": 0, "segments": [], "types": {"at": None}, "before": []}
        values = self._segments("values", segments)
        types = {"at": f"{name}/t{self._next(name):06d}", "gone": []}
        self._derive_types(types["at"], built, values)
        written = sum(self.folder.table(f"{s['at']}/values").count() for s in segments)
        until = built["values"].agg(F.max("batch")).first()[0] or 0.0
        folders = lambda v: {s["at"] for s in [*v["segments"], v["types"]] if s["at"]}
        new = {"version": self._next(name), "settings": self.index_settings.fingerprint(), "values": values.count(), "written": written, "until": until, "segments": segments, "types": types}
        new["before"] = sorted(folders(old) - folders(new))
        self.folder.write_json(f"{name}.version", new)
        for at in set(old["before"]) - folders(new):
            self.folder.delete(at)
        self._cache.clear()

    def _replace_base(self, name: str, tables: dict[str, DataFrame]) -> None:
        """Write all batches anew beside the old ones, then switch to them."""
        old, new = self._building(name), f"{name}/building-{uuid.uuid4().hex}"
        for kind, rows in tables.items():
            self.folder.write(f"{new}/{kind}", rows)
        self.folder.write_json(f"{name}.building", {"at": new})
        self.folder.delete(old)

    def _derive_values(self, at: str, values: DataFrame, there: DataFrame | None = None) -> None:
        """A segment of values, each once, but those whose ids are ``there``. Values of a module lie together; module and artifact stand in all tables, so that they can be deleted by them."""
        put, get = self.folder.write, self.folder.table
        values = values.drop("batch", "value_id", "terms", "signature", "group_key").dropDuplicates()
        # Ids follow the content, so that ties in scores come out the same in every build.
        values = values.withColumn("value_id", F.xxhash64(F.to_json(F.struct(*sorted(values.columns)))))
        values = values if there is None else values.join(there, "value_id", "left_anti")
        values = values.repartitionByRange(parts(self.spark), "module_id", "value_id").sortWithinPartitions("module_id", "value_id")
        put(f"{at}/values", ix.with_fingerprints(values, self.index_settings.polarized))
        values = get(f"{at}/values")
        put(f"{at}/postings", ix.postings(values).repartitionByRange("term").sortWithinPartitions("term"))
        put(f"{at}/name_postings", ix.name_postings(values).repartitionByRange("token").sortWithinPartitions("token"))
        documents = text.document(F.col("name"), text.indexable(F.col("comment"), F.coalesce("attributes", F.expr("cast(array() as array<struct<key:string,value:string>>)"))))
        put(f"{at}/doc_terms", text.term_counts(values, "value_id", documents, True, keep=("module_id", "artifact")).repartitionByRange("token").sortWithinPartitions("token"))

    def _derive_types(self, at: str, tables: dict[str, DataFrame], values: DataFrame) -> None:
        """The tables of types, with frequencies in all ``values``."""
        put, get, s = self.folder.write, self.folder.table, self.index_settings
        put(f"{at}/views", ix.with_view_keys(ix.wanted_views(_last(tables["views"], SAME["views"]))))
        put(f"{at}/modules", _last(tables["modules"], SAME["modules"]))
        types = _last(tables["type_defs"], SAME["type_defs"]).drop("f_co", "f_contra", "f_inv")
        views = get(f"{at}/views")
        few = not s.views or views.limit(DRIVER_VIEWS + 1).count() <= DRIVER_VIEWS
        views = (self._driver_views(views) if s.views else []) if few else views
        frequencies = ix.type_frequencies(values, views, s.statistics_steps, s.sample_size)
        put(f"{at}/frequencies", frequencies)
        put(f"{at}/type_defs", ix.pivoted(types, get(f"{at}/frequencies")))
        put(f"{at}/suffixes", ix.name_suffixes(types))
        put(f"{at}/errors", tables["errors"])

    @staticmethod
    def _driver_views(views: DataFrame) -> list[View]:
        return [View(_type(r["source"]), _type(r["target"]), r["name"], r["module_id"]) for r in views.collect()]

    # --- catalogue -----------------------------------------------------------------------

    def active(self) -> str | None:
        return self.folder.read_json("active", {}).get("index")

    def table(self, kind: str, name: str | None = None) -> DataFrame:
        """A table of the current version of an index (the active one by default)."""
        name = name or self.active()
        version = self._version(name) if name else None
        if not version:
            raise ValueError("no active index")
        return self._segments(kind, version["segments"] if kind in OF_VALUES else [version["types"]])

    def _segments(self, kind: str, segments: list[dict]) -> DataFrame:
        """A table of all segments, each without what was deleted since it was written."""
        parts = [without(self.folder.table(f"{s['at']}/{kind}"), s["gone"]) for s in segments]
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def status(self, name: str | None = None) -> dict:
        name = name or self.active()
        state = self.folder.read_json(f"{name}.state", {"state": EMPTY}) if name else {"state": EMPTY}
        if state["state"] == READY:
            state["modules"] = [r["module_id"] for r in self.indexed_modules(name).collect()]
        return state

    def indexed_modules(self, name: str | None = None) -> DataFrame:
        return self.table("modules", name).orderBy("module_id")

    def default_modules(self) -> list[str]:
        wanted = F.lit(False)
        for m in DEFAULT_MODULES:
            wanted = wanted | F.col("module_id").contains(m)
        return [r["module_id"] for r in self.indexed_modules().filter(wanted).collect()]

    def needs_rebuild(self, name: str) -> bool:
        """Whether the index was built with other settings."""
        return (self._version(name) or {}).get("settings") != self.index_settings.fingerprint()

    def reset(self) -> None:
        for n in self.folder.names():
            self.folder.delete(n)
        self._cache.clear()

    def delete_module(self, module: str, name: str | None = None) -> None:
        """Delete what a module defines. Frequencies of types stay until the index is finalized."""
        self._delete("module_id", module, name)

    def delete_artifact(self, path: str, name: str | None = None) -> None:
        """Delete the values of a source file."""
        self._delete("artifact", path, name)

    def _delete(self, column: str, value: str, name: str | None) -> None:
        """Two small files are written, and no table: one condition for the batches so far, one for each segment."""
        name = name or self.active()
        version = self._version(name) if name else None
        if not version:
            raise ValueError("no active index")
        base = self.folder.read_json(f"{name}.building", {"at": self._building(name)})
        self.folder.write_json(f"{name}.building", base | {"gone": [*base.get("gone", []), [column, value, time.time()]]})
        for part in [*version["segments"], version["types"]]:
            part["gone"].append([column, value])
        live = self._segments("values", version["segments"]).count()
        self.folder.write_json(f"{name}.version", version | {"values": live})
        self._cache.clear()

    def add(self, kind: str, rows: DataFrame, keys: list[str], name: str | None = None) -> None:
        """Replace or add rows of one base table. Tables of types by their own keys take a batch more, as the last one counts; others are written anew."""
        name = name or self.active()
        rows = rows.withColumn("batch", F.lit(time.time()))
        if sorted(keys) == sorted(SAME.get(kind, [])):
            old = self.folder.table(f"{self._building(name)}/{kind}")
            whole = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in old.dtypes])
            self.folder.write(f"{self._building(name)}/{kind}", whole, "append")
            self._publish(name, self._batches(name), self._version(name)["segments"])
            return
        built = self._batches(name)
        self._replace_base(name, built | {kind: upsert(built[kind], rows, keys)})
        self._publish_whole(name, self._batches(name))

    # --- planning ------------------------------------------------------------------------

    def _suffix_lookup(self, raw: Raw, modules) -> dict[str, list[TypeName]]:
        """All names of a query in one job."""
        wanted = sorted(names(raw))
        found: dict[str, list[TypeName]] = {n: [] for n in wanted}
        for n in wanted:
            if n in standard_by_name():
                found[n].append(standard_by_name()[n])
        rows = only_modules(self.table("suffixes"), [*modules, "builtin"] if modules else None).filter(F.col("suffix").isin(wanted))
        for r in rows.select("suffix", "name", "params").dropDuplicates(["suffix", "name"]).orderBy("name").collect():
            if all(t.name != r["name"] for t in found[r["suffix"]]):
                found[r["suffix"]].append(TypeName(r["name"], tuple(params_of(r["params"]))))
        return found

    def type_named(self, name: str, modules: list[str] | None = None) -> DataFrame:
        """The type definition of exactly that name, at most one."""
        return only_modules(self.table("type_defs"), modules).filter(F.col("name") == name).orderBy("module_id").limit(1)

    def _alternatives(self, t: Type, modules) -> expansion.Alternatives:
        """Views that the expansion of ``t`` can meet: all if they are few, else by keys, a job a round."""
        if not self.query_settings.views:
            return lambda x: ()
        key = ("views", tuple(modules or ()))
        views = only_modules(self.table("views"), [*modules, "builtin"] if modules else None)
        if key not in self._cache:
            few = views.limit(DRIVER_VIEWS + 1).count() <= DRIVER_VIEWS
            self._cache[key] = expansion.views_between(self._driver_views(views)) if few else None
        if self._cache[key]:
            return self._cache[key]
        known: list[View] = []
        asked: set[str] = set()
        while True:
            find = expansion.views_between(known)
            types = set(t.nodes())
            for _ in range(3):
                types |= {n for x in list(types) for y, _ in find(x) for n in y.nodes()}
            keys = {x.key() for x in types} | {f"{x.variance}_" for x in types}
            if keys <= asked:
                return find
            known += self._driver_views(views.filter(F.col("from_key").isin(sorted(keys - asked))))
            asked |= keys

    def _frequency(self, terms: set[str]):
        rows = self.table("frequencies").filter(F.concat("variance", "name").isin(sorted(terms))).collect()
        found = {r["variance"] + r["name"]: r["frequency"] for r in rows}
        return lambda term: found.get(term, 0.0)

    def plan_type(self, t: Type, modules: list[str] | None = None) -> expansion.Tree:
        """The weighted tree of a type."""
        s = self.query_settings
        t = normalize(t)
        if not self.index_settings.polarized:
            t = t.at(INV)
        tree = expansion.minimize(expansion.expand(t, self._alternatives(t, modules), s.max_clauses, s.fractions))
        frequency = self._frequency({leaf.term for leaf in expansion.leaves(tree)})
        return expansion.weigh(tree, frequency, s.frequency_weight, s.distance_weight)

    def plan(self, query: str, modules: list[str] | None = None) -> tuple[str, expansion.Tree | None]:
        """Keywords and weighted tree of a query. A bare name that is no type is a keyword."""
        raw = parse(query)
        if raw.type is None:
            return raw.keywords, None
        try:
            found = self._suffix_lookup(raw.type, modules)
            return raw.keywords, self.plan_type(to_type(resolve(raw.type, found.__getitem__)), modules)
        except NameNotFound:
            if raw == RawQuery("", Raw(raw.type.name)):
                return raw.type.name, None
            raise

    def plan_value(self, tpe: Type, params: list[Param], modules: list[str] | None = None) -> expansion.Tree:
        """A query for values like this one."""
        free = {p.name for p in params}
        known = tpe.transform(lambda x: Type(x.variance, UNKNOWN) if x.name in free and not x.args and x.variance == INV else x)
        return self.plan_type(_bound(known, params), modules)

    # --- searching -----------------------------------------------------------------------

    def search(self, query: str, modules: list[str] | None = None, n: int = 10, offset: int = 0) -> DataFrame:
        """The values that match best: definition columns, score, and on demand an explanation."""
        keywords, tree = self.plan(query, modules)
        return self._run(keywords, tree, modules, n, offset)

    def like(self, tpe: Type, params: list[Param] = (), modules: list[str] | None = None, n: int = 10) -> DataFrame:
        return self._run("", self.plan_value(tpe, list(params), modules), modules, n, 0)

    def _run(self, keywords: str, tree, modules, n: int, offset: int) -> DataFrame:
        values, hits = self.table("values"), None
        if keywords:
            words = self.spark.createDataFrame([(keywords,)], "k string").select(text.tokens(F.col("k"), True)).first()[0]
            if not words and tree is None:
                raise TooUnspecific(keywords)
            counts = self.table("doc_terms")
            hits = text.keyword_scores(counts, words, self._version(self.active())["values"])
        return ranked(values, self.table("postings"), tree, hits, modules, self.query_settings, n, offset)

    def search_grouped(self, query: str, modules: list[str] | None = None, n: int = 100) -> DataFrame:
        """Results by short name and shape of their types, best group first."""
        found = self.search(query, modules, n).select("group_key", "value_id", "score", "signature")
        return group_results(found, ["group_key"])

    def find_by_name(self, name: str, modules: list[str] | None = None) -> DataFrame:
        """Values whose name has all the tokens of ``name`` (all values, if it has none); the token filter reaches the scan of the sorted postings."""
        words = self.spark.createDataFrame([(name,)], "k string").select(F.array_distinct(text.tokens(F.col("k")))).first()[0]
        values = only_modules(self.table("values"), modules)
        if not words:
            return values
        found = ix.with_all_tokens(only_modules(self.table("name_postings"), modules), words)
        return values.join(found, "value_id", "left_semi")

    # --- service -------------------------------------------------------------------------

    def call(self, request: dict) -> dict:
        """One request of the user or control interface, as plain values: ``{"method": name, ...arguments}``."""
        arguments = {k: v for k, v in request.items() if k != "method"}
        try:
            match request.get("method"):
                case "search":
                    rows = self.search(**arguments).select("name", "signature", "module_id", "score").collect()
                    return {"results": [r.asDict() for r in rows]}
                case "status":
                    return self.status(**arguments)
                case "modules":
                    return {"modules": [r["module_id"] for r in self.indexed_modules(**arguments).collect()]}
                case "assess":
                    self.assess_positively(**arguments)
                    return {}
                case other:
                    return {"error": f"unknown method {other!r}"}
        except QueryError as problem:
            return {"error": problem.message()}

    # --- feedback ------------------------------------------------------------------------

    def log(self, outcome: str, query: str, modules: list[str] | None = None, page: int = 0, detail: str = "") -> None:
        """Append to the interactions: failed, succeeded, or assessed."""
        self.log_rows(self.spark.createDataFrame([(outcome, query, list(modules or ()), page, detail)], "outcome string, query string, modules array<string>, page int, detail string"))

    def log_rows(self, rows: DataFrame) -> None:
        """Append many interactions, such as a micro-batch of them. Columns that are missing are null, but for the time, which is now then."""
        kinds = {"outcome": "string", "query": "string", "modules": "array<string>", "page": "int", "detail": "string", "ts": "timestamp"}
        rows = rows if "ts" in rows.columns else rows.withColumn("ts", F.current_timestamp())
        self.folder.write("interactions", rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]), "append")

    def assess_positively(self, query: str, modules: list[str] | None, signature: str) -> None:
        self.log("assessed", query, modules, detail=signature)

    def assess_rows(self, rows: DataFrame) -> None:
        """Assessments ``(query, modules, signature)`` of many results at once."""
        self.log_rows(rows.withColumn("outcome", F.lit("assessed")).withColumnRenamed("signature", "detail"))

    def interactions(self) -> DataFrame:
        return self.folder.table("interactions")


def _bound(t: Type, params: list[Param]) -> Type:
    """Parameters in a value's own type replaced by their bounds, so that it can be asked for."""
    by = {p.name: p for p in params}
    args = tuple(_bound(a, params) for a in t.args)
    return by[t.name].bound(t.variance, args) if t.name in by else Type(t.variance, t.name, args, t.param)


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the last batch for each key."""
    text_keys = [F.to_json(k) if dict(rows.dtypes)[k].startswith("array") else F.col(k) for k in keys]
    rest = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(text_keys)]).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("r.*")
