"""Queries of the engine as a whole, its sources and the language-neutral engine, and their SQL.

The corpus: regions are types, nations types below them, and suppliers functions from their nation to its region,
in a module for each region. An index of it is built once for a session and folder of tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import neutral
from .engine import Engine
from .functions import pages
from .functions.types import Type, read_type, show_terms
from .functions.variance import CO
from .operators import index as ix
from .operators.search import EVERY
from .registry import corpus_terms, query, table
from .registry_types import through
from .settings import IndexSettings, NeutralSettings, QuerySettings
from .sources import definitions as sd
from .sources.declarations import read_sources
from .sources.files import append_csv, kept, working_folder
from .sources.symbols import read_project, signatures

_GEO = """geo AS (
    SELECT s_name, n_name AS n, replace(r_name, ' ', '_') AS r, 'shop.' || s_name AS name, 'shop:' || CASE r_name WHEN 'ASIA' THEN 'scalaz' ELSE lower(replace(r_name, ' ', '_')) END || ':1' AS module_id
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    lands AS (SELECT n_name AS n, replace(r_name, ' ', '_') AS r FROM nation JOIN region ON n_regionkey = r_regionkey),
    total AS (SELECT count(*) AS total FROM geo)"""
WORLD = "geo:world:1"


def _lands(spark, d) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("n"), F.replace("r_name", F.lit(" "), F.lit("_")).alias("r"))


def _suppliers(spark, d) -> DataFrame:
    s, lands = table(spark, d, "supplier"), _lands(spark, d)
    module = F.concat(F.lit("shop:"), F.when(F.col("r") == "ASIA", "scalaz").otherwise(F.lower("r")), F.lit(":1"))
    return s.join(lands, s.s_nationkey == lands.n_nationkey).select("s_name", "n", "r", module.alias("m"))


def corpus_lines(spark, d, regions: bool | None = None) -> DataFrame:
    """``(value, m)``: signature lines with their modules, and one for each region that cannot be read."""
    lands, s = _lands(spark, d), _suppliers(spark, d)
    world = F.lit(WORLD)
    lines = lands.select(F.concat(F.lit("type geo."), "n", F.lit(" <: geo."), "r").alias("value"), world.alias("m"))
    lines = lines.union(lands.select(F.concat(F.lit("type geo."), "r"), world).distinct()).union(lands.select(F.concat(F.lit("broken [: "), "r"), world).distinct())
    return lines.union(s.select(F.concat(F.lit("shop."), "s_name", F.lit(": scala.Function1[geo."), "n", F.lit(", geo."), "r", F.lit("]")), "m"))


def corpus(spark, d) -> DataFrame:
    """Definitions; a value's artifact is its first type."""
    found = sd.read_lines(corpus_lines(spark, d), module="m")
    return found.withColumn("artifact", F.when(F.col("kind") == "value", F.col("tpe")[1]["name"]))


_BUILT: dict[tuple[str, str], Engine] = {}


def engine(spark: SparkSession, d: str) -> Engine:
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        made = Engine(spark, working_folder(spark), IndexSettings(sample_size=0))
        made.index("geo", corpus(spark, d))
        made.finalize("geo")
        _BUILT[key] = made
    return _BUILT[key]


# --- tables of an index -----------------------------------------------------------------

_VALUES = f"WITH {_GEO} SELECT name, module_id, name || ': scala.Function1[geo.' || n || ', geo.' || r || ']' AS signature, '!+geo.' || r || ' !-geo.' || n AS fingerprint, split_part(s_name, '#', 2) || ' +scala.Function1[_, _]' AS group_key FROM geo"


def _shown(terms) -> F.Column:
    return F.array_join(F.transform(terms, lambda t: F.concat(F.when(t["optional"], "?").otherwise("!"), t["term"])), " ")


@query(_VALUES)
def engine_values(spark, d):
    return engine(spark, d).table("values").select("name", "module_id", "signature", _shown("terms").alias("fingerprint"), "group_key")


@query(f"WITH {_GEO} SELECT term, count(*) AS n FROM (SELECT '-geo.' || n AS term FROM geo UNION ALL SELECT '+geo.' || r FROM geo) x GROUP BY term")
def engine_postings(spark, d):
    return engine(spark, d).table("postings").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {_GEO}, own AS (SELECT n, count(*) AS c FROM geo GROUP BY n), here AS (SELECT r, count(*) AS c FROM geo GROUP BY r) "
    f"SELECT 'geo.' || l.n AS name, 0 AS arity, round(coalesce(here.c, 0) / total::DOUBLE, 5) AS f_co, round(coalesce(own.c, 0) / total::DOUBLE, 5) AS f_contra, round(coalesce(here.c, 0) / total::DOUBLE, 5) AS f_inv "
    "FROM lands l LEFT JOIN own USING (n) LEFT JOIN here USING (r), total UNION ALL "
    "SELECT 'geo.' || l.r, 0, round(coalesce(here.c, 0) / total::DOUBLE, 5), round(coalesce(here.c, 0) / total::DOUBLE, 5), round(coalesce(here.c, 0) / total::DOUBLE, 5) FROM (SELECT DISTINCT r FROM lands) l LEFT JOIN here USING (r), total"
)
def engine_type_defs(spark, d):
    """Types with their frequencies, views included: who gives a region gives any of its nations, who takes a nation takes its region."""
    own = engine(spark, d).table("type_defs").filter(F.col("module_id") == WORLD)
    return own.select("name", F.size("params").alias("arity"), *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("f_co", "f_contra", "f_inv")])


@query(
    f"WITH {_GEO} SELECT '+geo.' || r AS from_key, '+geo.' || n AS target FROM lands UNION ALL SELECT '-geo.' || n, '-geo.' || r FROM lands "
    "UNION ALL SELECT '+geo.' || n, '+scala.Nothing' FROM lands UNION ALL SELECT DISTINCT '+geo.' || r, '+scala.Nothing' FROM lands"
)
def engine_views(spark, d):
    views = engine(spark, d).table("views").filter(F.col("module_id") == WORLD)
    return views.select("from_key", F.concat(F.col("target")[0]["variance"], F.col("target")[0]["name"]).alias("target"))


@query(f"WITH {_GEO}, names AS (SELECT n AS short FROM lands UNION SELECT r FROM lands) SELECT short AS suffix, 'geo.' || short AS name FROM names UNION ALL SELECT 'geo.' || short, 'geo.' || short FROM names")
def engine_suffixes(spark, d):
    return engine(spark, d).table("suffixes").filter(F.col("module_id") == WORLD).select("suffix", "name")


@query(f"WITH {_GEO}, m AS (SELECT DISTINCT module_id FROM geo UNION SELECT '{WORLD}' UNION SELECT 'builtin') SELECT module_id, split_part(module_id, ':', 1) AS organization, nullif(split_part(module_id, ':', 2), '') AS name, nullif(split_part(module_id, ':', 3), '') AS revision FROM m")
def module_catalog(spark, d):
    return engine(spark, d).indexed_modules().select("module_id", "organization", "name", "revision")


@query(f"WITH {_GEO} SELECT DISTINCT module_id FROM geo WHERE contains(module_id, 'scala-library') OR contains(module_id, 'scalaz')")
def default_modules(spark, d):
    return spark.createDataFrame([(m,) for m in engine(spark, d).default_modules()], "module_id string")


@query(f"WITH {_GEO} SELECT 'geo.' || x AS name, '{WORLD}' AS module_id FROM (SELECT DISTINCT r AS x FROM lands UNION SELECT n FROM lands) l WHERE x IN ('ASIA', 'NATION_3', 'Nowhere')")
def engine_type_named(spark, d):
    """Exact names, one hit at most."""
    e = engine(spark, d)
    a, b, c = (e.type_named(f"geo.{x}").select("name", "module_id") for x in ("ASIA", "NATION_3", "Nowhere"))
    return a.union(b).union(c)


@query(f"WITH {_GEO}, m AS (SELECT DISTINCT module_id FROM geo UNION SELECT '{WORLD}' UNION SELECT 'builtin') SELECT 'geo' AS active, 'ready' AS state, (SELECT count(*) FROM m) AS modules, (SELECT count(DISTINCT r) FROM lands) AS errors, false AS stale")
def engine_status(spark, d):
    e = engine(spark, d)
    s = e.status()
    return spark.createDataFrame([(e.active(), s["state"], len(s["modules"]), s["errors"], e.needs_rebuild("geo"))], "active string, state string, modules long, errors long, stale boolean")


@query(f"WITH {_GEO} SELECT DISTINCT 'broken [: ' || r AS name, 'not a definition: ''broken [: ' || r || '''' AS error, '{WORLD}' AS module_id FROM lands")
def definition_errors(spark, d):
    """What could not be read goes beside what could."""
    return sd.without_errors(corpus(spark, d))[1].select("name", "error", "module_id")


@query(
    f"WITH {_GEO} SELECT 'values' AS kind, count(*) AS n FROM geo UNION ALL SELECT 'type_defs', count(*) FROM (SELECT n FROM lands UNION SELECT r FROM lands) x UNION ALL SELECT 'views', 3 * (SELECT count(*) FROM lands) + (SELECT count(DISTINCT r) FROM lands) "
    "UNION ALL SELECT 'modules', 1 + count(DISTINCT module_id) FROM geo UNION ALL SELECT 'errors', count(DISTINCT r) FROM lands"
)
def kinds_split(spark, d):
    """A mixed stream of definitions as one table a kind."""
    out = None
    for kind, rows in ix.split_kinds(corpus(spark, d).filter(F.col("module_id") != "builtin")).items():
        counted = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = counted if out is None else out.union(counted)
    return out


@query(f"WITH {_GEO} SELECT 'value' AS kind, name, 'scala.Function1[geo.' || n || ', geo.' || r || ']' AS signature FROM geo UNION ALL SELECT DISTINCT 'type', 'geo.' || x, '' FROM (SELECT n AS x FROM lands UNION SELECT r FROM lands) y")
def json_round_trip(spark, d):
    """Definitions as JSON lines and back."""
    sent = sd.to_json_lines(corpus(spark, d).filter("kind in ('value', 'type') and module_id <> 'builtin'"))
    rows = sd.from_json_lines(sent).select("kind", "name", F.to_json("tpe"))

    def f(kind, name, tpe):
        return kind, name, Type.decode([(n["variance"], n["name"], n["arity"], n["is_param"]) for n in json.loads(tpe)]).signature() if tpe else ""

    return through(rows, f, "kind string, name string, signature string")


# --- statistics over the large corpus ---------------------------------------------------


def _order_values(spark, d) -> DataFrame:
    """Every order as a value whose type has its line items as parts; what is optional is an implicit one."""
    node = "array(named_struct('variance', left(t.term, 1), 'name', substr(t.term, 2), 'arity', 0, 'is_param', false))"
    node = node.replace("left(t.term, 1)", "translate(left(t.term, 1), '/', '')")
    wrapped = f"if(t.optional, concat(array(named_struct('variance', '+', 'name', '<implicit>', 'arity', 1, 'is_param', false)), {node}), {node})"
    terms = corpus_terms(spark, d).groupBy("value_id", "module_id").agg(F.sort_array(F.collect_list(F.struct("term", "optional"))).alias("ts"))
    root = "array(named_struct('variance', '+', 'name', concat('<ignored', size(ts), '>'), 'arity', size(ts), 'is_param', false))"
    tpe = F.expr(f"concat({root}, flatten(transform(ts, t -> {wrapped})))").cast(sd.TREE)
    return terms.select("value_id", "module_id", F.concat(F.lit("order."), "value_id").alias("name"), tpe.alias("tpe"), F.expr("cast(array() as array<struct<name:string,variance:string,lower:array<struct<variance:string,name:string,arity:int,is_param:boolean>>,upper:array<struct<variance:string,name:string,arity:int,is_param:boolean>>>>)").alias("params"))


_TERM = "CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '' END || p_brand"
_ITEMS = f"items AS (SELECT l_orderkey AS value_id, {_TERM} AS term, l_linestatus = 'F' AS optional FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"


@query(f"WITH {_ITEMS}, s AS (SELECT value_id, term, optional, CASE WHEN term[1] IN ('+', '-') THEN term ELSE '/' || term END AS k FROM items) SELECT value_id, string_agg(CASE WHEN optional THEN '?' ELSE '!' END || term, ' ' ORDER BY term, optional) AS fingerprint FROM s GROUP BY value_id")
def fingerprint_array(spark, d):
    return ix.with_fingerprints(_order_values(spark, d)).select("value_id", _shown("terms").alias("fingerprint"))


_FREQUENCY = (
    f"WITH {_ITEMS}, named AS (SELECT value_id, CASE WHEN term[1] IN ('+', '-') THEN term[1] ELSE '' END AS v, CASE WHEN term[1] IN ('+', '-') THEN substr(term, 2) ELSE term END AS name FROM items), "
    "seen AS (SELECT * FROM named UNION SELECT value_id, '-', 'Maker#' || right(name, 1) FROM named WHERE v = '-'), every AS (SELECT * FROM seen UNION SELECT value_id, '', name FROM seen) "
    "SELECT v AS variance, name, round(count(*) / (SELECT count(DISTINCT value_id) FROM items)::DOUBLE, 5) AS frequency FROM every GROUP BY v, name"
)


@query(_FREQUENCY)
def type_frequency(spark, d):
    """Share of values in which a type occurs, by itself or by views: a brand that is taken can be seen as its maker."""
    from .functions.types import View

    brands = [r["p_brand"] for r in table(spark, d, "part").select("p_brand").distinct().collect()]
    views = [View(Type("-", b), Type("-", f"Maker#{b[-1]}")) for b in brands]
    found = ix.type_frequencies(_order_values(spark, d), views).filter(~F.col("name").startswith("<"))
    return found.select("variance", "name", F.round(F.col("frequency").cast("double"), 5).alias("frequency"))


@query(_FREQUENCY)
def type_frequency_joined(spark, d):
    """The same with the views in a table: hops are joins on their keys, and a view back from the maker is not followed in circles."""
    views = table(spark, d, "part").select("p_brand", F.concat(F.lit("Maker#"), F.right("p_brand", F.lit(1))).alias("maker")).distinct()
    node = lambda name: F.array(F.struct(F.lit("-").alias("variance"), name.alias("name"), F.lit(0).alias("arity"), F.lit(False).alias("is_param"))).cast(sd.TREE)
    brand, maker = node(F.col("p_brand")), node(F.col("maker"))
    both = views.select(brand.alias("source"), maker.alias("target")).union(views.select(maker, maker))
    found = ix.type_frequencies(_order_values(spark, d), ix.with_view_keys(both)).filter(~F.col("name").startswith("<"))
    return found.select("variance", "name", F.round(F.col("frequency").cast("double"), 5).alias("frequency"))


# --- searches ---------------------------------------------------------------------------

#: The norm of documents of eight tokens: with two binary digits after the leading one.
_NORM = "(floor(pow(18, -0.25) * pow(2, 2 - floor(log2(pow(18, -0.25))))) * pow(2, floor(log2(pow(18, -0.25))) - 2))"
_ITF = "greatest(ln(2.7 / ({0} * 2.7 + (1 - {0}))) / ln(2.7), 0.001)"


def _whole(spark, d, **settings) -> Engine:
    """The engine with pages of any length, as the SQL has them: what fits grows with the suppliers."""
    e = engine(spark, d)
    return Engine(spark, e.folder.path, e.index_settings, QuerySettings(max_results=EVERY, **settings))


@query(
    f"WITH {_GEO}, asked AS (SELECT n, r FROM lands WHERE n = 'NATION_1'), f AS (SELECT (SELECT count(*) FROM geo JOIN asked USING (n)) / total::DOUBLE AS f1, (SELECT count(*) FROM geo JOIN asked USING (r)) / total::DOUBLE AS f2 FROM total) "
    f"SELECT name, round(CASE WHEN geo.n = asked.n THEN 0.5 * {_ITF.format('f1')} + 0.5 * {_ITF.format('f2')} ELSE 0.5 * {_ITF.format('f2')} / 1.2 END, 4) AS score FROM geo JOIN asked ON geo.r = asked.r, f"
)
def engine_search(spark, d):
    """From a nation to its region: parse, resolve, expand over views, weigh, retrieve, score, rank."""
    r = _lands(spark, d).filter("n = 'NATION_1'").first()["r"]
    return _whole(spark, d).search(f"NATION_1 => {r}", n=EVERY).select("name", F.round(F.col("score").cast("double"), 4).alias("score"))


@query(
    f"WITH {_GEO}, asked AS (SELECT n, r FROM lands WHERE n = 'NATION_1') SELECT split_part(s_name, '#', 2) || ' +scala.Function1[_, _]' AS group_key, 1 AS members, 0 AS more FROM geo JOIN asked USING (r)"
)
def engine_search_grouped(spark, d):
    r = _lands(spark, d).filter("n = 'NATION_1'").first()["r"]
    return _whole(spark, d).search_grouped(f"NATION_1 => {r}", n=EVERY).select("group_key", "members", "more")


@query(f"WITH {_GEO} SELECT name, round(sqrt(2) * (pow(1 + ln(total / 2.0), 2) + pow(1 + ln(total / (total + 1.0)), 2)) * {_NORM}, 4) AS score FROM geo, total WHERE s_name = 'Supplier#000000003'")
def engine_search_keywords(spark, d):
    """Keywords alone: the document that has the rare one comes first."""
    return engine(spark, d).search("supplier 000000003", n=1).select("name", F.round(F.col("score").cast("double"), 4).alias("score"))


#: Everything a query for NATION_1 to its region finds, with one supplier's keyword: typed score, share of the keyword, matched terms.
_BOTH = (
    f"WITH {_GEO}, asked AS (SELECT n AS an, r AS ar FROM lands WHERE n = 'NATION_1'), f AS (SELECT (SELECT count(*) FROM geo JOIN asked ON n = an) / total::DOUBLE AS f1, (SELECT count(*) FROM geo JOIN asked ON r = ar) / total::DOUBLE AS f2 FROM total), "
    f"found AS (SELECT name, n, r, CASE WHEN r <> ar THEN 0 WHEN n = an THEN 0.5 * {_ITF.format('f1')} + 0.5 * {_ITF.format('f2')} ELSE 0.5 * {_ITF.format('f2')} / 1.2 END AS typed, "
    f"CASE WHEN s_name = 'Supplier#000000003' THEN 0.1 * ln(1 + sqrt(2) * pow(1 + ln(total / 2.0), 2) * {_NORM}) ELSE 0 END AS said, "
    "CASE WHEN r <> ar THEN '' WHEN n = an THEN '+geo.' || r || ' -geo.' || n ELSE '+geo.' || r END AS matched FROM geo, asked, f, total WHERE r = ar OR s_name = 'Supplier#000000003') "
)


@query(_BOTH + "SELECT name, round(typed + said, 4) AS score FROM found")
def engine_search_typed_keywords(spark, d):
    """Type and keywords in one query: values of either arm are found, and their scores add up."""
    r = _lands(spark, d).filter("n = 'NATION_1'").first()["r"]
    return _whole(spark, d).search(f"000000003: NATION_1 => {r}", n=EVERY).select("name", F.round(F.col("score").cast("double"), 4).alias("score"))


@query(_BOTH + "SELECT name, round(typed + said, 3) AS score, matched FROM found")
def engine_search_explained(spark, d):
    """What an explanation says: the score, and the terms of the fingerprint that matched."""
    r = _lands(spark, d).filter("n = 'NATION_1'").first()["r"]
    found = _whole(spark, d, explain=True).search(f"000000003: NATION_1 => {r}", n=EVERY)
    terms = F.array_sort(F.regexp_extract_all("explanation", F.lit(r"(\S+)\^[0-9.]+"), 1))
    return found.select("name", F.round(F.regexp_extract("explanation", r"^(\S+) =", 1).cast("double"), 3).alias("score"), F.array_join(terms, " ").alias("matched"))


@query(f"WITH {_GEO} SELECT name, round(sqrt(2) * pow(1 + ln(total / (total + 1.0)), 2) * {_NORM}, 4) AS score FROM geo, total")
def engine_search_retried(spark, d):
    """A bare name that is no type is asked for again as a keyword."""
    return _whole(spark, d).search("Supplier", n=EVERY).select("name", F.round(F.col("score").cast("double"), 4).alias("score"))


@query(f"WITH {_GEO} SELECT token, count(*) AS n, count(DISTINCT module_id) AS modules FROM (SELECT 'shop' AS token, module_id FROM geo UNION ALL SELECT 'supplier', module_id FROM geo UNION ALL SELECT lower(s_name), module_id FROM geo UNION ALL SELECT split_part(s_name, '#', 2), module_id FROM geo) x GROUP BY token")
def engine_name_postings(spark, d):
    postings = engine(spark, d).table("name_postings")
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("module_id").alias("modules"))


@query(f"WITH {_GEO} SELECT name, module_id FROM geo WHERE s_name = 'Supplier#000000003'")
def engine_find_by_name(spark, d):
    return engine(spark, d).find_by_name("000000003 supplier").select("name", "module_id")


@query(f"WITH {_GEO}, asked AS (SELECT n, r FROM geo WHERE s_name = 'Supplier#000000003') SELECT name FROM geo JOIN asked ON geo.n = asked.n AND geo.r = asked.r")
def engine_similar_values(spark, d):
    """Values that fit the type of a given value best: those with the same terms."""
    e = _whole(spark, d)
    t = e.table("values").filter("name = 'shop.Supplier#000000003'").first()["tpe"]
    best = e.like(Type.decode(t), n=1).select("terms")
    return e.like(Type.decode(t), n=EVERY).select("name", "terms").join(F.broadcast(best), "terms").select("name")


# --- changes of an index ----------------------------------------------------------------


@query(f"WITH {_GEO} SELECT name, module_id FROM geo WHERE module_id <> 'shop:scalaz:1' AND n <> 'NATION_1'")
def engine_deletions(spark, d):
    """A module goes, then the values of an artifact."""
    e = Engine(spark, working_folder(spark), IndexSettings(sample_size=0))
    e.index("geo", corpus(spark, d))
    e.finalize("geo")
    e.delete_module("shop:scalaz:1")
    e.delete_artifact("geo.NATION_1")
    return e.table("values").select("name", "module_id")


@query(
    f"WITH {_GEO}, w(compacted) AS (VALUES (false), (true)) SELECT compacted, module_id, count(*) AS of_values, 2 * count(*) AS of_postings, 4 * count(*) AS of_names, 8 * count(*) AS of_words FROM geo, w "
    "WHERE n <> 'NATION_1' OR r = 'EUROPE' GROUP BY compacted, module_id"
)
def engine_segments(spark, d):
    """An index that grows by a segment, has an artifact and a module deleted, and gets the module again; then the same as one segment."""
    e, every = Engine(spark, working_folder(spark), IndexSettings(sample_size=0)), kept(corpus(spark, d))
    module = F.coalesce("module_id", F.lit(""))
    e.index("geo", every.filter(module != "shop:scalaz:1"))
    e.finalize("geo")
    e.index("geo", every.filter(module == "shop:scalaz:1"))
    e.finalize("geo")
    e.delete_artifact("geo.NATION_1")
    e.delete_module("shop:europe:1")
    e.index("geo", every.filter(module == "shop:europe:1"))
    e.finalize("geo")
    before = _by_module(e, False)
    e.compact("geo")
    return before.union(_by_module(e, True))


def _by_module(e: Engine, compacted: bool) -> DataFrame:
    """Rows of an index's tables in each module."""
    counts = e.table("values").select("module_id", F.lit("of_values").alias("k"), F.lit(1).cast("long").alias("n"))
    for kind, name, n in (("postings", "of_postings", F.lit(1)), ("name_postings", "of_names", F.lit(1)), ("doc_terms", "of_words", F.col("tf"))):
        counts = counts.union(e.table(kind).select("module_id", F.lit(name), n.cast("long")))
    found = counts.groupBy("module_id").pivot("k", ["of_values", "of_postings", "of_names", "of_words"]).agg(F.sum("n"))
    return found.select(F.lit(compacted).alias("compacted"), "module_id", "of_values", "of_postings", "of_names", "of_words")


@query(f"WITH {_GEO} SELECT name, '!geo.' || least(n, r) || ' !geo.' || greatest(n, r) AS fingerprint FROM geo")
def engine_rebuild(spark, d):
    """Two indexes become one when it is built again, with other settings."""
    e = Engine(spark, working_folder(spark), IndexSettings(sample_size=0))
    every = kept(corpus(spark, d))
    asia = F.coalesce(F.col("module_id") == "shop:scalaz:1", F.lit(False))
    e.index("other", every.filter(asia))
    e.index("geo", every.filter(~asia))
    e.finalize("geo")
    e.index_settings = IndexSettings(sample_size=0, polarized=False)
    if not e.needs_rebuild("geo") or not e.rebuild("geo", ["other"]):
        raise RuntimeError("the index was not built again")
    return e.table("values", "geo").select("name", _shown("terms").alias("fingerprint"))


_OUTCOME = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'assessed' ELSE 'succeeded' END"


@query(
    f"SELECT {_OUTCOME} AS outcome, CASE WHEN event_type <> 'purchase' THEN event_id % 4 END::INTEGER AS page, count(*) AS n, count(DISTINCT user_id) AS queries, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS signatures, "
    "strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events GROUP BY 1, 2"
)
def interaction_report(spark, d):
    """Users' events as interactions, appended as a batch of searches and one of assessments; counted by outcome and page."""
    e = Engine(spark, working_folder(spark))
    events = table(spark, d, "events").select("ts", "props", "event_type", F.concat_ws(" ", F.lit("by"), "user_id").alias("query"), F.expr(_OUTCOME).alias("outcome"), (F.col("event_id") % 4).alias("page"))
    e.log_rows(events.filter("outcome <> 'assessed'"))
    e.assess_rows(events.filter("outcome = 'assessed'").select("ts", "query", F.array(F.lit(WORLD)).alias("modules"), F.col("props").alias("signature")))
    counted = e.interactions().groupBy("outcome", "page").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query").alias("queries"), F.count("detail").alias("signatures"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"))
    return counted.select("outcome", "page", "n", "queries", "signatures", "latest")


@query("SELECT o_orderpriority AS query, round(avg(o_totalprice), 2) AS ap FROM orders GROUP BY o_orderpriority")
def csv_sink(spark, d):
    """Lines appended to a table of separated text, in two batches, and read again."""
    where = working_folder(spark)
    lines = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("query")).agg(F.round(F.avg("o_totalprice"), 2).alias("ap"))
    append_csv(lines.filter("query < '3'"), where)
    append_csv(lines.filter("query >= '3'"), where)
    return spark.read.option("sep", ";").option("header", True).schema("query string, ap double").csv(where)


@query(f"WITH {_GEO} SELECT name, module_id FROM geo")
def micro_batches(spark, d):
    """Definition lines that arrive in files are indexed in micro-batches; what has arrived is searched."""
    from .streaming.events import ingest

    where, e = working_folder(spark), Engine(spark, working_folder(spark), IndexSettings(sample_size=0))
    lines = corpus_lines(spark, d)
    lines.filter("value like 'type%'").write.parquet(f"{where}/in")
    lines.filter("not value like 'type%'").write.mode("append").parquet(f"{where}/in")
    stream = spark.readStream.schema("value string, m string").option("maxFilesPerTrigger", 4).parquet(f"{where}/in")
    ingest(stream, e, "geo", f"{where}/progress", lambda batch: sd.read_lines(batch, module="m", builtins=False))
    return e.table("values").select("name", "module_id")


def _called(e: Engine, query: str, n: int = 10_000) -> int:
    """How many results a query has in all pages of ``n``; the driver holds one page at a time."""
    found = 0
    while True:
        page = len(e.call({"method": "search", "query": query, "n": n, "offset": found})["results"])
        found += page
        if page < n:
            return found


@query(
    f"WITH {_GEO}, asked AS (SELECT n, r FROM lands WHERE n = 'NATION_1') SELECT 'search' AS method, (SELECT count(*) FROM geo JOIN asked USING (r))::VARCHAR AS answer UNION ALL SELECT 'status', 'ready' "
    "UNION ALL SELECT 'modules', (SELECT string_agg(m, ' ' ORDER BY m) FROM (SELECT DISTINCT module_id AS m FROM geo UNION SELECT 'geo:world:1' UNION SELECT 'builtin') x) "
    "UNION ALL SELECT 'wrong', 'Type Nowhere not found.' UNION ALL SELECT 'none', 'unknown method ''none'''"
)
def service_calls(spark, d):
    """Requests as plain values, and what they are answered; a search is asked for page by page."""
    e, r = engine(spark, d), _lands(spark, d).filter("n = 'NATION_1'").first()["r"]
    rows = [("search", str(_called(_whole(spark, d), f"NATION_1 => {r}"))), ("status", e.call({"method": "status"})["state"])]
    rows += [("modules", " ".join(sorted(e.call({"method": "modules"})["modules"]))), ("wrong", e.call({"method": "search", "query": "Nowhere[ASIA]"})["error"]), ("none", e.call({"method": "none"})["error"])]
    return spark.createDataFrame(rows, "method string, answer string")


@query(
    "SELECT doc_id, '<li><h3>' || CASE WHEN lang = 'en' THEN '<a href=\"http://d/?a=1&amp;b=' || source || '\">' || x || '</a>' ELSE x END || '</h3><small>' || source || ' &middot; ' || format('{:,.2f}', n_chars / 8.0) || '</small>' || "
    "CASE WHEN lang IN ('de', 'en') THEN '<div><b>' || lang || '</b></div>' ELSE '' END || '</li>' AS entry, CASE WHEN doc_id % 3 < 2 THEN '/search?q=' || replace(url_encode('a => ' || lang), '%20', '+') || '&p=' || (doc_id % 3 + 1) END AS next_page "
    "FROM (SELECT *, 'f&lt;' || lang || '&gt;: A =&gt; &quot;&amp;&quot;' AS x FROM documents) y"
)
def result_pages(spark, d):
    """Results as entries of a page, and the link to the next."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    signature = F.concat(F.lit("f<"), "lang", F.lit('>: A => "&"'))
    link = F.when(F.col("lang") == "en", F.concat(F.lit("http://d/?a=1&b="), "source"))
    comment = F.when(F.col("lang").isin("de", "en"), F.concat(F.lit("<b>"), "lang", F.lit("</b>")))
    entry = pages.entry(signature, F.col("source"), F.col("n_chars") / 8, link, comment)
    return docs.select("doc_id", entry.alias("entry"), pages.page_link(F.concat(F.lit("a => "), "lang"), F.col("doc_id") % 3, F.lit(2)).alias("next_page"))


# --- sources ----------------------------------------------------------------------------


def _archives(spark, d) -> DataFrame:
    """One archive a region with a source text for each nation, and one that is broken: ``(path, content)``."""
    import io
    import zipfile

    import pandas as pd

    text = (
        "concat('package geo\\n/** Land ', n, '.\\n * @param A held\\n * @author ', r, '\\n */\\nclass ', n, '[+A](val size: Int) extends Base[A] {\\n  def first(n: Int): A = ???\\n  private def hidden(s: String): Int = 1\\n"
        "  override def all: List[A] = { def inner: Int = 2; Nil }\\n  val loose = 1\\n}\\nobject ', n, ' {\\n  implicit def toText(x: ', n, '[Int]): String = \"def no: Int\"\\n}\\nprivate trait Secret', n, '\\n')"
    )

    def pack(key, frame):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for n, body in zip(frame["n"], frame["body"], strict=True):
                z.writestr(f"geo/{n}.scala", body)
                z.writestr(f"geo/{n}.class", b"\x00")
        return pd.DataFrame([(f"{key[0]}.jar", held.getvalue())], columns=["path", "content"])

    made = _lands(spark, d).select("n", "r", F.expr(text).alias("body")).groupBy("r").applyInPandas(pack, "path string, content binary")
    return made.union(spark.sql("SELECT 'broken.jar', cast('no archive' AS binary)"))


@query(f"WITH {_GEO} SELECT r || '.jar' AS artifact, 'geo/' || n || '.scala' AS inner_path, NULL AS error FROM lands UNION ALL SELECT 'broken.jar', NULL, 'File is not a zip file'")
def archive_entries(spark, d):
    return sd.archive_entries(_archives(spark, d)).select("artifact", "inner_path", "error")


@query(
    f"WITH {_GEO}, x(k, kind, member, signature, flags, link, comment) AS (VALUES (1, 'type', '', '', '', '', '<p>Land @.</p> params=<dl><dt>A</dt><dd><p>held</p></dd></dl> authors=<p>%</p>'), (2, 'value', '.<init>', '<methodInvocation1>[scala.Int, geo.@[A]]', 'static', NULL, '<p>Land @.</p> params=<dl><dt>A</dt><dd><p>held</p></dd></dl> authors=<p>%</p>'), "
    "(3, 'value', '.first', '<memberAccess>[geo.@[A], <methodInvocation1>[scala.Int, A]]', '', '@first(n:Int):A', ''), (4, 'value', '.all', '<memberAccess>[geo.@[A], scala.collection.immutable.List[A]]', 'overrides', '@all:List[A]', ''), (5, 'error', '.loose', '', '', NULL, ''), "
    "(6, 'value', '', 'geo.@.type', 'static', '$', ''), (7, 'value', '.toText', '<methodInvocation1>[geo.@[scala.Int], java.lang.String]', 'implicit static', '$@toText(x:@@[Int]):String', '')) "
    "SELECT kind, 'geo.' || n || member AS name, replace(signature, '@', n) AS signature, flags, 'geo.' || n || replace(link, '@@', n) AS doc_link, replace(replace(comment, '@', n), '%', r) AS comment FROM lands, x"
)
def source_definitions(spark, d):
    """Declarations of all archives: types, constructors, members with flags, documentation and links; what is hidden stays so."""
    found = read_sources(sd.without_errors(sd.archive_entries(_archives(spark, d)))[0]).filter("kind <> 'view'")
    rows = found.select("kind", "name", F.to_json("tpe"), F.array_join("flags", " "), "doc_link", "comment", F.to_json("attributes"))

    def f(kind, name, tpe, flags, link, comment, attributes):
        said = " ".join([comment or "", *(f"{a['key']}={a['value']}" for a in json.loads(attributes or "[]"))]).strip()
        shown = Type.decode([(n["variance"], n["name"], n["arity"], n["is_param"]) for n in json.loads(tpe)]).signature() if tpe else ""
        return kind, name, shown, flags or "", link, said

    return through(rows, f, "kind string, name string, signature string, flags string, doc_link string, comment string")


@query(f"WITH {_GEO}, b AS (SELECT 'geo.Base' AS x) SELECT from_key, target FROM (SELECT '+Base[+_]' AS from_key, '+geo.' || n || '[+_]' AS target FROM lands UNION ALL SELECT '-geo.' || n || '[-_]', '-Base[-_]' FROM lands UNION ALL SELECT '+geo.' || n || '[+_]', '+<bottom1>[+_]' FROM lands UNION ALL SELECT '-geo.' || n || '[-_]', '-<top1>[-_]' FROM lands UNION ALL SELECT '+geo.' || n || '[+_]', '+scala.Nothing' FROM lands UNION ALL SELECT '+java.lang.String', '+geo.' || n || '[+_]' FROM lands UNION ALL SELECT '-geo.' || n || '[-_]', '-java.lang.String' FROM lands UNION ALL SELECT '+geo.' || n || '.type', '+scala.Nothing' FROM lands) y")
def source_views(spark, d):
    """Views from inheritance and from implicit conversions of the same sources."""
    views = ix.split_kinds(read_sources(sd.without_errors(sd.archive_entries(_archives(spark, d)))[0], module=None))["views"]
    rows = ix.with_view_keys(views).select("from_key", F.to_json("target"))
    return through(rows, lambda k, t: (k, Type.decode([(n["variance"], n["name"], n["arity"], n["is_param"]) for n in json.loads(t)]).key()), "from_key string, target string")


def _project(spark, d) -> DataFrame:
    """Definitions of texts that use each other's types: a text a region, a nation (in the region's package) and a supplier (by import)."""
    lands = _lands(spark, d)
    regions = lands.select("r").distinct().select(F.concat(F.lit("region/"), "r").alias("artifact"), F.expr("concat('package geo.', r, '\ntrait Region[+T] {\n  def size: Int\n  def at(i: Int): T\n  def named(s: String): Unknown', r, '\n}\n')").alias("text"))
    nations = lands.select(F.concat(F.lit("nation/"), "n"), F.expr("concat('package geo.', r, '\nabstract class ', n, '[+A] extends Region[List[A]] {\n  def only: ', n, '[Int]\n  def at(i: Int): List[A]\n}\n')"))
    k = "'S' || split_part(s_name, '#', 2)"
    text = f"concat('package shop\nimport geo.', r, '.{{', n, ' => Land}}\nclass ', {k}, '[B >: Land[Int]] extends Land[B] {{\n  def land: Land[Int] = ???\n  def region: geo.', r, '.Region[B] = ???\n}}\n')"
    shops = _suppliers(spark, d).select(F.concat(F.lit("shop/"), "s_name"), F.expr(text))
    return signatures(read_project(regions.union(nations).union(shops).withColumn("inner_path", F.lit("")), module=None))


_SHOP = f"WITH {_GEO}, s AS (SELECT 'shop.S' || split_part(s_name, '#', 2) AS s, 'geo.' || r || '.' || n AS l, 'geo.' || r || '.Region' AS g FROM geo), l AS (SELECT 'geo.' || r || '.' || n AS l, 'geo.' || r || '.Region' AS g, r FROM lands)"


@query(
    f"{_SHOP} SELECT 'value' AS kind, s || '.land' AS name, '+<memberAccess>[-' || s || '[B], +' || l || '[+scala.Int]]' AS signature, '+' || l || '[+scala.Int]' AS lower, NULL AS error FROM s "
    "UNION ALL SELECT 'value', s || '.region', '+<memberAccess>[-' || s || '[B], +' || g || '[+B]]', '+' || l || '[+scala.Int]', NULL FROM s UNION ALL SELECT 'type', s, NULL, '+' || l || '[+scala.Int]', NULL FROM s "
    "UNION ALL SELECT 'value', l || '.only', '+<memberAccess>[-' || l || '[+A], +' || l || '[+scala.Int]]', '+scala.Nothing', NULL FROM l "
    "UNION ALL SELECT DISTINCT 'error', g || '.named', NULL, NULL, 'type Unknown' || r || ' not found' FROM l"
)
def source_names(spark, d):
    """Names that other texts declare: by import under another name, by their package, in full, in lower bounds; and one that nothing declares."""
    from .functions.trees import rendered

    rows = _project(spark, d)
    own = rows.filter("(kind = 'type' and name like 'shop.%') or (kind = 'value' and (name like '%.land' or name like '%.region' or (name like '%.only' and name like 'geo.%'))) or kind = 'error'")
    return own.select("kind", "name", "signature", rendered(F.col("params")[0]["lower"]).alias("lower"), "error")


@query(
    f"{_SHOP}, b AS (SELECT s, l || '[+B]' AS co, l || '[-B]' AS contra FROM s UNION ALL SELECT s, g || '[+scala.collection.immutable.List[+B]]', g || '[-scala.collection.immutable.List[-B]]' FROM s) "
    "SELECT '+' || co AS source, '+' || s || '[B]' AS target FROM b UNION ALL SELECT '-' || s || '[B]', '-' || contra FROM b "
    "UNION ALL SELECT '+' || s || '[B]', '+<bottom1>[B]' FROM s UNION ALL SELECT '-' || s || '[B]', '-<top1>[B]' FROM s UNION ALL SELECT '+' || s || '[B]', '+scala.Nothing' FROM s"
)
def source_base_types(spark, d):
    """Views between suppliers and all their base types, those of other texts included, with type arguments put in."""
    return _project(spark, d).filter("kind = 'view' and name like 'shop.%'").select(F.col("signature").alias("source"), F.col("seen_as").alias("target"))


@query(
    f"{_SHOP}, m(short, tpe) AS (VALUES ('size', '+scala.Int'), ('at', '+<methodInvocation1>[-scala.Int, +scala.collection.immutable.List[+B]]'), ('only', NULL)) "
    "SELECT s || '.' || short AS name, '+<memberAccess>[-' || s || '[B], ' || coalesce(tpe, '+' || l || '[+scala.Int]') || ']' AS signature, CASE short WHEN 'size' THEN 'region' ELSE 'nation' END AS declared_in FROM s, m"
)
def source_inherited(spark, d):
    """Members that suppliers have from their base types; the closest declaration hides the one above it."""
    rows = _project(spark, d).filter("kind = 'value' and name like 'shop.%' and not (name like '%.land' or name like '%.region' or name like '%.<init>')")
    return rows.select("name", "signature", F.split_part("artifact", F.lit("/"), F.lit(1)).alias("declared_in"))


@query("SELECT DISTINCT c_mktsegment || ':n' || c_nationkey AS module, CASE WHEN c_nationkey % 5 > 0 THEN 'http://doc/n' || c_nationkey END AS doc_url, count(*) AS relevant, count(DISTINCT c_nationkey % 3) AS queries FROM customer GROUP BY c_mktsegment, c_nationkey")
def settings_source(spark, d):
    """Modules and judged queries of settings texts, one for each customers' segment and nation, written as files and read from them."""
    where, by = working_folder(spark), ["c_mktsegment", "c_nationkey"]
    address = F.when(F.col("c_nationkey") % 5 > 0, F.concat(F.lit("http://doc/n"), "c_nationkey")).otherwise("")
    name = F.concat(F.lit("n"), "c_nationkey")
    modules = F.array(F.struct(F.col("c_mktsegment").alias("organization"), name.alias("name"), F.lit("1").alias("revision"), address.alias("doc_url")))
    wanted = table(spark, d, "customer").groupBy(*by).agg(F.collect_list(F.col("c_custkey").cast("string")).alias("w"))
    queries = F.create_map((F.col("c_nationkey") % 3).cast("string"), F.col("w"))
    wanted.select(F.to_json(F.struct(modules.alias("modules"), F.array(F.struct(F.concat_ws(":", "c_mktsegment", name).alias("name"), queries.alias("queries"))).alias("projects"))).alias("value")).write.text(where)
    m, golden = sd.settings_rows(spark.read.text(where))
    golden = golden.groupBy("project").agg(F.count(F.lit(1)).alias("relevant"), F.countDistinct("query").alias("queries"))
    m = m.select(F.concat_ws(":", "organization", "name").alias("module"), "doc_url")
    return m.join(golden, m.module == golden.project).select("module", "doc_url", "relevant", "queries")


@query("SELECT DISTINCT c_mktsegment AS organization, 'n' || c_nationkey AS name, '1' AS revision FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def wanted_jobs(spark, d):
    """Modules of all customers that suppliers want, once each."""
    def named(rows, org, nation):
        return rows.select(org.alias("organization"), F.concat(F.lit("n"), nation).alias("name"), F.lit("1").alias("revision"))

    segments = table(spark, d, "customer").select("c_mktsegment").distinct()
    wanted = named(table(spark, d, "supplier").crossJoin(F.broadcast(segments)), F.col("c_mktsegment"), F.col("s_nationkey"))
    return sd.jobs(wanted, named(table(spark, d, "customer"), F.col("c_mktsegment"), F.col("c_nationkey")))


# --- language-neutral engine ------------------------------------------------------------


def _store(spark, d) -> neutral.DocumentStore:
    docs = corpus_terms(spark, d).groupBy("value_id").agg(F.collect_set("term").alias("keys"))
    return neutral.DocumentStore(docs.select(F.col("value_id").cast("string").alias("name"), "keys", F.lit("orders").alias("source")))


_KEYED = "postings AS (SELECT DISTINCT l_orderkey AS value_id, CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '/' END || p_brand AS term FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"


@query(f"WITH {_KEYED} SELECT value_id::VARCHAR AS name FROM postings WHERE term IN ('+Brand#11', '-Brand#2') GROUP BY value_id HAVING count(*) = 2")
def documents_with_all_keys(spark, d):
    return _store(spark, d).by_keys(["+Brand#11", "-Brand#2"]).select("name")


@query(f"WITH {_KEYED} SELECT DISTINCT value_id::VARCHAR AS name FROM postings WHERE term IN ('+Brand#11', '-Brand#2')")
def documents_with_any_key(spark, d):
    return _store(spark, d).by_any(["+Brand#11", "-Brand#2"]).select("name")


@query(f"WITH {_KEYED} SELECT '+Brand#11' AS keys, count(*) AS documents FROM postings WHERE term = '+Brand#11' UNION ALL SELECT '+Brand#11 -Brand#2', count(*) FROM (SELECT value_id FROM postings WHERE term IN ('+Brand#11', '-Brand#2') GROUP BY value_id HAVING count(*) = 2) x")
def documents_by_key(spark, d):
    store = _store(spark, d)
    return spark.createDataFrame([(" ".join(k), store.count(k)) for k in (["+Brand#11"], ["+Brand#11", "-Brand#2"])], "keys string, documents long")


def _neutral_types(spark, d) -> list[neutral.Definition]:
    lands = _lands(spark, d).collect()
    types = [neutral.Definition(r["n"], Type(CO, r["n"]), (), (Type(CO, r["r"]),), True) for r in lands]
    return types + [neutral.Definition(r, Type(CO, r), is_type=True) for r in sorted({x["r"] for x in lands})]


@query(
    f"WITH {_GEO}, t AS (SELECT '-' || n AS term, 1 AS c FROM geo UNION ALL SELECT '/' || n, 1 FROM geo UNION ALL SELECT '-' || r, 1 FROM geo UNION ALL SELECT '+' || r, 1 FROM geo UNION ALL SELECT '/' || r, 1 FROM geo "
    "UNION ALL SELECT '+' || l.n, 1 FROM geo JOIN lands l USING (r) UNION ALL SELECT '+<bottom0>', 1 FROM geo UNION ALL SELECT '-<top0>', 1 FROM geo UNION ALL SELECT '/<unknown0>', 2 FROM geo) SELECT term, sum(c)::BIGINT AS tf FROM t GROUP BY term"
)
def neutral_frequency(spark, d):
    """Documents that the sources of a term's views lead to; suppliers are functions from nation to region."""
    s = _suppliers(spark, d)
    docs = s.select(F.col("s_name").alias("name"), F.array(F.concat(F.lit("-"), "n"), F.concat(F.lit("+"), "r")).alias("keys"), F.lit("shop").alias("source"))
    lands = _lands(spark, d)
    own = lambda c: F.concat(F.lit("+"), c)
    types = lands.select(own("n").alias("type"), F.array(own("r")).alias("supertypes")).union(lands.select(own("r"), F.expr("cast(null as array<string>)")).distinct())
    return neutral.term_frequencies(neutral.DocumentStore(docs), neutral.view_keys(types, NeutralSettings()))


@query(
    f"WITH {_GEO} SELECT n, '+<fn1>[-' || n || ', +<top0>]' AS internal, '-' || n || ' +<top0>' AS keys, '+' || n || ' +<bottom0> <unknown0> ' || n AS elementary, '+' || r || ' -> +' || n || '; -' || n || ' -> -' || r AS views, "
    "'+<fn1>[-<top0>, +' || n || ']' AS bounded, '1 0' AS distances FROM lands"
)
def neutral_names(spark, d):
    """A language's names as internal ones, what any type can be seen as, views of a type, bounds, distances."""
    s = NeutralSettings()

    def f(n, r):
        t = neutral.internal(read_type(f"+Fn1[-{n}, +Any]"), s)
        own = neutral.Definition(n, Type(CO, n), (), (Type(CO, r),), True)
        views = neutral.definition_views(own)
        bounded = neutral.bounded(neutral.internal(read_type(f"+Fn1[-T, +{n}]"), s), [neutral.Bound("T")])
        far = " ".join(str(v.distance) for v in (views[0], neutral.View(Type(CO, n), Type(CO, n))))
        return n, str(t), " ".join(neutral.value_keys(neutral.Definition("f", t))), " ".join(map(str, neutral.elementary(Type(CO, n)))), "; ".join(v.name for v in views), str(bounded), far

    return through(_lands(spark, d).select("n", "r"), f, "n string, internal string, keys string, elementary string, views string, bounded string, distances string")


@query(f"WITH {_GEO} SELECT name FROM (SELECT s_name AS name FROM geo JOIN lands l ON geo.n = l.n WHERE l.n = 'NATION_1') x")
def neutral_search(spark, d):
    """The language-neutral engine from a nation to its region: those of the same nation come first."""
    e = neutral.NeutralEngine(spark)
    e.index(_neutral_types(spark, d))
    e.index_values(_suppliers(spark, d).select(F.col("s_name").alias("name"), F.concat(F.lit("+Fn1[-"), "n", F.lit(", +"), "r", F.lit("]")).alias("type"), F.lit("shop").alias("source")))
    e.finalize()
    r = _lands(spark, d).filter("n = 'NATION_1'").first()["r"]
    found = e.search(read_type(f"+Fn1[-NATION_1, +{r}]"))
    return found.filter("penalty = 0").select("name")
