"""All queries of the search engine by name, and their SQL.

The tables stand for a corpus of definitions: an order is a value, its line items with their parts are the terms of
its type, suppliers in nations in regions are types with qualified names, and views lead from each
to the next. Documents are documentation, their sources modules, their labels relevance judgements; events are interactions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import measures, text
from .functions.variance import flip_col, times_col
from .operators import index as ix
from .operators import sets, views
from .plans.expansion import Leaf, Max, Sum
from .plans.scoring import Scorer
from .sources.files import kept
from .streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Terms of a fixed query with their boosts, in powers of two so that sums are exact in any precision.
LEAVES = {"+Brand#11": 1.0, "-Brand#22": 0.5, "/Brand#3": 0.25, "+Brand#4": 0.125}
KEYWORDS = ["the", "heon", "der"]

_TERM_SQL = "CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '/' END || p_brand"
_POSTINGS = f"""postings AS (
    SELECT {_TERM_SQL} AS term, l_orderkey AS value_id, o_orderpriority AS module_id, l_linestatus = 'F' AS optional,
           row_number() OVER (PARTITION BY l_orderkey, {_TERM_SQL} ORDER BY l_linestatus = 'F') AS occurrence
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""
_NAMES = "names AS (SELECT r_name || '.' || n_name || '.' || s_name AS name, s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_EDGES = """edges AS (
    SELECT s_name AS source, n_name AS target, 0.5::DOUBLE AS retained FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT n_name, r_name, 0.75 FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_PARTS_SQL = r"[\p{Lu}]*[\p{Ll}]+|[\p{Lu}]+|[0-9]+"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Line items of one task.
ITEMS = 1_000_000


def corpus_terms(spark, d) -> DataFrame:
    """``(value_id, module_id, term, optional)`` of every line item."""
    variance = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise("/")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus", variance.alias("v"))
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    # A task has so many items at most, however large the table is; what is grouped by value later stays where it is.
    tasks = max(items.count() // ITEMS + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    branded = items.join(parts, items.l_partkey == parts.p_partkey).repartition(tasks, "l_orderkey")
    joined = branded.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("l_orderkey").alias("value_id"), F.col("o_orderpriority").alias("module_id"), F.concat("v", "p_brand").alias("term"), (F.col("l_linestatus") == "F").alias("optional"))


def corpus_values(spark, d) -> DataFrame:
    """Values with their fingerprints: terms in order. A value has a handful of line items."""
    terms = F.sort_array(F.collect_list(F.struct("term", "optional")))
    return corpus_terms(spark, d).groupBy("value_id", "module_id").agg(terms.alias("terms"))


def type_names(spark, d) -> DataFrame:
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    name = text.append_member(text.append_member(F.col("r_name"), F.col("n_name")), F.col("s_name"))
    return joined.select(name.alias("name"), "s_suppkey", "n_name", "r_name")


def view_edges(spark, d) -> DataFrame:
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    up = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("source"), F.col("n_name").alias("target"), F.lit(0.5).alias("retained"))
    return up.union(n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name", F.lit(0.75)))


# --- indexes ----------------------------------------------------------------------------


@query(f"WITH {_POSTINGS} SELECT term, value_id, module_id, optional, occurrence::INT AS occurrence FROM postings")
def postings_build(spark, d):
    return ix.postings(corpus_values(spark, d))


@query(f"WITH {_POSTINGS} SELECT DISTINCT value_id FROM postings WHERE term IN ('+Brand#11', '-Brand#22') AND module_id = '1-URGENT'")
def candidate_semi_join(spark, d):
    from .operators.search import candidates

    return candidates(corpus_terms(spark, d), ["+Brand#11", "-Brand#22"], ["1-URGENT"])


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2')")
def module_filter(spark, d):
    return sets.only_modules(table(spark, d, "documents").select("doc_id", "source"), ["src1", "src2"], "source")


@query("SELECT doc_id, source FROM documents")
def module_filter_all(spark, d):
    return sets.only_modules(table(spark, d, "documents").select("doc_id", "source"), [], "source")


@query(f"WITH {_NAMES} SELECT substr(name, i::INT) AS suffix, name FROM names, range(1, 200) t(i) WHERE i <= length(name) AND (i = 1 OR substr(name, i::INT - 1, 1) IN ('.', '#'))")
def name_suffixes(spark, d):
    return type_names(spark, d).select(F.explode(text.suffixes(F.col("name"))).alias("suffix"), "name")


@query(
    f"WITH {_NAMES}, s AS (SELECT substr(name, i::INT) AS suffix, name FROM names, range(1, 200) t(i) WHERE i <= length(name) AND (i = 1 OR substr(name, i::INT - 1, 1) IN ('.', '#'))), "
    "asked AS (SELECT s_name AS raw FROM supplier UNION SELECT 'nothing') "
    "SELECT raw, count(s.name) AS hits, CASE count(s.name) WHEN 0 THEN 'not found' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome FROM asked LEFT JOIN s ON suffix = raw GROUP BY raw"
)
def suffix_lookup(spark, d):
    asked = table(spark, d, "supplier").select(F.col("s_name").alias("raw")).union(spark.sql("SELECT 'nothing'")).distinct()
    hits = asked.join(name_suffixes(spark, d), F.col("raw") == F.col("suffix"), "left").groupBy("raw").agg(F.count("name").alias("hits"))
    return hits.withColumn("outcome", F.when(F.col("hits") == 0, "not found").when(F.col("hits") == 1, "resolved").otherwise("ambiguous"))


@query(f"WITH {_NAMES} SELECT n_name, name FROM names QUALIFY rank() OVER (PARTITION BY n_name ORDER BY regexp_matches(name, '#[0-9]*5$') DESC) = 1")
def prefer_candidates(spark, d):
    return sets.prefer(type_names(spark, d).select("n_name", "name"), ["n_name"], F.col("name").rlike("#[0-9]*5$")).select("n_name", "name")


@query(f"WITH {_NAMES} SELECT name, list_extract(string_split_regex(name, '[.#]'), -1) AS short_name, name || '.apply' AS member, ('org:' || n_name || ':' || r_name) AS module_id, ('org:' || n_name || ':' || r_name || ':' || name) AS row_key, ends_with(r_name, 'ICA') AS snapshot FROM names")
def qualified_names(spark, d):
    module = text.module_id(F.lit("org"), F.col("n_name"), F.col("r_name"))
    name = F.col("name")
    return type_names(spark, d).select("name", text.short_name(name).alias("short_name"), text.append_member(name, F.lit("apply")).alias("member"), module.alias("module_id"), text.row_key(module, name).alias("row_key"), F.col("r_name").endswith("ICA").alias("snapshot"))


@query(
    "WITH v(a) AS (VALUES ('+'), ('-'), ('')) SELECT x.a AS a, y.a AS b, translate(x.a, '+-', '-+') AS flipped, "
    "CASE WHEN x.a = '' OR y.a = '' THEN '' WHEN x.a = y.a THEN '+' ELSE '-' END AS product FROM v x, v y"
)
def variance_algebra(spark, d):
    pairs = spark.createDataFrame([(a, b) for a in "+-/" for b in "+-/"], "a string, b string").replace("/", "")
    return pairs.select("a", "b", flip_col(F.col("a")).alias("flipped"), times_col(F.col("a"), F.col("b")).alias("product"))


# --- views ------------------------------------------------------------------------------


def _starts(spark, d):
    return table(spark, d, "supplier").select(F.col("s_name").alias("start"), F.col("s_name").alias("node"), F.lit(1.0).alias("kept"))


@query(f"WITH {_EDGES} SELECT s_name AS start, target, retained AS kept FROM supplier JOIN edges ON source = s_name")
def view_one_hop(spark, d):
    return views.one_hop(_starts(spark, d), view_edges(spark, d))


@query(f"WITH {_EDGES} SELECT s_name AS start, target, retained AS kept FROM supplier JOIN edges ON source = s_name UNION SELECT s_name, 'Nothing', 1.0 FROM supplier")
def view_generic_union(spark, d):
    starts = _starts(spark, d).withColumn("variance", F.lit("+"))
    generic = spark.sql("SELECT '+' AS variance, 'Nothing' AS target UNION ALL SELECT '-', 'Any'")
    return views.one_hop(starts, view_edges(spark, d)).union(views.from_any(starts, generic)).distinct()


@query(
    f"WITH RECURSIVE {_EDGES}, walk AS (SELECT s_name AS start, s_name AS node, 1.0::DOUBLE AS kept, 0 AS depth FROM supplier "
    "UNION ALL SELECT start, target, kept * retained, depth + 1 FROM walk JOIN edges ON source = node WHERE depth < 4) "
    "SELECT start, node AS target, max(kept) AS kept FROM walk WHERE depth > 0 GROUP BY start, node"
)
def view_closure(spark, d):
    return views.closure(_starts(spark, d), view_edges(spark, d), 3)


# --- statistics -------------------------------------------------------------------------

_FREQ = f"""{_POSTINGS}, seen AS (
    SELECT DISTINCT value_id, v, name FROM (
        SELECT value_id, left(term, 1) AS v, substr(term, 2) AS name FROM postings
        UNION ALL SELECT value_id, '/', substr(term, 2) FROM postings) x)"""
_FREQ_OUT = "SELECT v AS variance, name, count(*) AS n, round(count(*) / (SELECT count(DISTINCT value_id) FROM postings)::DOUBLE, 9) AS frequency FROM seen GROUP BY v, name"


def _frequencies(spark, d) -> DataFrame:
    """Terms and invariant copies, once a value; the count of values is exact and joined as one row.

    What a value has is made distinct inside its own few rows, so that no task holds the terms of many values at once.
    """
    term = F.struct(F.left("term", F.lit(1)).alias("variance"), F.substring("term", 2, 100).alias("name"))
    values = corpus_terms(spark, d).groupBy("value_id").agg(F.collect_set(term).alias("terms"))
    both = F.array_distinct(F.flatten(F.transform("terms", lambda t: F.array(t, F.struct(F.lit("/").alias("variance"), t["name"].alias("name"))))))
    value = F.struct(F.lit("value").alias("variance"), F.lit("").alias("name"))
    counts = kept(values.select(F.explode(F.array_append(both, value)).alias("t")).groupBy("t.variance", "t.name").agg(F.count(F.lit(1)).alias("n")))
    of_values = F.col("variance").eqNullSafe("value")
    total = F.broadcast(counts.filter(of_values).select(F.col("n").alias("total")))
    return counts.filter(~of_values).crossJoin(total).select("variance", "name", "n", F.round(F.col("n") / F.col("total"), 9).alias("frequency"))


@query(
    f"WITH {_FREQ}, f AS ({_FREQ_OUT}) SELECT p_brand AS name, round(coalesce(max(frequency) FILTER (variance = '+'), 0), 9) AS f_co, round(coalesce(max(frequency) FILTER (variance = '-'), 0), 9) AS f_contra, "
    "round(coalesce(max(frequency) FILTER (variance = '/'), 0), 9) AS f_inv FROM (SELECT DISTINCT p_brand FROM part UNION SELECT 'unused') LEFT JOIN f ON name = p_brand GROUP BY p_brand"
)
def type_frequency_pivot(spark, d):
    names = table(spark, d, "part").select(F.col("p_brand").alias("name")).union(spark.sql("SELECT 'unused'")).distinct()
    frequencies = _frequencies(spark, d).withColumn("variance", F.translate("variance", "/", ""))
    return ix.pivoted(names, frequencies)


@query(
    f"WITH {_FREQ}, f AS ({_FREQ_OUT}) SELECT variance, name, round(greatest(ln(2.7 / (frequency * 2.7 + (1 - frequency))) / ln(2.7), 0.001), 6) AS itf, "
    "round(ln(2.0 / (frequency * 2.0 + 1.1 * (1 - frequency))) / ln(2.0), 6) AS neutral_itf, round(0.5 * (1 - 0.2 * 1) * greatest(ln(2.7 / (frequency * 2.7 + (1 - frequency))) / ln(2.7), 0.001), 6) AS boost, "
    "round(0.5 * (ln(2.0 / (frequency * 2.0 + 1.1 * (1 - frequency))) / ln(2.0)) * pow(1 - 0.1 * 1, 0.05), 6) AS neutral_boost FROM f"
)
def itf_boost(spark, d):
    f, half, one = F.col("frequency"), F.lit(0.5), F.lit(1)
    return _frequencies(spark, d).select("variance", "name", F.round(measures.itf(f), 6).alias("itf"), F.round(measures.neutral_itf(f), 6).alias("neutral_itf"), F.round(measures.boost(half, one, f), 6).alias("boost"), F.round(measures.neutral_boost(half, one, f), 6).alias("neutral_boost"))


@query(
    f"WITH RECURSIVE {_FREQ}, f AS ({_FREQ_OUT}), l AS (SELECT variance || name AS term, frequency, variance AS query_id, row_number() OVER (PARTITION BY variance ORDER BY n % 97 DESC, variance || name, frequency) AS k FROM f), "
    "walk AS (SELECT query_id, k, frequency < 0.8 AS kept, CASE WHEN frequency < 0.8 THEN frequency ELSE 0 END AS total, term FROM l WHERE k = 1 "
    "UNION ALL SELECT l.query_id, l.k, total + l.frequency < 0.8, CASE WHEN total + l.frequency < 0.8 THEN total + l.frequency ELSE total END, l.term FROM walk JOIN l ON l.query_id = walk.query_id AND l.k = walk.k + 1) "
    "SELECT query_id, string_agg(term, ' ' ORDER BY term) AS terms FROM walk WHERE kept GROUP BY query_id"
)
def cutoff_terms(spark, d):
    leaves = _frequencies(spark, d).select(F.col("variance").alias("query_id"), F.concat("variance", "name").alias("term"), (F.col("n") % 97).cast("double").alias("boost"), "frequency")
    return measures.below_cutoff(leaves, 0.8).select("query_id", F.array_join(F.sort_array("terms"), " ").alias("terms"))


# --- scores -----------------------------------------------------------------------------


def _scores(spark, d, tree) -> DataFrame:
    import pandas as pd

    def run(frames):
        scorer = Scorer(tree)
        for frame in frames:
            found = [scorer.score([(t["term"], t["optional"]) for t in terms]) for terms in frame["terms"]]
            yield pd.DataFrame({"value_id": frame["value_id"], "score": [x[0] for x in found], "penalty": [x[1] for x in found]})

    return corpus_values(spark, d).select("value_id", "terms").mapInPandas(run, "value_id long, score double, penalty double")


_LEAF_VALUES = ", ".join(f"('{t}', {b}::DOUBLE)" for t, b in LEAVES.items())


@query(
    f"WITH {_POSTINGS}, leaf(lterm, boost) AS (VALUES {_LEAF_VALUES}), s AS (SELECT value_id, coalesce(sum(boost), 0) AS score, "
    "round(sum(CASE WHEN boost IS NOT NULL THEN 0 WHEN optional THEN 0.1 ELSE 1 END) + 4 - count(boost), 1)::DOUBLE AS penalty "
    "FROM postings LEFT JOIN leaf ON term = lterm AND occurrence = 1 GROUP BY value_id) "
    "SELECT value_id, score, penalty, round(score / (1 + 0.1 * penalty) + 0.1 * ln((value_id % 7) + 1), 6) AS final FROM s"
)
def score_sum_query(spark, d):
    scores = _scores(spark, d, Sum(tuple(Leaf(t, boost=b) for t, b in LEAVES.items()))).withColumn("penalty", F.round("penalty", 1))
    return scores.withColumn("final", F.round(measures.final_score(F.col("score"), F.col("penalty"), F.col("value_id") % 7), 6))


def _max_scores(left: tuple[str, str], right: tuple[str, str], leaf: str) -> str:
    """SQL for score and penalty of two maxima of two terms, the better first; ``leaf``: a relation of lterm and boost."""
    best = [f"CASE WHEN bool_or(term = '{a}') THEN '{a}' WHEN bool_or(term = '{b}') THEN '{b}' END" for a, b in (left, right)]
    return f"""w AS (SELECT value_id, term, min(optional::INT) FILTER (occurrence = 1) AS loose, sum(CASE WHEN optional THEN 0.1 ELSE 1 END) AS missed FROM postings GROUP BY value_id, term),
        best AS (SELECT value_id, {best[0]} AS l, {best[1]} AS r FROM w GROUP BY value_id), leaf AS ({leaf}),
        s AS (SELECT w.value_id, sum(CASE WHEN term IN (l, r) THEN boost ELSE 0 END) AS score,
            sum(missed) - sum(CASE WHEN term IN (l, r) THEN CASE WHEN loose = 1 THEN 0.1 ELSE 1 END ELSE 0 END) + max(CASE WHEN l IS NULL THEN 1 ELSE 0 END) + max(CASE WHEN r IS NULL THEN 1 ELSE 0 END) AS penalty
            FROM w JOIN best ON w.value_id = best.value_id LEFT JOIN leaf ON term = lterm GROUP BY w.value_id)"""


_LEFT, _RIGHT = ("+Brand#11", "-Brand#22"), ("+Brand#4", "/Brand#3")
_HALF_LEAVES = "SELECT * FROM (VALUES ('+Brand#11', 1.0::DOUBLE), ('-Brand#22', 0.5), ('+Brand#4', 0.25), ('/Brand#3', 0.125)) x(lterm, boost)"


@query(f"WITH {_POSTINGS}, {_max_scores(_LEFT, _RIGHT, _HALF_LEAVES)} SELECT value_id, score, round(penalty, 1)::DOUBLE AS penalty FROM s")
def score_max_query(spark, d):
    """Two maxima of two alternatives: each takes the better term that is there, and counts as one if there is none."""
    (a, b), (c, e) = _LEFT, _RIGHT
    tree = Sum((Max((Leaf(a, boost=1.0), Leaf(b, boost=0.5))), Max((Leaf(c, boost=0.25), Leaf(e, boost=0.125)))))
    return _scores(spark, d, tree).withColumn("penalty", F.round("penalty", 1))


@query()
def score_max_tree(spark, d):
    a, b, c, e = (Leaf(t, boost=x) for t, x in LEAVES.items())
    return _scores(spark, d, Sum((Max((a, Sum((b, c)))), Max((e, c)))))


@query("SELECT o_orderkey AS value_id, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def topk_page(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("value_id"), F.col("o_totalprice").alias("score"))
    return sets.top_k(rows, 10, F.desc("score"), "value_id", offset=20)


@query(
    "SELECT lang, source, first(doc_id ORDER BY n_chars DESC, doc_id) AS best_id, max(n_chars) AS best_score, count(*) AS members, count(*) - 1 AS more FROM documents GROUP BY lang, source"
)
def group_results(spark, d):
    rows = table(spark, d, "documents").select("lang", "source", F.col("doc_id").alias("value_id"), F.col("n_chars").alias("score"))
    return sets.group_results(rows, ["lang", "source"]).select("lang", "source", F.col("best.value_id").alias("best_id"), F.col("best.score").alias("best_score"), "members", "more")


_TOKENS = (
    "words AS (SELECT id, unnest(string_split_regex(t, '[\\s.]+')) AS w FROM docs), "
    f"parts AS (SELECT id, w, unnest(list_distinct(list_concat([w], regexp_extract_all(w, '{_PARTS_SQL}')))) AS p FROM words WHERE w <> ''), tok AS (SELECT id, lower(p) AS token FROM parts)"
)


@query(
    f"WITH docs AS (SELECT doc_id AS id, text AS t FROM documents), {_TOKENS}, len AS (SELECT id, floor(f * pow(2, 2 - floor(log2(f)))) * pow(2, floor(log2(f)) - 2) AS norm FROM (SELECT id, pow(count(*) + 10, -0.25)::FLOAT::DOUBLE AS f FROM tok GROUP BY id) x), "
    f"hits AS (SELECT id, token, count(*) AS tf FROM tok WHERE token IN ({', '.join(repr(k) for k in KEYWORDS)}) GROUP BY id, token), df AS (SELECT token, count(*) AS df FROM hits GROUP BY token) "
    "SELECT hits.id AS id, round(sum(sqrt(tf) * (1 + ln((SELECT count(*) FROM documents) / (df + 1)::DOUBLE)) * (1 + ln((SELECT count(*) FROM documents) / (df + 1)::DOUBLE)) * norm), 6) AS doc_score "
    "FROM hits JOIN df USING (token) JOIN len ON len.id = hits.id GROUP BY hits.id"
)
def keyword_tfidf(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    scores = text.keyword_scores(text.keyword_counts(docs, "doc_id", F.col("text"), KEYWORDS), KEYWORDS, docs.count())
    return scores.select("id", F.round("doc_score", 6).alias("doc_score"))


@query(f"WITH docs AS (SELECT p_partkey AS id, p_name || ' some' || p_type || '.HTMLParser2x' AS t FROM part), {_TOKENS} SELECT id, token, count(*) AS tf FROM tok GROUP BY id, token")
def name_tokens(spark, d):
    named = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" some"), "p_type", F.lit(".HTMLParser2x")).alias("name"))
    return text.term_counts(named, "p_partkey", F.col("name")).select("id", "token", "tf")


@query("SELECT page_id, regexp_replace(html, '<[\\s\\S][^>]*>', '', 'g') AS body, sha256(url || chr(10) || url || chr(10) || regexp_replace(html, '<[\\s\\S][^>]*>', '', 'g') || 'since 1') AS document FROM pages")
def strip_html(spark, d):
    since = F.array(F.struct(F.lit("since").alias("key"), F.lit("<b>since 1</b>").alias("value")))
    content = text.indexable(F.col("html"), since)
    return table(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"), F.sha2(text.document(F.col("url"), content), 256).alias("document"))


# --- retrieval metrics ------------------------------------------------------------------

_RANKED = """results AS (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50),
    relevant AS (SELECT lang AS query_id, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
    ranked AS (SELECT r.query_id, r.doc_id, rank FROM relevant r LEFT JOIN results s ON r.query_id = s.query_id AND r.doc_id = s.doc_id),
    metrics AS (SELECT query_id, count(*) AS relevant, count(rank) AS found, sum(CASE WHEN rank IS NOT NULL THEN hit / rank::DOUBLE ELSE 0 END) / count(*) AS ap, count(rank) / count(*)::DOUBLE AS recall,
        count(*) FILTER (rank <= 5) / least(count(*), 5)::DOUBLE AS recall_5, count(*) FILTER (rank <= 10) / least(count(*), 10)::DOUBLE AS recall_10
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank NULLS LAST) AS hit FROM ranked) x GROUP BY query_id)"""


def _query_metrics(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("lang").alias("query_id"), "doc_id", "n_chars")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id"))
    results = docs.withColumn("rank", order).filter("rank <= 50").select("query_id", "doc_id", "rank")
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    relevant = docs.join(good, "doc_id").select("query_id", "doc_id")
    return measures.query_metrics(measures.ranks(results, relevant, ["query_id", "doc_id"]))


@query(f"WITH {_RANKED} SELECT query_id, relevant, found, round(ap, 9) AS ap, round(recall, 9) AS recall FROM metrics")
def avg_precision(spark, d):
    return _query_metrics(spark, d).select("query_id", "relevant", "found", F.round("ap", 9).alias("ap"), F.round("recall", 9).alias("recall"))


@query(f"WITH {_RANKED} SELECT query_id, round(recall_5, 9) AS recall_5, round(recall_10, 9) AS recall_10, round(found / 50.0::DOUBLE, 9) AS precision FROM metrics")
def recall_at_n(spark, d):
    m = _query_metrics(spark, d)
    return m.select("query_id", F.round("recall_5", 9).alias("recall_5"), F.round("recall_10", 9).alias("recall_10"), F.round(measures.precision(F.col("found"), F.lit(50)), 9).alias("precision"))


@query(f"WITH {_RANKED} SELECT round(avg(ap), 9) AS map, round(CASE WHEN min(ap) > 0 THEN exp(avg(ln(CASE WHEN ap > 0 THEN ap ELSE 1 END))) ELSE 0 END, 9) AS gmap, round(avg(recall_5), 9) AS mean_recall_5, round(avg(recall_10), 9) AS mean_recall_10 FROM metrics")
def map_by_query(spark, d):
    return measures.run_metrics(_query_metrics(spark, d)).select(*[F.round(c, 9).alias(c) for c in ("map", "gmap", "mean_recall_5", "mean_recall_10")])


@query("SELECT o_orderpriority AS grid, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS best_run, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderpriority")
def best_run(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("grid"), F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("map"))
    return runs.groupBy("grid").agg(measures.best_run(runs, "map").alias("best_run"), F.round(F.avg("map"), 4).alias("mean"))


@query(
    "SELECT l_returnflag AS g, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS arithmetic, round(exp(sum(l_quantity * ln(l_extendedprice)) / sum(l_quantity)), 4) AS geometric, "
    "round(sum(l_quantity) / sum(l_quantity / l_extendedprice), 4) AS harmonic FROM lineitem GROUP BY l_returnflag"
)
def weighted_means(spark, d):
    x, w = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.round(measures.arithmetic_mean(x, w), 4).alias("arithmetic"), F.round(measures.geometric_mean(x, w), 4).alias("geometric"), F.round(measures.harmonic_mean(x, w), 4).alias("harmonic"))


# --- table maintenance ------------------------------------------------------------------


@query("SELECT o_custkey AS key, o_orderkey AS last FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def upsert_keep_last(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderdate", F.col("o_orderkey").alias("last"))
    return sets.keep_last(rows, ["key"], ["o_orderdate", "last"]).select("key", "last")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new ' || c_name FROM customer WHERE c_custkey % 3 = 0")
def upsert_rows(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return sets.upsert(old, old.filter("id % 3 = 0").withColumn("name", F.concat(F.lit("new "), "name")), ["id"])


@query("SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE source LIKE '%1')")
def delete_module(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return sets.delete_matching(docs, docs.filter("source LIKE '%1'"), ["source"])


@query("SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem EXCEPT ALL SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag = 'R'")
def bag_difference(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    return sets.bag_difference(rows, rows.filter("l_returnflag = 'R'"))


@query("SELECT s_name AS name FROM supplier UNION SELECT c_name FROM customer UNION SELECT s_name FROM supplier")
def union_distinct(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return ev.merge(s, table(spark, d, "customer").select(F.col("c_name").alias("name")), s).distinct()


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch FROM orders")
def batch_numbers(spark, d):
    return sets.batches(table(spark, d, "orders").select("o_orderkey"), 1000, ["o_orderkey"])


@query("SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 500")
def sample_exact_n(spark, d):
    return sets.sample_exactly(table(spark, d, "orders").select("o_orderkey"), 500, ["o_orderkey"])


@query("SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) % 2 = 1 THEN 'train' ELSE 'test' END AS half FROM part")
def query_split(spark, d):
    train, test = sets.split_half(table(spark, d, "part").select("p_partkey"), ["p_partkey"])
    return train.withColumn("half", F.lit("train")).union(test.withColumn("half", F.lit("test")))


# --- event streams ----------------------------------------------------------------------

_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query(f"SELECT event_id, user_id FROM events QUALIFY lead(ts) OVER ({_ORDER}) IS NULL OR lead(ts) OVER ({_ORDER}) >= ts + INTERVAL 30 MINUTE")
def debounce(spark, d):
    return ev.debounce(_events(spark, d), ["user_id"], "ts", "30 minutes", ["event_id"]).select("event_id", "user_id")


@query(f"SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER ({_ORDER}) = 1 OR lag(event_type) OVER ({_ORDER}) IS DISTINCT FROM event_type")
def distinct_until_changed(spark, d):
    return ev.distinct_until_changed(_events(spark, d), ["user_id"], "ts", "event_type", ["event_id"]).select("event_id", "user_id", "event_type")


@query(
    f"WITH x AS (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS viewed, "
    f"last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS clicked FROM events) "
    "SELECT event_id, user_id, viewed, clicked FROM x WHERE event_type IN ('view', 'click') AND viewed IS NOT NULL AND clicked IS NOT NULL"
)
def combine_latest(spark, d):
    sides = {"viewed": F.when(F.col("event_type") == "view", F.col("value")), "clicked": F.when(F.col("event_type") == "click", F.col("value"))}
    return ev.combine_latest(_events(spark, d), ["user_id"], "ts", sides, ["event_id"]).select("event_id", "user_id", "viewed", "clicked")


@query(f"SELECT event_id, user_id FROM events QUALIFY row_number() OVER ({_ORDER}) > 1")
def skip_first(spark, d):
    return ev.skip_first(_events(spark, d), ["user_id"], "ts", 1, ["event_id"]).select("event_id", "user_id")


@query("SELECT doc_id, '/search?q=' || replace(url_encode(lang || ' => ' || source), '%20', '+') || '&m=' || url_encode(source) AS link FROM documents")
def search_links(spark, d):
    q = F.concat("lang", F.lit(" => "), "source")
    return table(spark, d, "documents").select("doc_id", text.link(F.lit("/search"), q=q, m=F.col("source")).alias("link"))


# --- scalar functions and predicates ----------------------------------------------------


@query(
    "SELECT p_partkey, p_type || '[' || p_brand || '_, ' || p_brand || '_]' AS from_key, CASE WHEN p_size % 3 = 0 THEN 0.6667 ELSE 1.0 END::DOUBLE AS kept, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 END AS distance FROM part"
)
def view_keys(spark, d):
    """Keys, retained information and distance of views between made-up types with two parameters."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")

    def node(v, name, arity, param):
        return F.struct(v.alias("variance"), name.alias("name"), F.lit(arity).alias("arity"), F.lit(param).alias("is_param"))

    none = F.lit("")
    source = F.array(node(none, F.col("p_type"), 2, False), node(F.col("p_brand"), F.lit("A"), 0, True), node(F.col("p_brand"), F.lit("B"), 0, True))
    other = F.when(F.col("p_size") % 5 == 0, F.col("p_type")).otherwise(F.lit("Other"))
    both = F.array(node(none, other, 2, False), node(none, F.lit("A"), 0, True), node(none, F.lit("B"), 0, True))
    one = F.array(node(none, other, 1, False), node(none, F.lit("A"), 0, True))
    keyed = ix.with_view_keys(part.select("*", source.alias("source"), F.when(F.col("p_size") % 3 == 0, one).otherwise(both).alias("target")))
    kept = F.round(views.retained(F.col("source"), F.col("target")), 4)
    same = (F.col("source")[0]["name"] == F.col("target")[0]["name"]) & (F.col("source")[0]["variance"] == F.col("target")[0]["variance"])
    return keyed.select("p_partkey", "from_key", kept.alias("kept"), F.when(same, 0).otherwise(1).alias("distance"))


# --- flagship ---------------------------------------------------------------------------


def _search(spark, d, n: int) -> DataFrame:
    """A whole search over the corpus: candidates below the frequency cutoff, scores, the best ``n``."""
    from .operators.search import ranked
    from .plans.expansion import leaves, weigh
    from .settings import QuerySettings

    values = corpus_values(spark, d).persist()
    tree = Sum((Max((Leaf("+Brand#11", 0.5), Leaf("+Brand#12", 0.25, 1))), Max((Leaf("-Brand#22", 0.5), Leaf("-Brand#23", 0.25, 1)))))
    asked = sorted({x.term for x in leaves(tree)})
    holds = [F.count_if(F.array_contains("terms.term", k)).alias(f"n{i}") for i, k in enumerate(asked)]
    counts = values.agg(F.count(F.lit(1)).alias("total"), *holds).first()
    frequency = {k: counts[f"n{i}"] / max(counts["total"], 1) for i, k in enumerate(asked)}
    tree = weigh(tree, frequency.__getitem__)
    postings = values.select("value_id", "module_id", F.explode("terms.term").alias("term"))
    found = ranked(values, postings, tree, None, None, QuerySettings(max_results=n), n)
    return found.select("value_id", "module_id", F.round(F.col("score").cast("double"), 4).alias("score"))


_ITF = "greatest(ln(2.7 / (f * 2.7 + (1 - f))) / ln(2.7), 0.001)"

_SCORED = (
    f"WITH {_POSTINGS}, total AS (SELECT count(DISTINCT value_id) AS total FROM postings), asked(term, share) AS (VALUES ('+Brand#11', 0.5::DOUBLE), ('+Brand#12', 0.2), ('-Brand#22', 0.5), ('-Brand#23', 0.2)), "
    f"weights AS (SELECT term AS lterm, share * {_ITF} AS boost FROM (SELECT asked.term, share, count(DISTINCT value_id) / any_value(total)::DOUBLE AS f FROM asked LEFT JOIN postings ON asked.term = postings.term, total GROUP BY asked.term, share) x), "
    f"{_max_scores(('+Brand#11', '+Brand#12'), ('-Brand#22', '-Brand#23'), 'SELECT * FROM weights')}, m AS (SELECT value_id, any_value(module_id) AS module_id FROM postings GROUP BY value_id) "
    "SELECT value_id, module_id, round(score / (1 + 0.1 * penalty::DOUBLE), 4) AS score FROM s JOIN m USING (value_id) WHERE score > 0"
)


@query(_SCORED)
def search_scored(spark, d):
    """All results of the search, not only the best."""
    return _search(spark, d, 1 << 30)


@query(f"{_SCORED} ORDER BY score DESC, value_id LIMIT 100")
def search_ranked(spark, d):
    return _search(spark, d, 100)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return search_ranked(spark, d)
