"""The training-data queries, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .context_mixing import context_mixing_scores
from .digest_index import exact_dedup
from .hash_tree import shard_report
from .html_text import extract_text
from .langid import language_of
from .mixing import mix_report
from .packing import best_fit_packing
from .pii import personal_data
from .quality import quality_scores
from .shared import table
from .simhash import simhash_near_duplicates
from .sort_means import sort_means
from .token_alignment import token_alignment

#: Where the vocabulary files are, on every machine.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
from .stable_projection import nearest


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing_scores(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


def op13_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_html_text, op3_language, op4_mixing, op5_packing, op6_quality, op7_personal_data, op8_context_mixing, op9_exact_dedup, op10_nearest, op11_sort_means,
        op12_token_alignment, op13_hash_tree,
    )
}


def _means_sql(rounds: int = 10) -> str:
    """Every round assigns by distance to all centroids, and takes exact floored means."""
    parts = [
        """
        kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT 8))"""
    ]
    for i in range(rounds + 1):
        parts.append(f"""
        d{i} AS (
            SELECT r, k.v, c, list_sum(list_transform(list_zip(k.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k, c{i}),
        a{i} AS MATERIALIZED (SELECT r, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY r)""")
        if i < rounds:
            parts.append(f"""
        s{i} AS (
            SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY c, j),
        m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{i} GROUP BY c),
        c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))""")
    return f"""
        WITH {",".join(parts)}
        SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN kept USING (r) JOIN c{rounds} z ON z.c = a.c
    """


SQL = {
    # Slot k stands at the golden-ratio point and takes the next block of its source in the order of the hash; slots that
    # a source lacks at the end follow the schedule.
    "op4_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
        c AS (
            SELECT *, i % 3 + 1 AS w, 3 * source_size / (i % 3 + 1)::DOUBLE AS r,
                   coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / (i % 3 + 1)::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                   sum(i % 3 + 1) OVER (ORDER BY 3 * source_size / (i % 3 + 1)::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
                   sum(source_size) OVER () AS total FROM s),
        l AS (SELECT (total - before) / rest::DOUBLE AS level FROM c WHERE r >= (total - before) / rest::DOUBLE ORDER BY r, source NULLS LAST LIMIT 1),
        t AS (SELECT i, source, source_size, least(3 * source_size, level * w)::DOUBLE AS target, round(least(3 * source_size, level * w))::BIGINT AS want FROM c, l),
        m AS (SELECT sum(want)::BIGINT AS total, greatest(1, sum(want)::BIGINT // 262144) AS block FROM t),
        e AS (
            SELECT t.*, block, (source_size + block - 1) // block AS blocks, total,
                   coalesce(sum(want) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / total::DOUBLE AS low,
                   CASE WHEN i = max(i) OVER () THEN 1.0 ELSE sum(want) OVER (ORDER BY i) / total::DOUBLE END AS high
            FROM t, m),
        points AS (SELECT k, ((k + 0.5) * 0.6180339887498949::DOUBLE) % 1.0 AS point FROM m, range((total + block - 1) // block) x(k)),
        slots AS (SELECT k, i, row_number() OVER (PARTITION BY i ORDER BY k) - 1 AS rank FROM points JOIN e ON low <= point AND point < high),
        given AS (SELECT i, max(rank) + 1 AS next FROM slots GROUP BY i),
        closing AS (
            SELECT (total + block - 1) // block + (rank - coalesce(next, 0)) * (SELECT count(*) FROM t) + e.i AS k, e.i, rank
            FROM e LEFT JOIN given USING (i), range(coalesce(next, 0), (want // source_size) * blocks + (want % source_size + block - 1) // block) x(rank) WHERE source_size > 0),
        taken_slots AS (
            SELECT k, x.i, rank % blocks AS b, want - (rank // blocks) * source_size AS stop
            FROM (SELECT k, i, rank FROM slots UNION ALL SELECT k, i, rank FROM closing) x JOIN e ON e.i = x.i WHERE source_size > 0),
        o AS (
            SELECT doc_id, size, source_size, target, i, block,
                   sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id || ':42'), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS lo
            FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
        pieces AS (
            SELECT doc_id, k, least(lo + size, (y.b + 1) * block, stop) - greatest(lo, y.b * block) AS length
            FROM o, range((lo // block)::BIGINT, ((lo + size - 1) // block + 1)::BIGINT) y(b) JOIN taken_slots z ON z.i = o.i AND z.b = y.b WHERE size > 0),
        p AS (SELECT doc_id, sum(length)::BIGINT AS taken, min(k)::BIGINT AS first_slot, count(*) AS n_slots FROM pieces WHERE length > 0 GROUP BY doc_id)
        SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot, coalesce(n_slots, 0) AS n_slots
        FROM o LEFT JOIN p USING (doc_id)
    """,
    "op9_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op11_sort_means": _means_sql(),
    # Draws of the regions, of the racks in the region that won, and of the shards in the rack; the ninth shard is a region.
    # The checksum is taken over all bytes with a table made from its polynomial.
    "op13_hash_tree": r"""
        WITH bits AS (
            SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS t
            FROM range(256) x(b)),
        d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(strlen(text), 0) + 1 AS size,
                   xor(list_reduce(
                       list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
                       lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
            FROM documents, bits),
        nodes(level, node, up, weight) AS (VALUES
            (0, '0', '', 4), (0, '1', '', 4), (0, 'new8', '', 1),
            (1, '0/0', '0', 2), (1, '0/1', '0', 2), (1, '1/0', '1', 2), (1, '1/1', '1', 2),
            (2, '0/0/0', '0/0', 1), (2, '0/0/1', '0/0', 1), (2, '0/1/2', '0/1', 1), (2, '0/1/3', '0/1', 1),
            (2, '1/0/4', '1/0', 1), (2, '1/0/5', '1/0', 1), (2, '1/1/6', '1/1', 1), (2, '1/1/7', '1/1', 1)),
        draws AS (
            SELECT r, level, node, up, ln((('0x' || left(md5(k || ':' || node), 13))::BIGINT + 0.5) / 4503599627370496::DOUBLE) / weight AS draw FROM d, nodes),
        region AS (SELECT r, arg_max(node, draw) FILTER (node <> 'new8') AS region, arg_max(node, draw) AS grown FROM draws WHERE level = 0 GROUP BY r),
        rack AS (SELECT r, arg_max(node, draw) AS rack FROM draws JOIN region USING (r) WHERE level = 1 AND up = region GROUP BY r),
        shard AS (SELECT r, arg_max(node, draw) AS node FROM draws JOIN rack USING (r) WHERE level = 2 AND up = rack GROUP BY r),
        placed AS (
            SELECT d.*, split_part(node, '/', 3)::INT AS shard, CASE WHEN grown = 'new8' THEN 8 ELSE split_part(node, '/', 3)::INT END AS grown_shard,
                   region, split_part(node, '/', 2) AS rack
            FROM d JOIN region USING (r) JOIN shard USING (r))
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, size, text_crc32) - 1 AS slot,
               grown_shard, region, rack
        FROM placed
    """,
}
