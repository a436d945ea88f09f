"""The queries of the training-data operators, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.llm import best_fit
from marlpit.llm import filter_audit
from marlpit.llm import sort_means
from marlpit.llm import token_counts as tokens
from marlpit.llm import packing
from marlpit.llm import secret_scan
from marlpit.llm import sharding
from marlpit.llm import mixing
from marlpit.llm import fingerprints as prints
from marlpit.llm import quality
from marlpit.llm import near_dedup
from marlpit.llm import top_k
from marlpit.llm import language_id
from marlpit.llm.common import table


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), limit=4096)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=24)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints.fingerprints(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_windows(table(spark, sf_dir, "documents"), capacity=2048)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.sort_means(table(spark, sf_dir, "embeddings"), k=8, rounds=10, width=64, scale=1024.0, seed=3)


QUERIES = {
    "op11_packing": op11_packing,
    "op12_filter_audit": op12_filter_audit,
    "op13_clustering": op13_clustering,
    "op6_language_id": op6_language_id,
    "op8_top_k": op8_top_k,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality": op10_quality,
    "op1_fingerprints": op1_fingerprints,
    "op7_mixing": op7_mixing,
    "op4_sharding": op4_sharding,
    "op2_secret_scan": op2_secret_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op5_token_counts": op5_token_counts,
}


def clustering_round(number: int) -> str:
    """SQL of one round: assignments a, then means c, of a number."""
    return f"""
        , a{number} AS MATERIALIZED (
            SELECT uid, any_value(vec_id) AS vec_id, any_value(e) AS e, min({{'d': list_sum(list_transform(list_zip(e, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c}}) AS best
            FROM v CROSS JOIN c{number - 1} GROUP BY uid
        ), s{number} AS (
            SELECT c, list((total - ((total % n) + n) % n) // n ORDER BY place) AS m FROM (
                SELECT c, place, sum(x)::BIGINT AS total, count(*) AS n FROM (SELECT best.c AS c, unnest(e) AS x, generate_subscripts(e, 1) AS place FROM a{number}) GROUP BY c, place
            ) GROUP BY c
        ), c{number} AS MATERIALIZED (
            SELECT c, coalesce(s{number}.m, c{number - 1}.m) AS m FROM c{number - 1} LEFT JOIN s{number} USING (c)
        )"""


ORACLE_SQL: dict[str, str] = {
    "op12_filter_audit": """
        WITH texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
            FROM documents
        ), masked AS (
            SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
                + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
            FROM texts
        ), said AS (
            SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id
        ), counted AS (
            SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masked LEFT JOIN said USING (doc_id) GROUP BY part, mask
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters AS a, letters AS b, letters AS c, letters AS d, letters AS e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), places AS (
            SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS letter, 1 << (ascii(letter) - 65) AS own,
                coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))), 0)::INT AS earlier
            FROM orders, generate_series(1, 5) AS g(step)
        ), outcomes AS (
            SELECT part, filter_order, step, letter,
                sum(CASE WHEN mask & own = 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN mask & own > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM counted, places GROUP BY part, filter_order, step, letter
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
        FROM outcomes""",
    "op13_clustering": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INT AS c, e AS m FROM v
            QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= 8
        )"""
    + "".join(map(clustering_round, range(1, 12)))
    + """
        , said AS (
            SELECT vec_id, best.c AS cluster, best.d AS distance FROM a11
        )
        SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
            (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM said JOIN c10 ON cluster = c""",
    "op8_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored
        ) WHERE rank <= 5""",
}
