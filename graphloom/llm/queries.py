"""The thin queries of the corpus operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, media, mixing, packing, quality, sharding, simhash, topk, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": lambda s, d: simhash.near_duplicates(_documents(s, d)).select("doc_id", "fingerprint", "component_id"),
    "op2_media": lambda s, d: media.media_columns(_documents(s, d)),
    "op3_sharding": lambda s, d: sharding.shard(_documents(s, d)),
    "op4_toxicity": lambda s, d: toxicity.score(_documents(s, d), _table(s, d, "labels")),
    "op5_licenses": lambda s, d: licenses.scan(_documents(s, d)),
    "op6_urlfilter": lambda s, d: urlfilter.judge(_table(s, d, "pages")),
    "op7_packing": lambda s, d: packing.pack(_documents(s, d)),
    "op8_topk": lambda s, d: topk.top_k(_table(s, d, "embeddings")),
    "op9_mixing": lambda s, d: mixing.mix(_documents(s, d)),
    "op10_quality": lambda s, d: quality.score(_documents(s, d), _table(s, d, "labels")),
}

ORACLE_SQL: dict[str, str] = {
    "op6_urlfilter": r"""
        WITH u AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END, '(?s)^[^/?#]*(/[^?#]*)', 1) AS path
            FROM pages),
        r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        m AS (
            SELECT page_id, host, path, max_by(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) AS best
            FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
        SELECT u.page_id, u.host, u.path, m.best.rule AS rule, coalesce(m.best.verdict, 'allow') AS verdict
        FROM u LEFT JOIN m ON u.page_id = m.page_id AND u.host = m.host AND u.path = m.path""",
    "op8_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, least(len(q.x), len(c.x)) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM p QUALIFY rank <= 20""",
}
