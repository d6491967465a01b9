"""Queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusflow.llm import mixing, packing, pii, quality, secrets, simhash, topk, toxicity, vptree, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect_pii(_table(spark, sf_dir, "documents"))


def op2_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(_table(spark, sf_dir, "embeddings"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(_table(spark, sf_dir, "embeddings"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op4_result(_table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op6_result(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op7_result(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_vptree, op3_topk, op4_warc, op5_quality, op6_simhash, op7_mixing, op8_secrets, op9_packing, op10_toxicity)}

_OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP4 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""

#: Matches and what is between them alternate, so running sums of their lengths are positions.
_OP8 = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS text FROM documents),
k AS (
  SELECT n, 0 AS kind, 'assign' AS name, 6 AS least, text FROM t
  UNION ALL SELECT n, 1, 'access', 20, text FROM t
  UNION ALL SELECT n, 2, 'hex', 24, text FROM t
),
m AS (
  SELECT n, kind, name, least,
    CASE kind WHEN 0 THEN regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0)
      WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) ELSE regexp_extract_all(text, '[0-9a-f]+', 0) END AS whole,
    CASE kind WHEN 0 THEN regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)
      WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) ELSE regexp_extract_all(text, '[0-9a-f]+', 0) END AS part,
    CASE kind WHEN 0 THEN regexp_split_to_array(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 1 THEN regexp_split_to_array(text, 'AKIA[A-Z0-9]+') ELSE regexp_split_to_array(text, '[0-9a-f]+') END AS gap
  FROM k
),
r AS (
  SELECT n, kind, name, least, unnest(range(1, len(whole) + 1)) AS i, whole, part, gap FROM m WHERE len(whole) > 0
),
s AS (
  SELECT n, kind, name, least, length(part[i]) AS size, length(whole[i]) AS width,
    CAST(sum(length(gap[i]) + length(whole[i])) OVER (PARTITION BY n, kind ORDER BY i) AS BIGINT) AS "end"
  FROM r
),
f AS (
  SELECT n,
    count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || ("end" - width) || ':' || "end", ',' ORDER BY "end" - width, kind) AS spans
  FROM s WHERE size >= least GROUP BY n
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN f USING (n)
"""

ORACLE_SQL = {"op3_topk": _OP3, "op4_warc": _OP4, "op8_secrets": _OP8}
