"""The registered opN_<name> queries: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatium.llm import op1_bpe, op2_quality, op3_hnsw, op4_lm, op5_langid, op6_topk, op7_urls, op8_mixing, op9_warc, op10_simhash
from collatium.llm.common import cut, table


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op1_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op2_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    scored = op2_quality.score(docs, op2_quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "score", "text_score", "meta_score", (F.col("score") >= op2_quality.THRESHOLD).alias("keep"))


def op3_hnsw_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op4_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op4_lm.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", *[F.round(c, 3).alias(c) for c in ("log_score", "mean_score", "held_out_score")])


def op5_fused_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = op5_langid.fit(docs, "doc_id", "text", "lang")
    rows = op5_langid.page_rows(table(spark, sf_dir, "pages"))
    slim = lambda found: cut(found.drop("text"))
    return op5_langid.identify(rows, model, "text", F.col("declared"), F.col("host"), hold=slim).select("page_id", "host", "declared", "language", "confidence", "accepted")


def op6_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_topk.largest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


#: (verdict, host, path), as the contract of the registered query has them.
URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return op7_urls.judge(pages, op7_urls.seeded(pages), rules=URL_RULES)


def op8_ipf_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_mixing.mix(table(spark, sf_dir, "documents"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op9_warc.resolve(op9_warc.page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    h = F.col("headers")
    return found.select("record_id", "canonical", F.unix_seconds("ts").alias("seconds"), "original_id", "status", h["content-length"].alias("content_length"), h["cache-control"].alias("cache_control"), h["etag"].alias("etag"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_simhash.fingerprint_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_roundtrip, op2_cotrained_quality, op3_hnsw_nearest, op4_backoff_scores, op5_fused_language, op6_pivot_topk, op7_url_rules, op8_ipf_mixing, op9_warc_revisits, op10_simhash_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op4_backoff_scores": op4_lm.oracle(), "op6_pivot_topk": OP6_SQL, "op7_url_rules": op7_urls.oracle(), "op8_ipf_mixing": op8_mixing.oracle(), "op9_warc_revisits": op9_warc.ORACLE}
