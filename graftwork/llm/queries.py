"""The queries of the ten operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graftwork.llm import decontaminate, embeddup, langid, lm, mixing, neardup, secrets, tokens, toxicity, warc
from graftwork.storage import new_path, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddup.classes(table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_warc_source, op3_embedding_near_dedup, op4_decontamination, op5_source_mixing, op6_lm_scoring, op7_language_id, op8_secret_scan, op9_minhash_near_dedup, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_source": "SELECT page_id, url, 200::BIGINT AS http_status, strlen(html)::BIGINT AS bytes, md5(html) AS md5 FROM pages",
        "op3_embedding_near_dedup": """
            WITH RECURSIVE ok AS (
                SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
                WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, e -> e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, e -> e <> 0)) > 0),
            near AS (SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
            reach(a, b) AS (SELECT DISTINCT vec_id, vec_id FROM ok UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a)
            SELECT a AS vec_id, min(b) AS class_id, count(*)::BIGINT AS members FROM reach GROUP BY a""",
    }
