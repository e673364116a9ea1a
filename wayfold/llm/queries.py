"""The registered queries of the llm operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, packing, quality_model, quality_rules, shards, shared, simhash, token_counts, token_files, url_trust, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.filter_urls(_table(spark, sf_dir, "pages"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends all documents in four arrivals, compacts, and reads the newest version back."""
    store = shards.ShardStore(spark, shared.scratch(spark, "shards"))
    store.append_arrivals(_table(spark, sf_dir, "documents"), shards.ARRIVALS)
    store.compact()
    return store.read().select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.scratch(spark, "warc")
    return warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages"), folder), folder)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.scratch(spark, "token-archive")
    return token_files.token_file_digests(token_files.write_token_files(_table(spark, sf_dir, "documents"), folder), folder)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, radius=4)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).drop("ids")


def queries() -> dict[str, Query]:
    return {
        "op1_url_trust": op1_url_trust,
        "op6_shards": op6_shards,
        "op7_warc": op7_warc,
        "op2_decontaminate": op2_decontaminate,
        "op10_quality_model": op10_quality_model,
        "op3_token_files": op3_token_files,
        "op4_simhash": op4_simhash,
        "op5_quality_rules": op5_quality_rules,
        "op8_token_counts": op8_token_counts,
        "op9_packing": op9_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_shards": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5, lang, source, n_chars FROM documents",
        "op7_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
            d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
            g AS (SELECT payload_digest, max(page_id) AS target FROM d WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN target IS NOT NULL AND target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN target <> page_id THEN target END AS refers_to
            FROM d LEFT JOIN g USING (payload_digest)""",
    }
