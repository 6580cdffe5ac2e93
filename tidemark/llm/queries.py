"""The numbered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import (
    ann, byte_bpe, conversation_repair, fill_in_middle, jaccard_join, mixing, quality_outliers, secrets, simhash_dedup, substring_dedup, suffix_dedup, toxicity, warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The number of factors follows from the parse's blocks; it is no digest of the result.
    return substring_dedup.remove_repeats(spark, table(spark, sf_dir, "documents")).drop("n_factors")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), remembered=700_000)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score_toxicity(spark, table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_classes(spark, table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(spark, table(spark, sf_dir, "embeddings"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.label_weights(table(spark, sf_dir, "labels"))
    return mixing.mix_sizes(spark, table(spark, sf_dir, "documents"), weights).drop("copies")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_long_repeats(spark, table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, sf_dir, "pages")).drop("record_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_outliers.quality_rules(spark, table(spark, sf_dir, "documents"))
    return judged.withColumn("distance2", F.round("distance2", 6))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(spark, table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scans": op2_secret_scans,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_source_mixing": op7_source_mixing,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_simhash_dedup": op11_simhash_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), e AS (
          SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d
        ), k AS (
          SELECT doc_id, n, word, p,
                 string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g
          FROM e
        ), f AS (
          SELECT md5(g) AS g, min(doc_id) AS first_id FROM k WHERE p <= n - 12 GROUP BY 1
        ), starts AS (
          SELECT k.doc_id, k.p FROM k JOIN f ON md5(k.g) = f.g WHERE p <= n - 12 AND first_id < k.doc_id
        ), removed AS (
          SELECT DISTINCT doc_id, p + j AS p FROM starts, range(13) AS r(j)
        ), kept AS (
          SELECT e.doc_id, count(r.p) AS n_removed, string_agg(CASE WHEN r.p IS NULL THEN word END, ' ' ORDER BY e.p) AS text
          FROM e LEFT JOIN removed r ON r.doc_id = e.doc_id AND r.p = e.p GROUP BY e.doc_id
        )
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op9_warc": """
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS html,
                 max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response_id
          FROM pages
        ), h AS (
          SELECT *, sha1(html) AS hex FROM p
        ), bits AS (
          SELECT *, list_aggregate(list_transform(range(32), lambda i: substr(
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
              1 + CAST((
                ((strpos('0123456789abcdef', substr(hex, 1 + (i * 5) // 4, 1)) - 1) * 16
                 + (CASE WHEN (i * 5) // 4 + 2 > 40 THEN 0 ELSE strpos('0123456789abcdef', substr(hex, 2 + (i * 5) // 4, 1)) - 1 END))
                // CAST(pow(2, 3 - (i * 5) % 4) AS INTEGER)) % 32 AS INTEGER), 1)), 'string_agg', '') AS b32
          FROM h
        )
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, b32 AS payload_digest,
               CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = response_id THEN NULL ELSE response_id END AS refers_to
        FROM bits
    """,
    "op13_fill_in_middle": """
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
        ), g AS (
          SELECT doc_id, text, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
                 CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS e
          FROM d
        ), f AS (
          SELECT doc_id, text, n, least(a, b) AS low, greatest(a, b) AS high,
                 CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain'
                      WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form
          FROM g
        ), p AS (
          SELECT *, substring(text, 1, low) AS prefix, substring(text, low + 1, high - low) AS middle, substring(text, high + 1) AS suffix FROM f
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(low AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(high - low AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
}
