"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import chat, decontaminate, filter_audit, language_model, licences, media, near_dup, packing, quality, substring_dedup, token_counts, toxicity, va_clusters

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PATH = "coalesce(source, '') || '/' || coalesce(lang, '') || '/' || coalesce(cast(doc_id AS {text}), '')"


def op1_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths are source/lang/doc_id."""
    files = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(PATH.format(text="string")).alias("path"), "text")
    return licences.licence_scan(files).withColumnRenamed("id", "doc_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_conversations(turns.unionByName(probe)))


def toxicity_machine(spark: SparkSession, sf_dir: str) -> toxicity.Machine:
    return toxicity.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), usable=~toxicity.held_out())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), toxicity_machine(spark, sf_dir))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.CumulativeLink:
    """Grades: 0 poor, 1 usable but toxic, 2 good."""
    grade = F.col("quality") * (F.lit(2) - F.coalesce("toxic", F.lit(0)))
    return quality.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), grade, n_grades=3, usable=~toxicity.held_out())


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(filter_audit.failure_masks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")), "ABCDE")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_clusters.centroid_clusters(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "pipeline": pipeline,
    "op1_licence_scans": op1_licence_scans,
    "op2_token_counts": op2_token_counts,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_toxicity": op5_toxicity,
    "op8_quality_classifier": op8_quality_classifier,
    "op6_media_columns": op6_media_columns,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_decontamination": op10_decontamination,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_filter_interaction_audit": op12_filter_interaction_audit,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLE_SQL: dict[str, str] = {
    "op11_substring_dedup": substring_dedup.ORACLE_SQL,
    "op12_filter_interaction_audit": filter_audit.ORACLE_SQL,
    "op13_centroid_clusters": va_clusters.oracle_sql(),
    "op1_licence_scans": licences.oracle_sql("documents", PATH.format(text="varchar")),
    "op4_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, coalesce(role <> lag(role) OVER w, true) AS opens,
    length(regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>)|(\[)(/?INST\])', '\1\3~\2\4', 'g')) AS text_chars,
    length(regexp_replace(replace(role, '\', '\\'), '(<)(\||/?s>)|(\[)(/?INST\])', '\1\3~\2\4', 'g')) AS role_chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN opens THEN role_chars + 12 + 11 + 10 ELSE 10 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
""",
}
