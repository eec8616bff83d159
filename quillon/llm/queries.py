"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import _base, chat, exact_dedup, fertility, lang_id, lm_score, near_dedup, packing, piece_codec, quality, token_file


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_documents(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(_documents(spark, sf_dir))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(_documents(spark, sf_dir), back=True)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), length=packing.token_lengths("text"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.all_duplicates(_documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir))


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(_documents(spark, sf_dir))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.write(_documents(spark, sf_dir), _base.new_path(spark, "token_ids"))


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # lies beside the package and imports it

    ops = (op1_lm_score, op2_near_dedup, op3_piece_codec, op4_chat_format, op5_packing, op6_exact_dedup, op7_quality, op8_fertility, op9_token_file, op10_lang_id)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_format": """
            WITH t AS (
              SELECT conv_id, turn, role, text,
                '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS part,
                length('<|im_start|>' || role || chr(10)) AS head, length(text || '<|im_end|>') AS body
              FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)),
            p AS (
              SELECT *, sum(length(part)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - length(part) + head AS s FROM t)
            SELECT conv_id, count(*) AS n_turns, string_agg(part, '' ORDER BY turn, role, text) AS text,
              coalesce(string_agg(CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + body AS BIGINT) AS VARCHAR), ',' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS spans,
              CAST(NULL AS VARCHAR) AS error
            FROM p GROUP BY conv_id""",
        "op6_exact_dedup": """
            WITH m AS (SELECT (min(doc_id) + max(doc_id)) // 2 AS mid FROM documents),
            k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keeper FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
            SELECT DISTINCT doc_id, keeper, CASE WHEN keeper <= mid THEN 'snapshot' ELSE 'batch' END AS origin FROM k, m WHERE keeper <> doc_id""",
    }
