"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.simhash_dedup import simhash_components

    found = simhash_components(_table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), length=35).withColumnRenamed("id", "doc_id")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.mixing import mix

    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), "source", F.col("mix_times").alias("times"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.quality_rules import judge

    judged = judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep_text=False)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in counts], F.round("q_distance", 6).alias("distance"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.topk_search import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.toxicity import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.line_dedup import dedup_lines

    done = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("line_count").alias("n_lines"), F.size("line_removed").alias("n_removed"), F.concat_ws(",", F.col("line_removed").cast("array<string>")).alias("removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.lm_scoring import score

    return score(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.chat_format import conversation_calls, link_calls, schema_table

    calls, results = conversation_calls(_table(spark, sf_dir, "conversations"))
    linked = link_calls(calls, results, schema_table(spark, {"answer": {"question": "string", "turn": "integer"}}))
    return linked.select(F.col("conv").alias("conv_id"), F.col("seq").cast("long").alias("seq"), "call_id", "status", F.col("n_results").cast("long").alias("n_results"), F.size("errors").cast("long").alias("n_errors"), "json")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_topk": op3_topk,
    "op4_chat": op4_chat,
    "op5_likelihood": op5_likelihood,
    "op6_substrings": op6_substrings,
    "op7_lines": op7_lines,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {
    "op4_chat": """
        WITH t AS (
            SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS)
                       OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS asked
            FROM conversations
        ), calls AS (
            SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id, text FROM t WHERE role = 'user'
        ), results AS (
            SELECT conv_id, CASE WHEN asked IS NULL THEN 'none-' || conv_id || '-' || turn ELSE 'call-' || conv_id || '-' || asked END AS call_id,
                   min(turn) AS turn, count(*) AS n, min_by(text, turn) AS content
            FROM t WHERE role = 'assistant' GROUP BY 1, 2
        ), j AS (
            SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS pos,
                   CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.n IS NULL THEN 'open' ELSE 'linked' END AS status,
                   coalesce(r.n, 0) AS n_results,
                   '{"arguments":' || CASE WHEN c.call_id IS NULL THEN 'null'
                        ELSE '{"question":' || CAST(to_json(c.text) AS VARCHAR) || ',"turn":' || c.turn || '}' END
                   || ',"id":' || CAST(to_json(coalesce(c.call_id, r.call_id)) AS VARCHAR)
                   || ',"name":' || CASE WHEN c.call_id IS NULL THEN 'null' ELSE '"answer"' END
                   || ',"result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}' AS json
            FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
        )
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY status = 'orphan', pos, call_id) AS seq, call_id, status,
               n_results, CAST(0 AS BIGINT) AS n_errors, json
        FROM j
    """,
    "op3_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, d.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v d ON q.vec_id <> d.vec_id
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
    """,
}
