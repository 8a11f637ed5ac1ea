"""Explicit schemas of the engine's tables; nothing is inferred."""

CHUNK = "chunk_id string not null, source string, content string, chunk_index int, token_count int"
CHUNK_EMBEDDINGS = "chunk_id string not null, source string not null, content string not null, chunk_index int not null, embedding array<float> not null, token_count int, ingested_at timestamp"
RETRIEVED = "chunk_id string, content string, source string, bm25_score double, vector_score double, rrf_score double, rerank_score double, pre_rerank_position int, post_rerank_position int"
CACHE = "cache_key string not null, query string, answer string, embedding array<float>, faithfulness double, answer_relevancy double, context_groundedness double, composite_score double, strategy string, correction_attempts int, hit_count bigint, created_at timestamp, expires_at timestamp"
TRACES = "session_id string not null, step int, node_name string, status string, started_at timestamp, duration_ms double, summary string, detail string"
INGESTED = "doc_id string not null, filename string, chunk_count int, file_size_bytes bigint, indexed_at timestamp"
EVAL_RUNS = "job_id string not null, status string, progress int, total int, aggregate string, results string, started_at timestamp, completed_at timestamp"
BENCHMARK = "query string, expected_strategy string, category string, ground_truth_keywords array<string>, should_trigger_correction boolean"
EVAL_RESULT = "query string, category string, expected_strategy string, actual_strategy string, faithfulness double, answer_relevancy double, context_groundedness double, composite_score double, correction_attempts int, served_from_cache boolean, latency_ms double, is_complete boolean, keyword_hit_rate double, error string"

#: Table name, schema, key.
TABLES = {"chunk_embeddings": (CHUNK_EMBEDDINGS, "chunk_id"), "pipeline_traces": (TRACES, "session_id"), "ingested_documents": (INGESTED, "doc_id"), "eval_runs": (EVAL_RUNS, "job_id"), "answer_cache": (CACHE, "cache_key")}


def create_tables(spark, database: str = "default") -> None:
    """``CREATE TABLE IF NOT EXISTS`` for each table, as Parquet."""
    for name, (schema, _) in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet")


def drop_tables(spark, database: str = "default") -> None:
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
