"""Input frames of the queries, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.col("text").alias("content"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an evaluated answer: scores from its id, null where a critic's reply could not be read."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    part = lambda m: (i * m % 101).cast("double") / 100.0
    return e.select(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        "value",
        F.when(i % 13 == 0, F.lit(None)).otherwise(part(37)).alias("faithfulness"),
        part(53).alias("answer_relevancy"),
        part(71).alias("context_groundedness"),
        (i % 4).cast("int").alias("attempts"),
        (i % 7 == 0).alias("cached"),
        (i % 3 == 0).alias("web_used"),
        (i % 5 == 0).alias("decomposed"),
        (i % 6).cast("int").alias("n_chunks"),
        F.element_at(F.array(*map(F.lit, ("factual", "abstract", "time_sensitive", "multi_hop"))), (i % 4 + 1).cast("int")).alias("query_type"),
    )


#: The same frame in DuckDB.
SCORES_SQL = """
SELECT event_id, user_id, event_type, ts, value,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id * 37 % 101)::DOUBLE / 100e0 END AS faithfulness,
  (event_id * 53 % 101)::DOUBLE / 100e0 AS answer_relevancy, (event_id * 71 % 101)::DOUBLE / 100e0 AS context_groundedness,
  (event_id % 4)::INT AS attempts, event_id % 7 = 0 AS cached, event_id % 3 = 0 AS web_used, event_id % 5 = 0 AS decomposed,
  (event_id % 6)::INT AS n_chunks, ['factual', 'abstract', 'time_sensitive', 'multi_hop'][event_id % 4 + 1] AS query_type
FROM events
"""
