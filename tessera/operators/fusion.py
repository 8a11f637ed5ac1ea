"""Reciprocal-rank fusion, reranking, and unions of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULTS
from tessera.functions.scalar import exact_round, tokens


def rrf(bm25: DataFrame, vector: DataFrame, k: int = DEFAULTS.rrf_k) -> DataFrame:
    """Fuse (query_id, chunk_id, bm25_score, rank) and (query_id, chunk_id, vector_score, rank).

    Order: fused score, then the keyword list's order, then the vector list's.
    """
    a = bm25.select("query_id", "chunk_id", "bm25_score", F.col("rank").alias("r1"))
    b = vector.select("query_id", "chunk_id", "vector_score", F.col("rank").alias("r2"))
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(r)), F.lit(0.0))
    out = a.join(b, ["query_id", "chunk_id"], "full").withColumn("rrf_score", exact_round(part("r1") + part("r2"), 6))
    by = Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), F.col("r1").asc_nulls_last(), F.col("r2").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(by)).select("query_id", "chunk_id", "bm25_score", "vector_score", "rrf_score", "rank")


def rerank_fallback(ranked: DataFrame, k: int = DEFAULTS.rerank_top_k) -> DataFrame:
    """The first k in their order with scores 0.95 - 0.08 i; positions from 0."""
    i = F.col("rank") - 1
    return ranked.where(F.col("rank") <= k).select("query_id", "chunk_id", exact_round(F.lit(0.95) - F.lit(0.08) * i, 3).alias("rerank_score"), i.cast("int").alias("pre_rerank_position"), i.cast("int").alias("post_rerank_position"))


def overlap(query: Column, content: Column) -> Column:
    """Share of the question's distinct tokens that a passage holds: the offline pair scorer."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(exact_round(F.size(F.array_intersect(q, tokens(content))) / F.size(q), 6))


def rerank(ranked: DataFrame, k: int = DEFAULTS.rerank_top_k, score: Column | None = None) -> DataFrame:
    """Rank (query_id, query, chunk_id, content, rank) by pair scores; equal scores keep their order."""
    scored = ranked.withColumn("rerank_score", overlap(F.col("query"), F.col("content")) if score is None else score)
    by = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    out = scored.withColumn("post", F.row_number().over(by) - 1).where(F.col("post") < k)
    return out.select("query_id", "chunk_id", "rerank_score", (F.col("rank") - 1).cast("int").alias("pre_rerank_position"), F.col("post").cast("int").alias("post_rerank_position"))


def union_first(ranked: DataFrame, *order: str) -> DataFrame:
    """Each non-empty chunk_id once, its first occurrence in ``order``."""
    some = ranked.where(F.col("chunk_id").isNotNull() & (F.col("chunk_id").cast("string") != ""))
    rest = [c for c in ranked.columns if c != "chunk_id"]
    first = some.groupBy("chunk_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*(F.col(c) if c == "chunk_id" else F.col("_r")[c].alias(c) for c in ranked.columns))
