"""Sub-queries: each is retrieved, reranked and answered by itself, all in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULTS, Settings
from tessera.functions.scalar import exact_round
from tessera.operators.bm25 import Bm25Index
from tessera.operators.fusion import rerank, rrf
from tessera.operators.vector import batch_top_k
from tessera.sources.providers import Embedder, OverlapReranker, Provider, Reranker, embed_distinct
from tessera.storage import keep


def retrieve(index: Bm25Index, vectors: DataFrame, asked: DataFrame, embedder: Embedder, s: Settings = DEFAULTS) -> DataFrame:
    """(query_id, chunk_id, bm25_score, vector_score, rank): the best ``sub_query_k`` of each question (query_id, query, strategy).

    Keyword scores are replaced by the reciprocal rank; the hybrid way fuses both lists.
    """
    k = s.sub_query_k
    words = index.top_k(asked.where("strategy <> 'vector'"), k).withColumn("bm25_score", F.lit(1.0) / F.col("rank"))
    embedded = embed_distinct(asked.where("strategy <> 'bm25'"), "query", embedder).select("query_id", "embedding")
    near = batch_top_k(vectors, embedded, k).withColumnRenamed("id", "chunk_id")
    return rrf(words, near, s.rrf_k).select("query_id", "chunk_id", "bm25_score", "vector_score", "rank")


def run_sub_queries(index: Bm25Index, vectors: DataFrame, corpus: DataFrame, subs: DataFrame, embedder: Embedder, provider: Provider, s: Settings = DEFAULTS, reranker: Reranker | None = None) -> DataFrame:
    """(query_id, sub_idx, sub_query, strategy, answer, chunks_used, top_chunk_score, success) of each row of
    ``subs`` (query_id, sub_idx, sub_query, strategy).

    A sub-query without passages is answered as such and does not hold up the others; one whose answer is null has failed.
    """
    key = F.concat_ws("/", F.col("query_id").cast("string"), F.col("sub_idx").cast("string"))
    asked = keep(subs.withColumn("key", key), "sub-asked")
    plain = asked.select(F.col("key").alias("query_id"), F.col("sub_query").alias("query"), "strategy")
    found = retrieve(index, vectors, plain, embedder, s).join(corpus.select("chunk_id", "source", "content"), "chunk_id").join(plain.select("query_id", "query"), "query_id")
    best = rerank(found, s.sub_query_rerank_k, (reranker or OverlapReranker()).score(F.col("query"), F.col("content"))).join(corpus.select("chunk_id", "source", "content"), "chunk_id")
    item = F.struct("post_rerank_position", "chunk_id", "content", "source", "rerank_score")
    used = best.groupBy(F.col("query_id").alias("key")).agg(F.array_sort(F.collect_list(item)).alias("chunks_used"))
    out = asked.join(used, "key", "left")
    first = F.get("chunks_used", F.lit(0))
    answer = provider.answer(F.col("sub_query"), first["content"])
    failed = F.lit("INSUFFICIENT: retrieval failed")
    none = F.array().cast(used.schema["chunks_used"].dataType)
    return out.select("query_id", "sub_idx", "sub_query", "strategy", F.coalesce(answer, failed).alias("answer"), F.coalesce("chunks_used", none).alias("chunks_used"), F.coalesce(exact_round(first["rerank_score"], 6), F.lit(0.0)).alias("top_chunk_score"), answer.isNotNull().alias("success"))


def successes(runs: DataFrame) -> DataFrame:
    """(query_id, sub_query_count, successful_sub_queries)."""
    return runs.groupBy("query_id").agg(F.count("*").alias("sub_query_count"), F.count_if("success").alias("successful_sub_queries"))


def zipped(df: DataFrame, left: str, right: str) -> DataFrame:
    """(k, left, right) for each place that the arrays ``left`` and ``right`` of a row both have: the shorter one tells how many."""
    n = F.least(F.size(left), F.size(right))
    both = F.transform(F.slice(F.arrays_zip(left, right), 1, F.greatest(n, F.lit(0))), lambda x, k: F.struct(k.alias("k"), x[left].alias(left), x[right].alias(right)))
    rest = [x for x in df.columns if x not in (left, right)]
    return df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*rest, F.explode(both).alias("_z")).select(*rest, F.col("_z.k").alias("k"), F.col(f"_z.{left}").alias(left), F.col(f"_z.{right}").alias(right))
