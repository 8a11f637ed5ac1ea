"""Settings of the engine; the values are its published defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    bm25_top_k: int = 20
    vector_top_k: int = 20
    rerank_top_k: int = 5
    sub_query_k: int = 10
    sub_query_rerank_k: int = 3
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    faithfulness: float = 0.75
    relevancy: float = 0.70
    groundedness: float = 0.65
    cache_similarity: float = 0.95
    cache_window: int = 200
    cache_ttl_seconds: int = 604_800
    max_corrections: int = 3
    max_query_length: int = 2000
    max_ingest_mb: int = 50
    chunk_size: int = 512
    chunk_overlap: int = 64
    min_chunk_size: int = 100
    web_results: int = 5
    embedding_dimensions: int = 1536


DEFAULTS = Settings()
