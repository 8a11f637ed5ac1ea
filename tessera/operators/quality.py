"""Scores, gates, bands and routes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import DEFAULTS, Settings
from tessera.functions.scalar import exact_round


def composite(faith: Column, rel: Column, ground: Column) -> Column:
    """Weighted mean; a null score counts as 0 here, and only here."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return exact_round(F.lit(0.5) * z(faith) + F.lit(0.3) * z(rel) + F.lit(0.2) * z(ground), 4)


def below_threshold(faith: Column, rel: Column, ground: Column, s: Settings = DEFAULTS) -> Column:
    """True if any score is under its threshold or null."""
    low = lambda c, t: F.coalesce(c < F.lit(t), F.lit(True))
    return low(faith, s.faithfulness) | low(rel, s.relevancy) | low(ground, s.groundedness)


def hallucination(faith: Column, rel: Column, ground: Column) -> Column:
    """Null where a score could not be parsed."""
    return F.when(faith.isNull() | rel.isNull() | ground.isNull(), F.lit(None)).otherwise(F.lit(1.0) - faith)


def confidence(score: Column, attempts: Column, cached: Column, similarity: Column) -> Column:
    """Unrounded confidence: a tenth off for each correction, or a twentieth of the similarity on for a cached answer."""
    fresh = score - F.lit(0.10) * attempts
    kept = F.least(F.lit(1.0), score + F.lit(0.05) * similarity)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(cached, kept).otherwise(fresh)))


def band(conf: Column) -> Column:
    """Decided before any rounding; without a score UNCERTAIN."""
    return F.when(conf.isNull(), "UNCERTAIN").when(conf >= 0.85, "VERIFIED").when(conf >= 0.70, "PROBABLE").when(conf >= 0.55, "UNCERTAIN").otherwise("UNRELIABLE")


def band_score(conf: Column) -> Column:
    return F.coalesce(exact_round(conf, 3), F.lit(0.5))


def route_after_cache(cached: Column) -> Column:
    return F.when(cached, "finalize_answer").otherwise("route_retrieval")


def route_strategy(strategy: Column) -> Column:
    return F.when(strategy == "bm25", "retrieve_bm25").when(strategy == "vector", "retrieve_vector").otherwise("retrieve_hybrid")


def route_after_rerank(n_chunks: Column, web_used: Column, decomposed: Column) -> Column:
    return F.when((n_chunks == 0) & ~web_used & ~decomposed, "web_search").when(decomposed, "evaluate_answer").otherwise("generate_answer")


def route_after_evaluate(passed: Column, attempts: Column, web_used: Column, query_type: Column, most: int = DEFAULTS.max_corrections) -> Column:
    return F.when(passed, "finalize_answer").when(~web_used & (F.lower(query_type) != "factual") & (attempts >= most), "web_search").when(attempts < most, "rewrite_query").otherwise("finalize_answer")


def gate_passed(passed: Column, cached: Column) -> Column:
    return passed | cached


def exhausted(passed: Column, cached: Column, attempts: Column) -> Column:
    return ~passed & ~cached & (attempts >= 3)


def should_decompose(multi_hop: Column, sub_queries: Column, attempts: Column) -> Column:
    return multi_hop & (F.size(sub_queries) >= 2) & (attempts == 0)


def valid_request(query: Column, session: Column, longest: int = DEFAULTS.max_query_length) -> Column:
    uuid = F.rlike(session, F.lit("^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"))
    return (F.trim(query) != "") & (F.length(query) <= longest) & (session.isNull() | uuid)


def degraded(store: Column, reranker: Column, evaluator: Column) -> Column:
    bad = evaluator.isNull() | F.contains(evaluator, F.lit("unreachable")) | F.contains(evaluator, F.lit("unavailable")) | (evaluator == "unknown")
    return (store != "connected") | bad | (reranker != "loaded")


def classify(query: Column) -> Column:
    """Offline classifier: the question's type by its words."""
    q = F.lower(query)
    has = lambda p: F.rlike(q, F.lit(p))
    return F.when(has(r"\b(compare|versus|vs|difference between)\b|\band\b.*\?.*\?"), "multi_hop").when(has(r"\b(latest|recent|today|current|now|this (week|month|year))\b"), "time_sensitive").when(has(r"\b(why|how|explain|describe)\b"), "abstract").otherwise("factual")


def strategy_of(query_type: Column) -> Column:
    return F.when(query_type == "factual", "bm25").when(query_type == "abstract", "vector").otherwise("hybrid")
