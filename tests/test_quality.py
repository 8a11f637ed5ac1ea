"""Scores, bands, routes, parsing."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as s
from tessera.operators import quality as q


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


L = F.lit


def null():
    return F.lit(None).cast("double")


def test_composite_and_gate(spark):
    assert one(spark, q.composite(L(0.90), L(0.88), L(0.85))) == 0.884
    assert one(spark, q.composite(null(), L(0.88), L(0.85))) == 0.434
    assert one(spark, q.below_threshold(L(0.75), L(0.70), L(0.65))) is False
    assert one(spark, q.below_threshold(null(), L(1.0), L(1.0))) is True
    assert one(spark, q.hallucination(null(), L(1.0), L(1.0))) is None


@pytest.mark.parametrize(("score", "attempts", "cached", "sim", "label", "shown"), [(0.889, 0, False, 0.0, "VERIFIED", 0.889), (0.30, 0, False, 0.0, "UNRELIABLE", 0.3), (0.85, 3, False, 0.0, "UNRELIABLE", 0.55), (0.84, 2, True, 1.0, "VERIFIED", 0.89)])
def test_band(spark, score, attempts, cached, sim, label, shown):
    c = q.confidence(L(score), L(attempts), L(cached), L(sim))
    assert one(spark, q.band(c)) == label
    assert one(spark, q.band_score(c)) == pytest.approx(shown)


def test_no_score_is_uncertain(spark):
    assert one(spark, q.band(null())) == "UNCERTAIN"
    assert one(spark, q.band_score(null())) == 0.5


@pytest.mark.parametrize(("passed", "attempts", "web", "kind", "want"), [(True, 0, False, "ABSTRACT", "finalize_answer"), (False, 1, False, "ABSTRACT", "rewrite_query"), (False, 3, False, "ABSTRACT", "web_search"), (False, 3, True, "ABSTRACT", "finalize_answer"), (False, 3, False, "FACTUAL", "finalize_answer")])
def test_route_after_evaluate(spark, passed, attempts, web, kind, want):
    assert one(spark, q.route_after_evaluate(L(passed), L(attempts), L(web), L(kind))) == want


@pytest.mark.parametrize(("n", "web", "decomposed", "want"), [(0, False, False, "web_search"), (0, False, True, "evaluate_answer"), (1, False, False, "generate_answer"), (1, False, True, "evaluate_answer"), (0, True, False, "generate_answer")])
def test_route_after_rerank(spark, n, web, decomposed, want):
    assert one(spark, q.route_after_rerank(L(n), L(web), L(decomposed))) == want


@pytest.mark.parametrize(("raw", "want"), [('{"score": 0.85, "why": "x"}', 0.85), ('{"score": 1.5}', 1.0), ('{"score": -0.2}', 0.0), ("some text score is 0.72 done", 0.72), ("", None), ('{"error": "failed"}', None), ('{"error": "0.5x"}', None)])
def test_score_parser(spark, raw, want):
    assert one(spark, s.parse_score(L(raw))) == want


def test_degraded(spark):
    ok = lambda *a: one(spark, q.degraded(*map(L, a)))
    assert ok("connected", "loaded", "claude: ok") is False
    assert ok("disconnected", "loaded", "ok") is True
    assert ok("connected", "fallback", "ok") is True
    assert ok("connected", "loaded", "unreachable: x") is True
    assert ok("connected", "loaded", "unknown") is True


def test_request_validation(spark):
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    assert one(spark, q.valid_request(L("what"), L(uuid))) is True
    assert one(spark, q.valid_request(L("  "), L(uuid))) is False
    assert one(spark, q.valid_request(L("x" * 2001), L(uuid))) is False
    assert one(spark, q.valid_request(L("what"), L("stress-seq-000"))) is False


def test_keys_and_fences(spark):
    assert one(spark, s.chunk_id(L("test.pdf"), L(0))) == "6f45014cda9e"
    assert one(spark, s.cache_key(L(" What is RAG "))).endswith("8bc535f2b002")
    assert one(spark, s.strip_fence(L('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, s.keyword_hit_rate(F.array(L("BM25"), L("k1")), L("uses bm25"))) == 0.5
    assert one(spark, s.keyword_hit_rate(F.array().cast("array<string>"), L("x"))) == 0.0


def test_exact_round(spark):
    assert one(spark, s.exact_round(L(2.675), 2)) == 2.68
    assert one(spark, s.exact_round(L(0.5), 0)) == 1.0
