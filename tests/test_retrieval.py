"""Hand-computed fixtures of the retrieval operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as s
from tessera.operators import fusion, vector
from tessera.operators.bm25 import Bm25Index, add_chunks

CORPUS = [("d1", "Red red blue."), ("d2", "Blue green"), ("d3", "Green green yellow black"), ("d4", "A Blue kite")]


def corpus(spark, rows=CORPUS):
    return spark.createDataFrame(rows, "chunk_id string, content string")


def ask(spark, index, text, k=20):
    q = spark.createDataFrame([(1, text)], "query_id int, query string")
    return {r.chunk_id: (r.bm25_score, r.rank) for r in index.top_k(q, k).collect()}


def test_bm25_case_and_zero_rows(spark):
    got = ask(spark, Bm25Index.build(corpus(spark)), "red GREEN")
    assert got == {"d1": (pytest.approx(1.176060, abs=1e-6), 1), "d2": (0.0, 2), "d3": (0.0, 3), "d4": (0.0, 4)}


def test_bm25_negative_idf_floor_and_tie(spark):
    got = ask(spark, Bm25Index.build(corpus(spark)), "blue")
    assert got["d2"] == (pytest.approx(0.120729, abs=1e-6), 1)
    assert got["d4"][1] == 2
    assert got["d1"][0] == pytest.approx(0.101750, abs=1e-6)
    assert got["d3"] == (0.0, 4)


def test_bm25_single_document_keeps_negative_score(spark):
    index = Bm25Index.build(corpus(spark, [("c1", "neural networks and deep learning")]))
    assert ask(spark, index, "deep learning", 1) == {"c1": (pytest.approx(-0.549306, abs=1e-6), 1)}


def test_bm25_empty_index(spark):
    assert ask(spark, Bm25Index.build(corpus(spark, [])), "anything") == {}


def test_bm25_top_k_bound_and_count(spark):
    index = Bm25Index.build(corpus(spark, [(f"c{i}", f"document number {i} about query topic") for i in range(5)]))
    assert len(ask(spark, index, "query", 3)) == 3
    assert index.count().first().n == 5


def test_add_chunks_dedupes_across_and_within_batches(spark):
    c = corpus(spark, [("dup", "the same chunk content")])
    assert add_chunks(c, corpus(spark, [("dup", "x"), ("new", "y"), ("new", "y")])).count() == 2


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0, 0.0], [1.0, 0.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    assert df.select(s.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)
    assert df.select(s.cosine(F.col("b"), F.col("a"))).first()[0] == pytest.approx(want)


def ranked(spark, ids, score):
    return spark.createDataFrame([(1, c, 1.0, i) for i, c in enumerate(ids, 1)], f"query_id int, chunk_id string, {score} double, rank int")


def test_rrf(spark):
    out = fusion.rrf(ranked(spark, "abc", "bm25_score"), ranked(spark, "bda", "vector_score")).orderBy("rank").collect()
    assert [(r.chunk_id, r.rrf_score) for r in out] == [("b", 0.032522), ("a", 0.032266), ("d", 0.016129), ("c", 0.015873)]
    tie = fusion.rrf(ranked(spark, "ab", "bm25_score"), ranked(spark, "ba", "vector_score")).orderBy("rank").collect()
    assert [r.chunk_id for r in tie] == ["a", "b"]


def test_rerank_fallback_scores(spark):
    out = fusion.rerank_fallback(ranked(spark, "abcdef", "bm25_score")).orderBy("post_rerank_position").collect()
    assert [r.rerank_score for r in out] == [0.95, 0.87, 0.79, 0.71, 0.63]


def test_batch_top_k_matches_single(spark):
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)], "id long, embedding array<float>")
    got = vector.batch_top_k(v, v.where("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding"), 4)
    for q in (0, 10, 20, 30):
        want = [(r.id, r.vector_score) for r in vector.top_k(v, v.where(F.col("id") == q).first().embedding, 4).collect()]
        assert [(r.id, r.vector_score) for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == want


def test_batch_top_k_multiplies_bounded_tiles(spark, monkeypatch):
    """Tiles of questions and vectors give the rows of one product, ties by id; no larger block of scores is made."""
    v = spark.createDataFrame([(f"{i:03d}", [float(i % 5), float(i % 3), 1.0]) for i in range(300)], "id string, embedding array<float>").repartition(3)
    asked = v.where("cast(id as int) % 4 = 0").select(F.col("id").alias("query_id"), "embedding")
    key = lambda df: sorted((r.query_id, r["rank"], r.id, r.vector_score) for r in df.collect())
    want = key(vector.batch_top_k(v, asked, 7))
    monkeypatch.setattr(vector, "TILE", 10)
    monkeypatch.setattr(vector, "ROWS", 16)
    monkeypatch.setattr(vector, "BLOCK", 32)
    assert key(vector.batch_top_k(v, asked, 7)) == want
    q, e = np.ones((10, 3)), np.arange(48.0).reshape(16, 3)
    assert len(vector._tile_best(q, e, np.arange(16), 7)[0]) == 70


def test_top_k_plans_use_a_bounded_sort(spark):
    v = spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>")
    assert "TakeOrderedAndProject" in vector.top_k(v, [1.0], 3)._jdf.queryExecution().executedPlan().toString()


def test_an_index_that_grew_equals_one_built_anew(spark):
    rows = [(f"c{i}", f"red word{i % 3} blue{i} common") for i in range(8)] + [("c8", ""), ("c9", None)]
    c = corpus(spark, rows)
    grown = Bm25Index.build(corpus(spark, rows[:5])).clustered().add(corpus(spark, rows[3:] + rows[7:8]))
    whole = Bm25Index.build(c)
    q = spark.createDataFrame([(1, "word1 common"), (2, "blue4 absent"), (3, "")], "query_id int, query string")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(grown.terms) == key(whole.terms)
    assert grown.corpus.first() == whole.corpus.first()
    assert key(grown.top_k(q, 4)) == key(whole.top_k(q, 4)) == key(whole.written().top_k(q, 4))


def test_chunks_are_scored_where_they_are_read(spark, monkeypatch):
    """A task passes on the k best of each question, not all matches, in slices of any size; ties and short lists as before."""
    from tessera.operators import bm25

    rows = [(f"c{i:03d}", " ".join(f"w{i * j % 7}" for j in range(1, 2 + i % 9)) + " rare" * (i % 50 == 3)) for i in range(200)] + [("x", ""), ("y", None)]
    q = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w3 rare"), (3, "rare absent"), (4, None)], "query_id int, query string")
    index = Bm25Index.build(corpus(spark, rows).repartition(3))
    key = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "bm25_score", "rank").collect()))
    want = key(index.ranked(q, index.scores(q), 5))
    for pairs in (1 << 20, 1, 37):
        monkeypatch.setattr(bm25, "PAIRS", pairs)
        assert key(index.top_k(q, 5)) == want
    assert index._best(q, 5).count() <= 3 * 3 * 5 < index.scores(q).count()
