"""Late interaction against a pair at a time."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators import interaction
from tessera.operators.interaction import LateInteraction, token_vector
from tessera.plans.adaptive import Engine


def slow(query, content, d=128):
    import re

    a, b = (dict.fromkeys(re.findall("[a-z0-9]{2,}", (x or "").lower())) for x in (query, content))
    if not a or not b:
        return 0.0
    return float(np.mean([max(token_vector(x, d) @ token_vector(y, d) for y in b) for x in a]))


def test_scores_as_by_single_pairs(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    queries = [text(rng.randint(1, 8)) for _ in range(6)] + [None, "", "?!"]
    rows = [(k, rng.choice(queries), rng.choice([text(rng.randint(0, 60)), None, ""])) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, query string, content string").repartition(2)
    got = {r.k: r.s for r in df.select("k", LateInteraction().score(F.col("query"), F.col("content")).alias("s")).collect()}
    assert all(abs(got[k] - slow(q, c)) < 1e-6 for k, q, c in rows)
    # Taken in pieces, scores are the same.
    v = np.stack([token_vector(word(), 32) for _ in range(40)])
    flat, start = np.arange(40), np.array([0, 1, 9, 20, 39])
    whole = interaction.best_matches(v[:3], v, flat, start)
    monkeypatch.setattr(interaction, "PIECE", 20)
    assert np.allclose(interaction.best_matches(v[:3], v, flat, start), whole)


def test_misspelt_words_are_found_by_the_engine(spark):
    corpus = spark.createDataFrame([("c1", "s", "the retrieval of passages"), ("c2", "s", "of the and in with gardens")], "chunk_id string, source string, content string")
    asked = spark.createDataFrame([(1, "retreival of pasages")], "query_id int, query string")
    assert Engine(corpus, Settings(max_corrections=0), reranker=LateInteraction()).ask(asked).first().answer == "the retrieval of passages"
