"""Provider interfaces for model-backed steps, each with a deterministic offline default."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import exact_round, tokens
from tessera.operators import quality
from tessera.operators.fusion import overlap


class Embedder(Protocol):
    dimensions: int

    def embed(self, text: Column) -> Column: ...


class HashEmbedder:
    """Signed token hashes added into a fixed number of dimensions."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, text: Column) -> Column:
        n = self.dimensions

        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            import re
            import zlib

            out = []
            for t in texts:
                v = np.zeros(n, np.float32)
                for w in re.split("[^a-z0-9]+", (t or "").lower()):
                    if len(w) >= 2:
                        h = zlib.crc32(w.encode())
                        v[h % n] += 1 if h >> 31 else -1
                out.append(v)
            return pd.Series(out)

        return run(text)


def embed_distinct(df: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """``df`` with an embedding column; each distinct text is embedded once, found again by its md5."""
    keyed = df.withColumn("_k", F.md5(F.coalesce(F.col(text), F.lit(""))))
    made = keyed.dropDuplicates(["_k"]).select("_k", embedder.embed(F.col(text)).alias("embedding"))
    return keyed.join(made, "_k").drop("_k")


class Classifier(Protocol):
    def classify(self, query: Column) -> Column: ...

    def sub_queries(self, query: Column) -> Column: ...


class Generator(Protocol):
    def answer(self, query: Column, best: Column) -> Column: ...

    def rewrite(self, user_query: Column) -> Column: ...

    def synthesise(self, query: Column, parts: Column, plain: Column) -> Column: ...


class Critic(Protocol):
    def scores(self, query: Column, answer: Column, context: Column) -> list[Column]: ...


class Reranker(Protocol):
    def score(self, query: Column, content: Column) -> Column: ...


class Checkpointer(Protocol):
    """Keeps a table between the steps of a plan."""

    def keep(self, df: DataFrame, tag: str) -> DataFrame: ...


class Provider(Classifier, Generator, Critic, Protocol):
    """What the adaptive plan asks of models."""


class OverlapReranker:
    """Pair scores by the share of the question's tokens."""

    def score(self, query: Column, content: Column) -> Column:
        return overlap(query, content)


class SharedFolder:
    """Tables in the folder that driver and executors share."""

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        from tessera.storage import keep

        return keep(df, tag)


class Offline:
    """Classifier, generator, critic and rewriter by rules."""

    def sub_queries(self, query: Column) -> Column:
        """What stands between question marks and the words that join two questions or two things compared."""
        parts = F.split(F.coalesce(query, F.lit("")), r"(?i)\?\s*|\s+(?:and|versus|vs\.?)\s+")
        return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")

    def synthesise(self, query: Column, parts: Column, plain: Column) -> Column:
        """The sub-answers in their order."""
        return plain

    def classify(self, query: Column) -> Column:
        return quality.classify(query)

    def answer(self, query: Column, best: Column) -> Column:
        """The best passage, or a fixed text without one."""
        return F.coalesce(best, F.lit("INSUFFICIENT_CONTEXT: no passage was found."))

    def scores(self, query: Column, answer: Column, context: Column) -> list[Column]:
        """Faithfulness, relevancy, groundedness by token overlap."""
        a = F.array_distinct(tokens(answer))
        share = F.when(F.size(a) == 0, 0.0).otherwise(exact_round(F.size(F.array_intersect(a, tokens(context))) / F.size(a), 6))
        return [share, overlap(query, answer), overlap(query, context)]

    def rewrite(self, user_query: Column) -> Column:
        return F.concat(user_query, F.lit(" specific details evidence"))
