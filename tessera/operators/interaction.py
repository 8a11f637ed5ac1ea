"""Late interaction: a question's tokens each look for their best match among a passage's tokens.

A token's vector is the sum of the signed hashes of its character trigrams, of unit length, so that inflected and
misspelt words are near each other.  The score is the mean over the question's distinct tokens of the highest cosine.  Vectors
are made once a batch for each distinct token; a question's products with all tokens of the batch are one matrix, of which
each passage takes the row maxima over its own columns.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalar import tokens

GRAM = 3
#: Products of a question with tokens that are held at once; more tokens are taken in pieces of whole passages.
PIECE = 1 << 22


def token_vector(token: str, dimensions: int) -> np.ndarray:
    """Unit length; a token's whole and its trigrams, with marks for its ends."""
    v, t = np.zeros(dimensions), f"<{token}>"
    for gram in {t, *(t[k : k + GRAM] for k in range(len(t) - GRAM + 1))}:
        h = zlib.crc32(gram.encode())
        v[(h >> 1) % dimensions] += 1.0 if h & 1 else -1.0
    n = np.linalg.norm(v)
    return v / n if n else v


def best_matches(question: np.ndarray, vectors: np.ndarray, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each passage, whose tokens are ``flat`` from its ``start`` (none is empty), the mean of the question's best cosines."""
    out, a = np.empty(len(start)), 0
    ends = np.append(start[1:], len(flat))
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(ends, start[a] + PIECE // len(question), "right")))
        own = flat[start[a] : ends[b - 1]]
        out[a:b] = np.maximum.reduceat(question @ vectors[own].T, start[a:b] - start[a], axis=1).mean(0)
        a = b
    return out


class LateInteraction:
    """A reranker for ``Engine``: higher for passages that match all of a question's tokens well; 0 without tokens on either side."""

    def __init__(self, dimensions: int = 128) -> None:
        self.dimensions = dimensions

    def score(self, query: Column, content: Column) -> Column:
        d = self.dimensions

        @F.pandas_udf("double")
        def run(asked: pd.Series, passages: pd.Series) -> pd.Series:
            known: dict[str, int] = {}
            number = lambda ts: np.array([known.setdefault(t, len(known)) for t in dict.fromkeys(ts)], np.int64)
            q, p = [number(x) for x in asked], [number(x) for x in passages]
            vectors = np.array([token_vector(t, d) for t in known]).reshape(-1, d)
            rows: dict[bytes, list[int]] = {}
            for k, own in enumerate(q):
                if len(own) and len(p[k]):
                    rows.setdefault(own.tobytes(), []).append(k)
            out = np.zeros(len(q))
            for ks in rows.values():
                size = np.array([len(p[k]) for k in ks])
                got = best_matches(vectors[q[ks[0]]], vectors, np.concatenate([p[k] for k in ks]), np.cumsum(size) - size)
                out[ks] = np.floor(got * 1e6 + 0.5) / 1e6
            return pd.Series(out)

        return run(tokens(query), tokens(content))
