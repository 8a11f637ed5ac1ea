"""Toxicity scores: bags of subword embeddings averaged into a linear softmax.

A word's vector is the sum of its character n-grams' vectors, a text's the average over
all its n-grams; embeddings and softmax weights are trained jointly in numpy.  A
misspelling that was never seen shares most n-grams with the word it stands for.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import give_back, table, tidy

#: Most labelled rows that are read for training, the ones of smallest hashed doc_id.
SAMPLE_ROWS = 6000
#: Words that a worker remembers for one generation, some 30 MB; two are kept.
MEMO = 150_000
#: n-grams with zero vectors that each average holds besides the text's own, against chance in short texts.
PAD = 200
SIZES = (3, 4, 5)
_words = re.compile(r"[^\W_]+").findall


def word_grams(word: str, sizes: tuple[int, ...] = SIZES) -> list[str]:
    """The n-grams of a word between its end marks, and the marked word itself."""
    w = f"<{word}>"
    return [w[i : i + n] for n in sizes for i in range(len(w) - n + 1)] + [w]


@dataclass
class Model:
    """Trained vectors.  ``push`` holds each n-gram's pull on the logit of label 1: the
    softmax is linear, so a text's logit is the average of its n-grams' pulls, plus bias."""

    push: dict[str, float]
    bias: float
    memo: dict[str, tuple[float, int]] = field(default_factory=dict)
    old: dict[str, tuple[float, int]] = field(default_factory=dict)

    def _word(self, word: str) -> tuple[float, int]:
        if len(self.memo) >= MEMO:
            self.old = dict(self.memo)
            self.memo.clear()
        if (out := self.old.get(word)) is None:
            grams = word_grams(word)
            out = (sum(self.push.get(g, 0.0) for g in grams), len(grams))
        self.memo[word] = out
        return out

    def score(self, text: str | None) -> float:
        """Between 0 and 1; a text without words gets the bias alone."""
        total, n, known = 0.0, 0, self.memo
        for w in _words((text or "").lower()):
            p, k = known.get(w) or self._word(w)
            total += p
            n += k
        return float(1 / (1 + np.exp(-np.clip(self.bias + total / (n + PAD), -500, 500))))


def bag(text: str | None) -> Counter[str]:
    """How often each word of a whole text occurs."""
    return Counter(_words((text or "").lower()))


def train(texts: list[str], labels: np.ndarray, **settings) -> Model:
    """Fit a model to texts and their labels."""
    at: dict[str, int] = {}
    docs = []
    for words in map(bag, texts):
        docs.append((np.array([at.setdefault(w, len(at)) for w in words], np.int64), np.array(list(words.values()), np.int64)))
    return train_bags(list(at), docs, labels, **settings)


def train_bags(words: list[str], docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 4, least_docs: int = 16, epochs: int = 12, rate: float = 1.0, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fit vectors and weights by minibatch Adam on the cross entropy.  A text is the numbers of its distinct ``words``
    and how often each occurs.  n-grams whose words are in fewer than ``least_docs`` texts, added up, keep zero
    vectors.  Without both labels the score is the labels' mean."""
    if len(docs) == 0 or len(set(labels.tolist())) < 2:
        mean = float(labels.mean()) if len(docs) else 0.0
        return Model({}, float(np.log((mean + 1e-3) / (1 - mean + 1e-3))))
    docs_of = np.zeros(len(words), np.int64)
    for ids, _ in docs:
        docs_of[ids] += 1
    # Counts by hash bound the n-grams' counts from above: only those that may be frequent are held as text.
    by_hash = np.zeros(1 << 20, np.int64)
    for w, n in zip(words, docs_of.tolist(), strict=True):
        np.add.at(by_hash, [crc32(g.encode()) & 0xFFFFF for g in word_grams(w)], n)
    often = (by_hash >= least_docs).tobytes()
    seen: Counter[str] = Counter()
    for w, n in zip(words, docs_of.tolist(), strict=True):
        for g in word_grams(w):
            if often[crc32(g.encode()) & 0xFFFFF]:
                seen[g] += n
    names = sorted(g for g, n in seen.items() if n >= least_docs)
    del seen, by_hash, often
    at = {g: i for i, g in enumerate(names)}
    of_word, size = [], np.zeros(len(words), np.int64)
    for k, w in enumerate(words):
        gs = word_grams(w)
        size[k] = len(gs)
        of_word.append(np.array([at[g] for g in gs if g in at], np.int32))
    del at
    rows = []
    for ids, times in docs:
        cols = [np.repeat(of_word[w], n) for w, n in zip(ids.tolist(), times.tolist(), strict=True)]
        c, k = np.unique(np.concatenate(cols), return_counts=True) if cols else (np.empty(0, np.int32), np.empty(0))
        rows.append((c, (k / (PAD + int((times * size[ids]).sum()))).astype(np.float32)))
    del of_word, docs
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (dim, len(names))).astype(np.float32)
    w = rng.normal(0, 1, (dim, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, w, b)]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), 128):
            batch = [rows[i] for i in order[s : s + 128]]
            y = np.eye(2, dtype=np.float32)[labels[order[s : s + 128]]]
            cols, vals = np.concatenate([c for c, _ in batch]), np.concatenate([v for _, v in batch])
            doc = np.repeat(np.arange(len(batch)), [len(c) for c, _ in batch])
            h = np.stack([np.bincount(doc, e[d][cols] * vals, len(batch)) for d in range(dim)], 1).astype(np.float32)
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - y) / len(batch)
            gh = g @ w.T
            ge = np.stack([np.bincount(cols, gh[doc, d] * vals, len(names)) for d in range(dim)]).astype(np.float32)
            step += 1
            lr = rate * (1 - epoch / epochs)
            for q, grad, m in ((e, ge + decay * 1e-3 * e, moments[0]), (w, h.T @ g + decay * w, moments[1]), (b, g.sum(0), moments[2])):
                m[0] += 0.1 * (grad - m[0])
                m[1] += 0.01 * (grad * grad - m[1])
                q -= lr * (0.1 if q is b else 1) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)
    pull = (w[:, 1] - w[:, 0]) @ e
    keep = np.abs(pull) > 1e-3
    return Model({names[i]: float(pull[i]) for i in np.nonzero(keep)[0]}, float(b[1] - b[0]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``rows`` labelled documents outside the held-out fifth, of any length.

    The sample is the labels of smallest hashed doc_id.  Executors count its texts' words, so that a row that
    reaches the driver has each word once.  Only text and label are learned from.  Of a doc_id's repeated labels the
    larger counts, of its repeated texts the one of smallest hash; null texts have no words.  Without labelled rows every text gets the same score.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array([list(b) for b in bags], pa.list_(pa.string())), pa.array([list(b.values()) for b in bags], pa.list_(pa.int32()))], ["doc_id", "toxic", "words", "times"])

    # The sample is at most ``rows`` pairs of numbers, which bounds the broadcast.
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")
    counted = texts.mapInArrow(count, "doc_id long, toxic long, words array<string>, times array<int>")
    once = counted.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "words", "times"), F.hash("words", "times")).alias("r"))
    got = once.select("doc_id", "r.*").toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return train_bags([], [], np.empty(0, np.int64))
    lists = got.column("words").chunk(0)
    coded = lists.flatten().dictionary_encode()  # words as numbers: no word is held once a text
    cut = np.cumsum(lists.value_lengths().to_numpy())[:-1]
    ids, times = (np.split(x.to_numpy().astype(np.int64), cut) for x in (coded.indices, got.column("times").chunk(0).flatten()))
    labels_of, names = got.column("toxic").to_numpy(), coded.dictionary.to_pylist()
    del got, lists, coded, once, counted
    docs = list(zip(ids, times, strict=True))
    del ids, times
    give_back()
    try:
        return train_bags(names, docs, labels_of)
    finally:
        del docs, names
        give_back()  # the driver goes on after training


def score(model: Model, text: Column) -> Column:
    """The score of each whole text; null counts as empty.  The model's size is bounded by its sample."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @tidy
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(map(shared.value.score, t), dtype="float64")

    return run(text)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.  Other columns are not read, whatever their names; a null doc_id is
    not held out.  Null and empty texts get the bias alone, very long ones are read whole, repeated rows give repeated
    rows, no rows none.  A score of just one half counts as label 1."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), score(model, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
