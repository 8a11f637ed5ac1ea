"""A small literal question set: six categories of five, with expected strategies and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.schemas import BENCHMARK

_SUBJECTS = (("chunk overlap", "tokens"), ("BM25 scoring", "idf"), ("rank fusion", "rank"), ("answer caching", "similarity"), ("quality gating", "threshold"))
_FORMS = (
    ("FACTUAL", "bm25", "What is the default for {}?"),
    ("ABSTRACT", "vector", "Why does {} matter for answers?"),
    ("TIME_SENSITIVE", "hybrid", "What is the latest change to {}?"),
    ("MULTI_HOP", "hybrid", "Compare {} with its alternative and say when each fits."),
    ("STRESS_CORRECTION", "hybrid", "Tell something precise yet undocumented about {}."),
    ("EDGE_CASES", "bm25", "{}"),
)


def benchmark(spark: SparkSession) -> DataFrame:
    rows = [(form.format(name), strategy, category, [name.split()[0], key], category == "STRESS_CORRECTION") for category, strategy, form in _FORMS for name, key in _SUBJECTS]
    return spark.createDataFrame(rows, BENCHMARK)
