"""The corpus pipeline: five stages over ``documents``, each kept as Parquet for the next.

Every stage works on all rows that its predecessor kept.  All but the last return the
columns of ``documents``, whichever they are: extra columns pass through, also where an operator's own
columns have the same names.  An empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, linededup, simhash_wide, toxicity
from tessera.llm.common import drop, free_name, save, table, temporary

#: Words a shingle, and the least similarity of near copies.
SHINGLE, SIMILARITY = 5, 0.8


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled ones among them, scores under one half.

    Null and empty texts get the model's bias, as texts without a word do; repeated rows are scored alike.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(model, F.col("text")) < 0.5)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines found in ten documents or more.

    n_chars, where there is such a column, is counted anew where lines went.  A document that loses every line
    stays, with an empty text; one without such lines stays as it is, a null text null.
    """
    kept = free_name(docs, "kept")
    out = linededup.dropped(docs, linededup.LineIndex.build(docs), kept)
    new = {"text": F.col(kept)["kept_text"], "n_chars": F.length(F.col(kept)["kept_text"]).cast("long")}
    return out.select(*(F.when(F.col(kept)["n_dropped"] > 0, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in docs.columns))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id; see ``simhash_wide.one_of_each``."""
    return simhash_wide.one_of_each(docs, SHINGLE, SIMILARITY)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; null, empty and repeated rows are judged like others."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's number of ids, digests of its ids and of the bytes they decode to."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", bpe_stage),
]

#: A trained model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = last = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with temporary(spark):  # what a stage wrote goes with it, and so does its predecessor's table
            docs = save(stage(spark, last, sf_dir), f"stage-{name}", kept=True)
        if k:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
