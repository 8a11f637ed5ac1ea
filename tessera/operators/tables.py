"""Keyed table maintenance: insert-ignore, upsert, merge, lookups, session state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_ignore(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new`` to append: keys that ``existing`` lacks, each once."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti").select(*new.columns)


def upsert_latest(rows: DataFrame, key: str | list[str], seq: str) -> DataFrame:
    """One row a key, the one of largest ``seq`` (which is combined before the shuffle, so that a key's rows do not meet)."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(seq).isNotNull(), F.col(seq))).alias("_r"))
    return last.select(*(F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in rows.columns))


def merge_eval_run(old: DataFrame, new: DataFrame) -> DataFrame:
    """On conflict the new status, progress, aggregate, results and completion hold; total and start stay."""
    o, n = old.alias("o"), new.alias("n")
    take = ("status", "progress", "aggregate", "results", "completed_at")
    hit = F.col("n.job_id").isNotNull()
    cols = [F.coalesce("n.job_id", "o.job_id").alias("job_id")]
    cols += [(F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in take else F.when(F.col("o.job_id").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))).alias(c) for c in old.columns if c != "job_id"]
    return o.join(n, F.col("o.job_id") == F.col("n.job_id"), "full").select(*cols)


def lookup(first: DataFrame, second: DataFrame, keys: DataFrame, key: str, value: str) -> DataFrame:
    """For each key the value of the first table, else of the second, else null: a memory tier before the table of record."""
    a, b = first.select(key, F.col(value).alias("_a")), second.select(key, F.col(value).alias("_b"))
    return keys.join(a, key, "left").join(b, key, "left").select(key, F.coalesce("_a", "_b").alias(value), (F.coalesce("_a", "_b").isNotNull()).alias("found"))


def latest_state(states: DataFrame) -> DataFrame:
    """Each session's state of its last step."""
    return upsert_latest(states, "session_id", "step")


def count_or_zero(df: DataFrame) -> int:
    """The row count, 0 for a table that cannot be read."""
    try:
        return df.count()
    except Exception:  # noqa: BLE001 - an absent store counts as empty
        return 0


def listing(docs: DataFrame) -> DataFrame:
    """Ingested documents in the order of their indexing."""
    return docs.select("doc_id", "filename", "chunk_count", "indexed_at").orderBy("indexed_at", "doc_id")


def job_progress(jobs: DataFrame) -> DataFrame:
    """The latest status of each job with the share that is done; one may run at a time."""
    last = upsert_latest(jobs, "job_id", "seq")
    return last.select("job_id", "status", "progress", "total", F.when(F.col("total") > 0, F.col("progress") / F.col("total")).otherwise(0.0).alias("share"))
