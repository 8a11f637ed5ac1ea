"""Two-tier answer cache over a table of entries (schema CACHE)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULTS
from tessera.functions.scalar import cache_key, cosine, exact_round
from tessera.operators.quality import composite
from tessera.operators.tables import upsert_latest


def live(entries: DataFrame, now: Column) -> DataFrame:
    return entries.where(F.col("expires_at") > now)


def with_expiry(entries: DataFrame, ttl_seconds: int = DEFAULTS.cache_ttl_seconds) -> DataFrame:
    return entries.withColumn("expires_at", F.timestamp_add("SECOND", F.lit(ttl_seconds), F.col("created_at")))


def exact_tier(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Every question with the entry of its normalised text, if any: hit, similarity 1."""
    keyed = queries.withColumn("cache_key", cache_key(F.col("query")))
    found = entries.select("cache_key", *(c for c in entries.columns if c not in keyed.columns), F.lit(True).alias("_hit"))
    return keyed.join(found, "cache_key", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).withColumn("similarity", F.when(F.col("hit"), 1.0).otherwise(0.0)).drop("_hit")


def semantic_tier(queries: DataFrame, entries: DataFrame, threshold: float = DEFAULTS.cache_similarity, window: int = DEFAULTS.cache_window) -> DataFrame:
    """(query_id, entry_id, similarity, hit): the best of the ``window`` latest entries, the later of equals, of those the larger id.

    ``entries``: entry_id, embedding, recency (larger is later), live ones only.  The window bounds the broadcast.
    """
    recent = entries.select("entry_id", F.col("embedding").alias("e"), "recency").orderBy(F.col("recency").desc(), "entry_id").limit(window)
    pairs = queries.select("query_id", "embedding").crossJoin(F.broadcast(recent)).select("query_id", "entry_id", "recency", exact_round(cosine(F.col("embedding"), F.col("e")), 6).alias("similarity"))
    best = pairs.groupBy("query_id").agg(F.max(F.struct("similarity", "recency", "entry_id")).alias("b"))
    return best.select("query_id", "b.entry_id", "b.similarity", (F.col("b.similarity") >= threshold).alias("hit"))


def decode(entries: DataFrame) -> DataFrame:
    """Typed values of a stored hash: missing relevancy and groundedness follow faithfulness, a missing composite is computed."""
    num = lambda c: F.nullif(F.trim(c), F.lit("")).try_cast("double")
    faith = F.coalesce(num("faithfulness"), F.lit(0.0))
    rel, ground = F.coalesce(num("answer_relevancy"), faith), F.coalesce(num("context_groundedness"), faith)
    return entries.withColumns({"composite_score": F.coalesce(num("composite_score"), composite(faith, rel, ground)), "answer_relevancy": rel, "context_groundedness": ground, "faithfulness": faith, "hit_count": F.coalesce(F.nullif(F.trim("hit_count"), F.lit("")).try_cast("bigint"), F.lit(0))})


def stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("total_entries"), F.coalesce(F.sum(F.coalesce("hit_count", F.lit(0))), F.lit(0)).cast("bigint").alias("total_hits"))


def write(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """Entries after the passed ``answers`` (seq, evaluation_passed and entry columns) are put in; the last write of a key wins."""
    fresh = answers.where("evaluation_passed").drop("evaluation_passed")
    both = entries.withColumn("seq", F.lit(-1).cast("long")).unionByName(fresh.withColumn("seq", F.col("seq").cast("long")))
    return upsert_latest(both, "cache_key", "seq").drop("seq")
