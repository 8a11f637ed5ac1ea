"""Exact deduplication by distributed MSD radix partitioning.

Texts are split by their leading bytes, then the groups that are left by the bytes after
those, and so on, each round with a wider digit.  A group of one text is settled, and so is
a group whose texts have all ended, which are equal byte by byte.  No digest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bitfilter import bit_filter, hit
from tessera.llm.common import save, table

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def exact_groups(docs: DataFrame, first: int = 64, growth: int = 8) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Digits are ``first`` bytes wide and ``growth`` times wider each round.  Only the rows of
    unsettled groups go on, with what is left of their texts.  Each round counts its groups by
    map-side combined sums and joins the counts back, a join that splits a hot group's rows.

    keep_id is a group's smallest doc_id (null only if none has one).  Rows that repeat both
    doc_id and text count each and are all kept; null texts equal empty ones.  No rows, no rows.
    """
    norm = normalised(F.col("text"))
    now = docs.select("doc_id", norm.alias("norm")).select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.lit(0).cast("long").alias("g"), F.col("norm").cast("binary").alias("rest"))
    width, done, held = first, [], None
    while True:
        dealt = now.select("doc_id", "text_sha256", "g", F.substring("rest", 1, width).alias("digit"), F.substring("rest", width + 1, 2**31 - 1 - width).alias("rest"))
        counts = dealt.groupBy("g", "digit").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
        groups = save(counts.withColumn("next_g", F.monotonically_increasing_id() + 1), "radix-groups")
        # A bit filter of the groups settles most lone rows where they are, so their texts do not move.
        key = F.xxhash64("g", "digit")
        some = hit(bit_filter(groups.select(key.alias("key")), "key"), key)
        done.append(dealt.where(~some).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256"))
        ended = F.octet_length("digit") < width
        on = F.col("n").isNotNull() & ~ended
        # Always a sort-merge join: it splits a hot group's rows, and moves the same share at any size.
        step = dealt.where(some).join(groups.hint("merge"), ["g", "digit"], "left").select(
            "doc_id",
            "text_sha256",
            F.when(on, F.lit(None)).when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).cast("long").alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.when(on, F.col("next_g")).alias("g"),
            F.when(on, F.col("rest")).alias("rest"),
        )
        step = save(step, "radix")
        done.append(step.where(F.col("g").isNull()).select("doc_id", "keep_id", "group_size", "text_sha256"))
        now = step.where(F.col("g").isNotNull()).select("doc_id", "text_sha256", "g", "rest")
        if now.isEmpty():
            break
        width *= growth
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


#: DuckDB: equal normalised texts by a plain grouping.
ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
