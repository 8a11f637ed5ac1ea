"""Execution traces: deltas, totals, first states, increments, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import exact_round


def score_delta(df: DataFrame, session: str, order: str, score: str) -> DataFrame:
    w = Window.partitionBy(session).orderBy(order)
    return df.select(session, order, score, exact_round(F.col(score) - F.lag(score).over(w), 6).alias("delta"))


def last_score(df: DataFrame, session: str, order: str, score: str) -> DataFrame:
    return df.groupBy(session).agg(F.max_by(score, order).alias("last"))


def total_ms(df: DataFrame, session: str, duration: str) -> DataFrame:
    return df.groupBy(session).agg(exact_round(F.sum(F.coalesce(duration, F.lit(0.0))), 4).alias("total_ms"))


def first_status(df: DataFrame, session: str, node: str, order: str, status: str) -> DataFrame:
    return df.groupBy(session, node).agg(F.min_by(status, order).alias("status"))


def new_steps(df: DataFrame, seen: DataFrame, session: str, order: str) -> DataFrame:
    """The steps after the last one each session has ``seen`` (session, last); all of an unseen session."""
    return df.join(seen, session, "left").where(F.col("last").isNull() | (F.col(order) > F.col("last"))).drop("last")


def counters(**counted: DataFrame) -> DataFrame:
    """One row with the count of each named table."""
    out = None
    for name, df in counted.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def rate_windows(df: DataFrame, key: str, at: str, seconds: int, most: int) -> DataFrame:
    """Requests by key and tumbling window, and whether they exceed ``most``."""
    t = F.window(F.col(at).cast("timestamp"), f"{seconds} seconds")
    return df.groupBy(key, t.alias("w")).agg(F.count("*").alias("n")).select(key, F.unix_timestamp("w.start").alias("window_start"), "n", (F.col("n") > most).alias("limited"))
