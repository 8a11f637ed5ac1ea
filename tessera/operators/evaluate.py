"""Aggregates of evaluation runs and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import exact_round, mean_or_zero


#: Groups of more rows are narrowed to values near the wanted place before they are sorted.
SORTED_ROWS = 20_000


def _nth(df: DataFrame, value: str, share: float, place: Column, keys: list[str]) -> DataFrame:
    """The value at 0-based ``place(n)``, about ``share`` of the way, of each group's sorted values.

    Bounds around the place come from a sketch whose error is a tenth of their distance.  What lies below them is one
    count, what lies above goes, and only the distinct values between them are sorted: about a 500th of a large group.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    near = F.percentile_approx("_v", [max(0.0, share - 0.001), min(1.0, share + 0.001)], 10_000)
    bounds = rows.groupBy(*keys).agg(F.count("*").alias("n"), near.alias("q"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    large = F.col("n") > SORTED_ROWS
    bounds = bounds.select(*(F.col(k).alias(f"_{k}") for k in keys), "n", F.when(large, F.col("q")[0]).otherwise(F.col("least")).alias("lo"), F.when(large, F.col("q")[1]).otherwise(F.col("most")).alias("hi"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    some = rows.join(bounds, on) if keys else rows.crossJoin(F.broadcast(bounds))  # one row
    counts = some.where(F.col("_v") <= F.col("hi")).groupBy(*keys, "n", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("c"))
    run = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())))
    return run.where((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place)).select(*keys, F.col("_v").alias(value))


def p95_runner(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Place min(int(0.95 n), n - 1) from 0, one decimal."""
    at = F.least(F.floor(F.col("n") * F.lit(0.95)), F.col("n") - 1)
    return _nth(df, value, 0.95, at, list(keys)).select(*keys, exact_round(F.col(value), 1).alias("p95"))


def p95_stress(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Place round-half-even(0.95 (n - 1))."""
    at = F.bround((F.col("n") - 1) * F.lit(0.95), 0).cast("long")
    return _nth(df, value, 0.95, at, list(keys)).select(*keys, F.col(value).alias("p95"))


def latency_summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """avg, p50 (the mean of the two middle values), max, min, n of each group."""
    sides = [_nth(df, value, 0.5, at, list(keys)) for at in (F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2))]
    out = df.groupBy(*keys).agg(exact_round(F.avg(value), 4).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"), F.count("*").alias("n"))
    for side, name in zip(sides, ("_a", "_b"), strict=True):
        own = side.select(*(F.col(k).alias(f"{name}{k}") for k in keys), F.col(value).cast("double").alias(name))
        out = out.join(own, [F.col(k).eqNullSafe(F.col(f"{name}{k}")) for k in keys], "left") if keys else out.join(own, F.lit(True), "left")
    return out.select(*keys, "avg", ((F.col("_a") + F.col("_b")) / 2).alias("p50"), "max", "min", "n")


def suite_aggregate(r: DataFrame) -> DataFrame:
    """One row over result rows (schema EVAL_RESULT); averages skip null scores, no rows give 0."""
    rate = lambda x, y: F.when(y > 0, exact_round(x / y, 4)).otherwise(0.0)
    n = F.count("*")
    done, corrected = F.count_if("is_complete"), F.count_if(F.col("correction_attempts") > 0)
    return r.agg(
        n.alias("total"),
        done.alias("completed"),
        rate(done, n).alias("completion_rate"),
        rate(F.count_if(F.col("actual_strategy") == F.col("expected_strategy")), n).alias("strategy_accuracy"),
        mean_or_zero(F.col("faithfulness")).alias("avg_faithfulness"),
        mean_or_zero(F.col("answer_relevancy")).alias("avg_answer_relevancy"),
        mean_or_zero(F.col("context_groundedness")).alias("avg_context_groundedness"),
        mean_or_zero(F.col("composite_score")).alias("avg_composite"),
        rate(corrected, n).alias("correction_rate"),
        mean_or_zero(F.col("correction_attempts")).alias("avg_corrections"),
        rate(F.count_if((F.col("correction_attempts") > 0) & F.col("is_complete")), corrected).alias("correction_success_rate"),
        rate(F.count_if("served_from_cache"), n).alias("cache_hit_rate"),
        mean_or_zero(F.col("latency_ms"), 1).alias("avg_latency_ms"),
        mean_or_zero(F.col("keyword_hit_rate")).alias("keyword_hit_rate"),
        F.coalesce(exact_round(F.sum("latency_ms") / 60000.0, 2), F.lit(0.0)).alias("total_duration_minutes"),
    )


def suite_report(r: DataFrame, order: str, at: Column) -> DataFrame:
    """``suite_aggregate`` with the p95 latency, the first known scorer and the time of the run: all keys of a report."""
    p95 = p95_runner(r, "latency_ms").select(F.col("p95").alias("p95_latency_ms"))
    scorer = first_known(r, "scorer_model", order)
    out = suite_aggregate(r).join(p95, F.lit(True), "left").join(scorer, F.lit(True), "left")  # one row each
    return out.withColumns({"p95_latency_ms": F.coalesce("p95_latency_ms", F.lit(0.0)), "run_timestamp": at})


def by_category(r: DataFrame) -> DataFrame:
    return r.groupBy("category").agg(F.count("*").alias("n"), F.count_if("is_complete").alias("completed"), F.count_if(F.col("actual_strategy") == F.col("expected_strategy")).alias("strategy_ok"), exact_round(F.avg("latency_ms"), 1).alias("avg_latency_ms"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull() & (F.col(col) != "")).groupBy(col).agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


def first_known(df: DataFrame, value: str, order: str, default: str = "unknown") -> DataFrame:
    """The first row's value that is not null, by ``order``."""
    return df.agg(F.coalesce(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))), F.lit(default)).alias(value))


def speed_up(df: DataFrame, value: str, order: str, *keys: str, hit_below: float = 500.0) -> DataFrame:
    """Cold latency over the mean of the warm ones; a hit is a warm run under ``hit_below`` ms."""
    first = df.groupBy(*keys).agg(F.min_by(value, order).alias("cold"), F.min(order).alias("_o"))
    warm = df.join(first, list(keys)).where(F.col(order) != F.col("_o")).groupBy(*keys, "cold").agg(F.avg(value).alias("w"), F.count_if(F.col(value) < hit_below).alias("hits"))
    return warm.select(*keys, "cold", exact_round(F.when(F.col("w") == 0, None).otherwise(F.col("cold") / F.col("w")), 4).alias("speed_up"), "hits")
