"""Quantiles over many runs from sketches that are kept with each run.

A run's values are read once, when its sketch is made.  Sketches of any runs are merged to bounds around a
quantile's place, and only values between the bounds are looked at again, to give the exact one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import keep

#: Size of a sketch, and the error of its ranks as a share of all values (99 in a hundred sketches stay within it).
SKETCH, ERROR = 1600, 0.0025
SCHEMA = "n bigint, least double, most double, sketch binary"


def sketches(df: DataFrame, run: str, value: str) -> DataFrame:
    """(run, n, least, most, sketch) of each run's values that are not null: to be appended to those of earlier runs."""
    v = F.col(value).cast("double")
    return df.where(F.col(value).isNotNull()).groupBy(run).agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.kll_sketch_agg_double(v, F.lit(SKETCH)).alias("sketch"))


def bounds(kept: DataFrame, share: float, *keys: str) -> DataFrame:
    """(keys, n, least, most, lo, hi): values that enclose the quantile, but for the sketches' error, of the runs in ``kept``."""
    merged = kept.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("s")).where("n > 0")  # no row where no runs are
    at = lambda q: F.kll_sketch_get_quantile_double("s", F.lit(min(1.0, max(0.0, q))))
    return merged.select(*keys, "n", "least", "most", at(share - 2 * ERROR).alias("lo"), at(share + 2 * ERROR).alias("hi"))


def nth(kept: DataFrame, df: DataFrame, run: str, value: str, share: float, place: Column, *keys: str) -> DataFrame:
    """(keys, n, value): the value at 0-based ``place`` (of n), about ``share`` of the way, over the runs of ``kept`` (with ``keys``, a column each).

    ``df`` has the runs' values.  Where the bounds miss the place, all values between the extremes are sorted: the result is
    exact, whatever the sketches say.
    """
    v = F.col(value).cast("double")
    own = keep(bounds(kept, share, *keys), "run-bounds")  # merging draws by chance: what is counted below and what is sorted must have the same bounds
    rows = df.where(F.col(value).isNotNull()).join(kept.select(run, *keys).distinct(), run).select(*keys, v.alias("v"))
    met = rows.join(F.broadcast(own), list(keys)) if keys else rows.crossJoin(F.broadcast(own))  # a row a group of runs
    below = met.groupBy(*keys).agg(F.count_if(F.col("v") < F.col("lo")).alias("under"), F.count_if(F.col("v") <= F.col("hi")).alias("upto"))
    checked = own.join(below, list(keys)) if keys else own.crossJoin(below)
    p = place
    missed = (F.col("under") > p) | (F.col("upto") <= p)
    checked = checked.select(*keys, "n", p.alias("p"), F.when(missed, F.col("least")).otherwise(F.col("lo")).alias("lo"), F.when(missed, F.col("most")).otherwise(F.col("hi")).alias("hi"), F.when(missed, 0).otherwise(F.col("under")).alias("under"))
    some = rows.join(F.broadcast(checked), list(keys)) if keys else rows.crossJoin(F.broadcast(checked))
    counts = some.where("v >= lo AND v <= hi").groupBy(*keys, "n", "p", "under", "v").agg(F.count("*").alias("c"))
    upto = F.col("under") + F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))
    return counts.withColumn("upto", upto).where((F.col("upto") > F.col("p")) & (F.col("upto") - F.col("c") <= F.col("p"))).select(*keys, "n", F.col("v").alias(value))


def p95(kept: DataFrame, df: DataFrame, run: str, value: str, *keys: str) -> DataFrame:
    """Place min(int(0.95 n), n - 1), as ``evaluate.p95_runner``, over many runs."""
    return nth(kept, df, run, value, 0.95, F.least(F.floor(F.col("n") * F.lit(0.95)), F.col("n") - 1), *keys)
