"""Quantiles over runs by merged sketches against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import runs


@pytest.mark.parametrize("error", [0.0025, -0.4])
def test_quantiles_over_runs_are_exact(spark, tmp_path, error, monkeypatch):
    """Also where the bounds miss the place, which the second error makes them do."""
    monkeypatch.setattr(runs, "ERROR", error)
    rng = random.Random(1)
    rows = [(f"r{k % 7}", "ab"[k % 7 % 2], rng.choice([rng.gauss(50, 9), float(rng.randrange(100)), None])) for k in range(30_000)]
    df = spark.createDataFrame(rows, "run string, suite string, ms double").repartition(3)
    path = str(tmp_path / "kept")
    for k in range(7):  # each run appends its own sketch
        runs.sketches(df.where(F.col("run") == f"r{k}"), "run", "ms").withColumn("suite", F.lit("ab"[k % 2])).write.mode("append").parquet(path)
    kept = spark.read.parquet(path)
    assert kept.count() == 7
    for keys in ((), ("suite",)):
        got = {tuple(r[k] for k in keys): (r.n, r.ms) for r in runs.p95(kept, df.drop("suite"), "run", "ms", *keys).collect()}
        want = {}
        for g in {tuple(s for _ in keys) for _, s, _ in rows}:
            v = sorted(ms for _, s, ms in rows if ms is not None and (not keys or s == g[0]))
            want[g] = (len(v), v[min(int(0.95 * len(v)), len(v) - 1)])
        assert got == want
    some = kept.where("run < 'r2'")
    v = sorted(ms for r, _, ms in rows if r < "r2" and ms is not None)
    assert runs.p95(some, df.drop("suite"), "run", "ms").first().ms == v[int(0.95 * len(v))]
    assert runs.p95(kept.limit(0), df.drop("suite"), "run", "ms").collect() == []


def test_bounds_are_narrow(spark):
    df = spark.range(200_000).selectExpr("id % 20 AS run", "cast(id AS double) AS ms")
    b = runs.bounds(runs.sketches(df, "run", "ms"), 0.95).first()
    assert b.n == 200_000 and b.lo <= 190_000 <= b.hi and b.hi - b.lo < 0.02 * 200_000


def test_large_runs_are_exact_though_merging_draws_by_chance(spark):
    """Sketches that were compacted give other bounds each time they are merged; values below and between must be told by the same."""
    df = spark.range(0, 60_000, 1, 4).selectExpr("id % 3 AS run", "id % 2 AS suite", "cast(pmod(xxhash64(id), 1000003) AS double) AS ms")
    kept = spark.createDataFrame(runs.sketches(df, "run", "ms").crossJoin(spark.range(1).select("id")).drop("id").collect(), f"run bigint, {runs.SCHEMA}")
    v = sorted(r.ms for r in df.collect())
    for _ in range(3):
        assert runs.p95(kept, df, "run", "ms").first().ms == v[int(0.95 * len(v))]
