"""Cells too full for a task at a wide distance."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import components


DISTANCE, GROUPS = 6, 9


@pytest.mark.parametrize("flips", [3, 12])
def test_full_cells_at_a_wide_distance(spark, monkeypatch, flips):
    monkeypatch.setattr(simhash, "HELD", 3)
    rng = random.Random(flips)
    base = rng.getrandbits(63)
    fps = {base}
    while len(fps) < 40:
        x = base
        for k in rng.sample(range(63), rng.randint(1, flips)):
            x ^= 1 << k
        fps.add(x)
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), DISTANCE, GROUPS, 1, 64).distinct()
    assert not found.where(simhash.hamming(F.col("a"), F.col("b")) > DISTANCE).count()
    comp = {r.id: r.component for r in components(found).collect()}
    parent = {x: x for x in fps}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= DISTANCE:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {x: comp.get(x, x) for x in fps} == {x: find(x) for x in fps}
