"""Workers give back what they held."""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common


def test_a_tidy_task_gives_memory_back_when_it_ends_breaks_or_is_left(monkeypatch):
    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append(1))

    @common.tidy
    def task(batches):
        for b in batches:
            yield 1 // b

    assert list(task(iter([1, 1]))) == [1, 1] and len(told) == 1
    with pytest.raises(ZeroDivisionError):
        list(task(iter([1, 0])))
    left = task(iter([1, 1]))
    next(left)
    left.close()
    assert len(told) == 3 and list(task(iter([]))) == []


def test_spark_runs_tidy_tasks_as_they_are_typed(spark):
    @common.tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches

    @F.pandas_udf("long")
    @common.tidy
    def twice(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield 2 * b

    got = spark.range(100).mapInArrow(rows, "id long").select(twice("id").alias("x"))
    assert sorted(r.x for r in got.collect()) == list(range(0, 200, 2))
    assert spark.range(0).mapInArrow(rows, "id long").select(twice("id")).collect() == []


def test_nothing_in_use_is_given_back():
    kept = pa.array(range(100_000))
    common.give_back()
    assert kept.to_pylist() == list(range(100_000))
