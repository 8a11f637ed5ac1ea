"""Keyed tables: snapshots that tables share, merges that move only the batch, repeated batches."""

import pytest
from pyspark.sql import SparkSession

from tessera.operators.keyed import KeyedStore

TABLES = {"chunks": ("id", "id string, v int"), "vectors": ("id", "id string, x double")}


def rows(df):
    return sorted(map(tuple, df.collect()))


def of(spark, *r):
    return spark.createDataFrame([(k, v, n) for n, (k, v) in enumerate(r)], "id string, v int, n int")


def test_transactions_are_seen_whole(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", TABLES, buckets=4)
    assert rows(store.read("chunks")) == [] and store.versions() == []
    with store.transaction() as tx:
        tx.insert_ignore("chunks", of(spark, ("a", 1), ("b", 2), ("a", 1), (None, 9)))
        tx.insert_ignore("vectors", spark.createDataFrame([("a", 0.5), ("b", 0.25)], "id string, x double"))
    with pytest.raises(ZeroDivisionError), store.transaction() as tx:
        tx.insert_ignore("chunks", of(spark, ("c", 3)))
        1 / 0  # noqa: B018 - the second store fails
    assert rows(store.read("chunks")) == [("a", 1), ("b", 2)] and store.versions() == [1]
    with store.transaction() as tx:
        tx.upsert("chunks", of(spark, ("b", 20), ("b", 21), ("d", 4)), "n")
        tx.insert_ignore("chunks", of(spark, ("d", 5), ("e", 6)))  # sees what the transaction put in
    assert rows(store.read("chunks")) == [("a", 1), ("b", 21), ("d", 4), ("e", 6)]
    assert rows(store.read("chunks", 1)) == [("a", 1), ("b", 2)] and rows(store.read("vectors")) == [("a", 0.5), ("b", 0.25)]
    # Another session finds the tables by their manifest.
    other = KeyedStore(SparkSession.newSession(spark), f"file://{tmp_path}/s", TABLES, buckets=4)
    for g in [g["gen"] for gs in store._manifest()["tables"].values() for g in gs]:
        spark.sql(f"DROP TABLE IF EXISTS {g}")
    assert rows(other.read("chunks")) == rows(store.read("chunks"))
    with store.transaction() as late, other.transaction() as tx:
        tx.insert_ignore("chunks", of(spark, ("z", 1)))
        late.upsert("chunks", of(spark, ("a", 7)), "n")
        with pytest.raises(RuntimeError):
            store._publish({**store._manifest(1), "version": 1})
        late.new.clear()
    store.compact()
    assert rows(store.read("chunks")) == [("a", 1), ("b", 21), ("d", 4), ("e", 6), ("z", 1)] and len(store.versions()) == 1
    assert len(store._manifest()["tables"]["chunks"]) == 1


def test_batches_that_come_again_change_nothing(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", TABLES, buckets=2)
    for number, value in ((0, 1), (1, 2), (1, 3), (0, 4)):
        with store.transaction(("stream", number)) as tx:
            tx.upsert("chunks", of(spark, ("a", value)), "n")
    assert rows(store.read("chunks")) == [("a", 2)] and store.versions() == [1, 2]


def test_only_the_batch_moves(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", TABLES, buckets=8)
    with store.transaction() as tx:
        tx.insert_ignore("chunks", spark.range(5000).selectExpr("concat('k', id) AS id", "cast(id AS int) AS v"))
    with store.transaction() as tx:
        tx.upsert("chunks", spark.range(0, 5000, 7).selectExpr("concat('k', id) AS id", "-1 AS v", "id AS n"), "n")
    # Reading merges within buckets: no exchange at all.
    plan = store.read("chunks")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert store.read("chunks").where("v = -1").count() == 715 and store.read("chunks").count() == 5000
    # A large batch is the only side that is dealt, a small one reads the buckets of its keys.
    tx = next(iter([store.transaction().__enter__()]))
    many = spark.range(2000, 9000).selectExpr("concat('k', id) AS id", "1 AS v")
    plan = tx.missing("chunks", many)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Range" in plan.split("Exchange hashpartitioning")[1].split("FileScan")[0]
    assert tx.missing("chunks", many).count() == 4000
    few = tx.missing("chunks", many.limit(1))
    assert "SelectedBucketsCount: 1 out of 8" in few._jdf.queryExecution().toString()


def test_both_indexes_take_a_stream_together(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.streaming.ingest import INDEXES, ingest_indexed

    store = KeyedStore(spark, f"file://{tmp_path}/s", INDEXES, buckets=4)
    source, schema = str(tmp_path / "in"), "source string, text string"
    down = []

    def embed(chunks):
        if down:
            raise ConnectionError("down")
        return chunks.select("chunk_id", F.array(F.length("content").cast("float")).alias("embedding"))

    def run(checkpoint, *new):
        if new:
            spark.createDataFrame(list(new), schema).coalesce(1).write.mode("append").parquet(source)
        q = ingest_indexed(spark.readStream.schema(schema).parquet(source), store, embed, str(tmp_path / checkpoint), size=4, overlap=1, least=1)
        try:
            q.awaitTermination(120)
        except Exception as e:  # noqa: BLE001 - the stream ends with its provider's failure
            assert "down" in str(e)
        a, b = (sorted(r.chunk_id for r in store.read(t).collect()) for t in INDEXES)
        assert a == b and len(set(a)) == len(a)
        return len(a)

    assert run("cp", ("a", "one two three. four five six")) == 2
    down.append(True)
    assert run("cp", ("b", "seven eight nine. ten eleven twelve")) == 2  # neither index changed
    down.clear()
    assert run("cp") == 4
    assert run("lost checkpoint") == 4
