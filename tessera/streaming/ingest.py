"""Structured Streaming: corpus maintenance, rate windows, keyed state with a time to live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.ingest import chunks
from tessera.operators.keyed import KeyedStore
from tessera.operators.tables import insert_ignore
from tessera.schemas import CHUNK
from tessera.storage import keep


def ingest_stream(spark: SparkSession, incoming: DataFrame, table_path: str, checkpoint: str, **sizes: int) -> StreamingQuery:
    """Chunk each micro-batch of (source, text) and append the chunks whose id the table lacks.

    Runs what is there and stops (``availableNow``).  Appending after an anti-join makes a
    batch that is run again harmless.
    """

    def add(batch: DataFrame, _: int) -> None:
        new = chunks(batch.select("source", "text"), **sizes)
        try:
            old = spark.read.schema(CHUNK).parquet(table_path)
            old.limit(1).count()
        except Exception:  # noqa: BLE001 - the first batch finds no table
            old = spark.createDataFrame([], CHUNK)
        insert_ignore(old, new, "chunk_id").write.mode("append").parquet(table_path)

    return incoming.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The two indexes of a corpus as tables of one store.
INDEXES = {"chunks": ("chunk_id", CHUNK), "vectors": ("chunk_id", "chunk_id string, embedding array<float>")}


def ingest_indexed(incoming: DataFrame, store: KeyedStore, embed: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "ingest", **sizes: int) -> StreamingQuery:
    """Chunk each micro-batch of (source, text) and put new chunks and their vectors in one snapshot of ``store`` (of ``INDEXES``).

    ``embed`` gives (chunk_id, embedding) of chunks.  If either index fails, neither changes and the batch is run again; a batch
    that was committed before changes nothing.  The store's rows stay where they are: only the batch is dealt.
    """

    def add(batch: DataFrame, number: int) -> None:
        with store.transaction((name, number)) as tx:
            if not tx.repeated:
                new = keep(tx.missing("chunks", chunks(batch.select("source", "text"), **sizes).dropDuplicates(["chunk_id"])), "ingest")
                tx.insert_ignore("chunks", new)
                tx.insert_ignore("vectors", embed(new))

    return incoming.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_counts(events: DataFrame, key: str, at: str, window: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Tumbling counts by key; event times without zone are read as session time."""
    t = events.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", lateness)
    return t.groupBy(F.window("_t", window), key).agg(F.count("*").alias("n"))


def unseen(stream: DataFrame, key: str, at: str, ttl: str = "7 days") -> DataFrame:
    """Each key once within its time to live: deduplication state is dropped after it."""
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])
