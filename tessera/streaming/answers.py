"""The answer cache as keyed state of a stream: entries that expire, and hits that are counted.

Each key's entry is one value state.  A put replaces it and sets a timer for its end; a get between an entry's creation and
its end is a hit and raises the count; the timer, run by the watermark, drops the entry and tells how often it was hit.
State survives restarts from the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.config import DEFAULTS

#: Times are microseconds here, as they are the same in every time zone.
ENTRY = "answer string, created_us bigint, expires_us bigint, hit_count bigint"
_OUT = "cache_key string, seq bigint, us bigint, kind string, hit boolean, answer string, hit_count bigint"
#: Keyed state with timers is kept by this store; set it before the stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class AnswerEntries(StatefulProcessor):
    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            held, out = self.entry.get() if self.entry.exists() else None, []
            due = held and held[2]
            # Rows come in no order: each chunk's are taken by time, puts before gets of the same time.
            for r in chunk.assign(get=chunk["kind"] != "put").sort_values(["us", "get", "seq"]).itertuples():
                if not r.get:
                    if held is None or held[1] <= r.us:  # no newer entry is there
                        held = (r.answer, r.us, r.us + self.ttl, 0)
                    continue
                hit = held is not None and held[1] <= r.us < held[2]
                if hit:
                    held = (*held[:3], held[3] + 1)
                out.append((key[0], r.seq, r.us, "get", hit, held[0] if hit else None, held[3] if hit else None))
            if held is not None:
                self.entry.update(held)
                if held[2] != due:
                    if due is not None:
                        self.handle.deleteTimer(_timer(due))
                    self.handle.registerTimer(_timer(held[2]))
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        if held is not None and _timer(held[2]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
            yield _frame([(key[0], None, held[2], "expired", None, held[0], held[3])])

    def close(self) -> None:
        pass


def _timer(us: int) -> int:
    return -(-us // 1000)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])
    return out.astype({"seq": "Int64", "us": "int64", "hit_count": "Int64", "hit": "boolean"})


def use_store(spark: SparkSession) -> None:
    spark.conf.set(*STORE)


def answers(stream: DataFrame, ttl_seconds: int = DEFAULTS.cache_ttl_seconds, lateness: str = "0 seconds") -> DataFrame:
    """What becomes of a stream of (cache_key, seq, at, kind, answer), kind ``put`` or ``get``.

    A row for each get (hit or not, the answer, the entry's hits so far), and one for each entry that expired, with its hits.
    Within a micro-batch rows of a key are taken by time within each Arrow batch, so that memory stays bounded for a hot key.
    """
    use_store(stream.sparkSession)
    timed = stream.withWatermark("at", lateness).select("cache_key", "seq", "at", F.unix_micros("at").alias("us"), "kind", "answer")
    out = timed.groupBy("cache_key").transformWithStateInPandas(AnswerEntries(ttl_seconds), outputStructType=_OUT, outputMode="append", timeMode="EventTime")
    return out.select("cache_key", "seq", F.timestamp_micros("us").alias("at"), "kind", "hit", "answer", "hit_count")


def run(out: DataFrame, path: str, checkpoint: str) -> None:
    """Take what is there, write its rows to ``path`` and stop."""
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
