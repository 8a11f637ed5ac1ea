"""Bit filters of bounded size, which thin out rows before an exact join or count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import tidy

FILTER_BITS = 27  # at most 2^27 bits, 16 MB
_MULTIPLIER = np.uint64(0xC2B2AE3D27D4EB4F)


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    k = keys.view(np.uint64)
    return np.concatenate([k >> np.uint64(64 - bits), (k * _MULTIPLIER) >> np.uint64(64 - bits)])


def bit_filter(keys: DataFrame, column: str) -> bytes:
    """A filter of the longs in ``column``; tasks set bits in blocks, the driver gets at most 16 MB."""
    n = keys.count()
    bits = int(min(FILTER_BITS, max(16, np.ceil(np.log2(16 * n + 1)))))
    block = 1 << 16  # bits a block

    @tidy
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.unique(_places(b.column(0).to_numpy(), bits)).astype(np.int64)
            for k in np.unique(at // block):
                bit = at[at // block == k] % block
                np.bitwise_or.at(own.setdefault(int(k), np.zeros(block // 8, np.uint8)), bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([x.tobytes() for x in own.values()], pa.binary())], ["block", "bits"])

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": g["block"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in g["bits"]]).tobytes()]})

    parts = max(24, keys.sparkSession.sparkContext.defaultParallelism)  # a task sends a filter at most
    got = keys.select(column).coalesce(parts).mapInArrow(mark, "block int, bits binary").groupBy("block").applyInPandas(merge, "block int, bits binary").toPandas()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for k, v in zip(got["block"], got["bits"], strict=True):
        out[k * block // 8 : (k + 1) * block // 8] = np.frombuffer(v, np.uint8)
    return out.tobytes()


def hits(data: bytes, keys: np.ndarray) -> np.ndarray:
    f = np.frombuffer(data, np.uint8)
    at = _places(keys, (len(f) * 8).bit_length() - 1).reshape(2, -1)
    found = f[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1
    return found.all(0)


def hit(data: bytes, key: Column) -> Column:
    """Whether a long may be in the filter; false is certain."""
    shared = SparkSession.active().sparkContext.broadcast(data)

    @F.pandas_udf("boolean")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(hits(shared.value, keys.to_numpy(np.int64)))

    return run(key)
