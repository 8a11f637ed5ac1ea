"""Prefix doubling over every byte position, ranked by Spark.

The full form of the method behind ``substrings``: positions start with their byte as rank; at offsets 1, 2, 4, ...
each position's rank is paired with the rank that far on, pairs are counted, positions of a unique pair drop out, and
the others take the smallest number of their pair's positions as their new rank.  The last offset overlaps, so that any
width is reached.  Its cost is in the README: it is for small tables, and to hold ``substrings`` against.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import save, temporary


def repeated(docs: DataFrame, width: int = 200) -> DataFrame:
    """(rid, place): where in ``docs`` (rid, text) a string of ``width`` bytes, two or more, starts that also starts anywhere else.

    ``rid`` are distinct longs.  Null and shorter texts have no such place, very long ones are read whole.  No rows, no rows.
    """

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                for s in range(0, len(data) if len(data) >= width else 0, 1 << 16):
                    own = data[s : s + (1 << 16)].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), rid)), pa.array(np.arange(s, s + len(own))), pa.array(own)], ["rid", "place", "r"])

    with temporary(docs.sparkSession):
        now = save(docs.select("rid", "text").mapInArrow(positions, "rid long, place long, r long"), "places")
        length = 1
        while length < width:
            step = min(length, width - length)
            # One shuffle brings a position's rank and the one ``step`` on together; where that is gone, the pair is unique.
            both = now.select("rid", "place", F.col("r").alias("a"), F.lit(None).cast("long").alias("b")).union(now.where(F.col("place") >= step).select("rid", F.col("place") - step, F.lit(None).cast("long"), "r"))
            pairs = both.groupBy("rid", "place").agg(F.max("a").alias("a"), F.max("b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
            pairs = save(pairs.withColumn("id", F.monotonically_increasing_id()), "pairs")
            ranks = pairs.groupBy("a", "b").agg(F.min("id").alias("r"), F.count("*").alias("n")).where("n > 1").select("a", "b", "r")
            now = save(pairs.join(ranks.hint("merge"), ["a", "b"]).select("rid", "place", "r"), "places")
            length += step
        return save(now.select("rid", "place"), "repeated", kept=True)
