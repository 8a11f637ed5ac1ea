"""Line deduplication over sharded cuckoo filters and exact reference counts.

The index is tables in the shared folder: for each line key the number of documents
that hold it, and for each shard of the key space a cuckoo filter of the keys that reach
the threshold.  Filters screen lines; what passes is verified against the exact table.
Documents can be inserted and deleted: counts rise and fall, and a key that crosses the
threshold enters or leaves its shard's filter, so every step can be undone.

A key of up to ``WHOLE`` bytes is held as it is, a longer one as its SHA-256 digest after a newline byte, which no
key holds: equality rests on bytes, or on a digest without known collisions.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, free_name, save, table, tidy
from tessera.llm.cuckoo import CuckooFilter

THRESHOLD = 10
#: Bytes of the longest key that is held as it is.
WHOLE = 32
#: Frequent keys that a shard's filter is meant for; the number of shards follows the number of frequent keys.
SHARD_KEYS = 50_000
#: Most bytes of filters that a task holds at once; more are gone through in blocks of shards.
HELD_FILTERS = 64 << 20
#: Most frequent keys that are handed to every task to verify hits; more are joined with the hits by key.
HELD_KEYS = 200_000
_WHITE = SPACES.encode()


def split_lines(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a whole text in UTF-8, and each line's key."""
    data = (text or "").encode("utf-8", "surrogatepass")
    keys = [x.strip(_WHITE) for x in data.lower().split(b"\n")]  # bytes.lower maps A-Z only
    return data.split(b"\n"), [k if len(k) <= WHOLE else b"\n" + hashlib.sha256(k).digest() for k in keys]


def as_pairs(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each key; the lowest bits of the first tell its shard, as Spark's ``xxhash64`` does."""
    a, b = xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest
    return np.array([(a(k, 42), b(k)) for k in keys], np.uint64).reshape(-1, 2)


def _shard(shards: int) -> Column:
    return F.xxhash64("key").bitwiseAND(F.lit(shards - 1)).cast("int")


def reference_counts(docs: DataFrame) -> DataFrame:
    """(key, n): the number of documents of ``docs`` that hold each non-empty key.

    Rows of one doc_id are one document; rows without doc_id are a document each.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[bytes] = Counter()
            for t in batch.column(0):
                n.update(set(split_lines(t.as_py())[1]))
            n.pop(b"", None)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["key", "n"])

    @tidy
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                keys = [k for k in set(split_lines(text.as_py())[1]) if k]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * len(keys), doc_id.type), pa.array(keys, pa.binary())], ["doc_id", "key"])

    again = save(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return docs.select("text").mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = docs.select("doc_id", "text").join(again, "doc_id", "left_anti").select("text").mapInArrow(run, "key binary, n long")
    pairs = docs.select("doc_id", "text").join(again, "doc_id", "left_semi").mapInArrow(each, f"doc_id {kind}, key binary").distinct()
    return rest.union(pairs.select("key", F.lit(1).cast("long"))).groupBy("key").agg(F.sum("n").alias("n"))


class LineIndex:
    """Reference counts and filters of a set of documents."""

    def __init__(self, counts: DataFrame, filters: DataFrame, threshold: int, shards: int) -> None:
        self.counts, self.filters, self.threshold, self.shards = counts, filters, threshold, shards

    @classmethod
    def build(cls, docs: DataFrame, threshold: int = THRESHOLD) -> LineIndex:
        spark = docs.sparkSession
        empty = spark.createDataFrame([], "shard int, filter binary")
        none = spark.createDataFrame([], "key binary, n long")
        return cls(none, empty, threshold, 1)._moved(reference_counts(docs))

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the documents of ``docs``, whose ids are new."""
        return self._moved(reference_counts(docs))

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take back ``docs``, which must have been inserted with the same ids and texts."""
        return self._moved(reference_counts(docs).select("key", (-F.col("n")).alias("n")))

    def _moved(self, change: DataFrame) -> LineIndex:
        threshold = self.threshold
        both = self.counts.select("key", F.col("n").alias("old"), F.lit(0).cast("long").alias("d")).union(change.select("key", F.lit(0).cast("long"), "n"))
        merged = save(both.groupBy("key").agg(F.sum("old").alias("old"), F.sum("d").alias("d")).withColumn("n", F.col("old") + F.col("d")), "line-counts")
        out = LineIndex(merged.select("key", "n").where("n > 0"), self.filters, threshold, self.shards)
        crossed = merged.where((F.col("n") >= threshold) != (F.col("old") >= threshold)).select("key", (F.col("n") >= threshold).alias("enters"))
        needed = 1 << max(0, int(np.ceil(np.log2(max(1, out.frequent().count()) / SHARD_KEYS))))
        if needed > self.shards:  # shards of a new number are built from the counts
            return LineIndex(out.counts, self.filters.limit(0), threshold, needed)._built(out.frequent().withColumn("enters", F.lit(True)))
        return out._built(crossed)

    def _built(self, crossed: DataFrame) -> LineIndex:
        def update(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            leaves, enters = (as_pairs(new["key"][new["enters"] == x].tolist()) for x in (False, True))
            shard = int(new["shard"].iloc[0]) if len(new) else int(old["shard"].iloc[0])
            if not len(old):
                return pd.DataFrame({"shard": [shard], "filter": [CuckooFilter.of(enters).tobytes()]})
            f = CuckooFilter.frombytes(old["filter"].iloc[0])
            f.delete(leaves)
            # A filter that is full takes no more marks and is built anew by ``refill``.
            return pd.DataFrame({"shard": [shard], "filter": [f.tobytes() if f.insert(enters) else None]})

        dealt = crossed.withColumn("shard", _shard(self.shards)).groupBy("shard")
        filters = save(self.filters.groupBy("shard").cogroup(dealt).applyInPandas(update, "shard int, filter binary"), "line-filters")
        out = LineIndex(self.counts, filters, self.threshold, self.shards)
        return out.refill() if not filters.where(F.col("filter").isNull()).isEmpty() else out

    def refill(self) -> LineIndex:
        """Build the filters of full shards anew, at the size that their keys need."""
        full = self.filters.where(F.col("filter").isNull()).select("shard")
        keys = self.frequent().withColumn("shard", _shard(self.shards)).join(full, "shard")

        def make(own: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [int(own["shard"].iloc[0])], "filter": [CuckooFilter.of(as_pairs(own["key"].tolist())).tobytes()]})

        made = keys.groupBy("shard").applyInPandas(make, "shard int, filter binary")
        return LineIndex(self.counts, save(self.filters.where(F.col("filter").isNotNull()).union(made), "line-filters"), self.threshold, self.shards)

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n") >= self.threshold).select("key")


class Screen:
    """The filters that a task holds."""

    def __init__(self, filters: dict[int, bytes], shards: int) -> None:
        self.filters = {k: CuckooFilter.frombytes(v) for k, v in filters.items()}
        self.mask = np.uint64(shards - 1)

    def hits(self, keys: list[bytes]) -> list[bytes]:
        """The keys that may be frequent; the others are not, or their shards are not held."""
        pairs, out = as_pairs(keys), []
        own = (pairs[:, 0] & self.mask).astype(np.int64)
        for s in np.unique(own).tolist():
            if s in self.filters:
                at = np.nonzero(own == s)[0]
                out += [keys[k] for k in at[self.filters[s].has(pairs[at])].tolist()]
        return out


_RESULT = "n_lines long, n_dropped long, kept_text string, kept_sha256 string"


def _results(lines: list[tuple[list[bytes], list[bytes]]], gone: list[set[bytes]], texts: bool) -> pd.DataFrame:
    rows = []
    for (own, keys), out in zip(lines, gone, strict=True):
        kept = b"\n".join([x for x, k in zip(own, keys, strict=True) if k not in out] if out else own)
        rows.append((len(own), sum(k in out for k in keys) if out else 0, kept.decode("utf-8", "surrogatepass") if texts else None, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept_text", "kept_sha256"]).astype({"n_lines": "int64", "n_dropped": "int64"})


def _blocks(filters: DataFrame, held: int) -> list[list[int]]:
    """Numbers of shards whose filters are held together."""
    out: list[list[int]] = []
    room = 0
    for r in filters.select("shard", F.octet_length("filter").alias("size")).orderBy("shard").collect():  # one row a shard
        if not out or r.size > room:
            out.append([])
            room = held
        out[-1].append(r.shard)
        room -= r.size
    return out


def dropped(docs: DataFrame, index: LineIndex, name: str, held_keys: int = HELD_KEYS, texts: bool = True, held_filters: int = HELD_FILTERS) -> DataFrame:
    """``docs`` with a column ``name``, a structure of n_lines, n_dropped, kept_text (null unless ``texts``), kept_sha256.

    Lines whose key is empty are never dropped.  Null texts are one empty line.  Every row of
    ``docs`` stays, repeated ones too; a document whose lines all go keeps an empty text.  Very long texts and lines
    are read whole; ties do not arise, a key at the threshold is frequent.  No rows, no rows.
    Lines are screened by the filters, in blocks of shards if these are large.  Hits are verified by the exact keys:
    up to ``held_keys`` of them in the task itself; beyond, hits are joined with the counts by key and gathered for each row.
    """
    spark = docs.sparkSession
    keys, shards = index.frequent(), index.shards
    blocks = _blocks(index.filters, held_filters)

    def held(block: list[int]) -> dict[int, bytes]:
        return {r.shard: bytes(r.filter) for r in index.filters.where(F.col("shard").isin(block)).toLocalIterator()}

    if len(blocks) <= 1 and keys.count() <= held_keys:
        exact = frozenset(map(bytes, keys.toPandas()["key"]))
        shared = spark.sparkContext.broadcast((exact, held(blocks[0]) if blocks else {}))

        @F.pandas_udf(_RESULT)
        @tidy
        def screened(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            exact, filters = shared.value
            screen = Screen(filters, shards)
            for batch in batches:
                parts = []
                for s in range(0, max(1, len(batch)), 1000):
                    lines = [split_lines(t) for t in batch.iloc[s : s + 1000]]
                    out = exact.intersection(screen.hits(list({k for _, own in lines for k in own if k})))
                    parts.append(_results(lines, [out] * len(lines), texts))
                yield pd.concat(parts)

        return docs.withColumn(name, screened(F.col("text")))

    row, hits = free_name(docs, "row"), free_name(docs, "hits")
    rows = save(docs.withColumn(row, F.monotonically_increasing_id()), "line-rows")
    found = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(held(block))

        @tidy
        def explode(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            screen = Screen(shared.value, shards)
            for batch in batches:
                own = [(i, k) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for k in set(split_lines(t.as_py())[1]) if k]
                some = set(screen.hits(list({k for _, k in own})))
                own = [x for x in own if x[1] in some]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.binary())], ["row", "key"])

        part = rows.select(row, "text").mapInArrow(explode, "row long, key binary")
        found = part if found is None else found.union(part)
    sure = save(found, "line-hits").join(save(keys, "line-frequent"), "key").groupBy(F.col("row").alias(row)).agg(F.collect_set("key").alias(hits))

    @F.pandas_udf(_RESULT)
    @tidy
    def joined(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, own in batches:
            yield _results([split_lines(t) for t in text], [set() if h is None else set(map(bytes, h)) for h in own], texts)

    return rows.join(sure, row, "left").select(*docs.columns, joined(F.col("text"), F.col(hits)).alias(name))


def drop_lines(docs: DataFrame, index: LineIndex, held_keys: int = HELD_KEYS, texts: bool = True, held_filters: int = HELD_FILTERS) -> DataFrame:
    """``docs`` with the columns of ``dropped`` after its own.  A column of ``docs`` that has one of their names keeps
    it and its values; the new column has underscores before its name then."""
    kept = free_name(docs, "kept")
    out = dropped(docs, index, kept, held_keys, texts, held_filters)
    return out.select(*docs.columns, *(F.col(kept)[c].alias(free_name(docs, c)) for c in ("n_lines", "n_dropped", "kept_text", "kept_sha256")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = LineIndex.build(docs)
    return drop_lines(docs.select("doc_id", "text"), index, texts=False).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


#: DuckDB: count keys by document, drop the frequent ones, join the other lines again.
ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
