"""Near copies by b-bit MinHash, confirmed on the full sets of shingles.

Each distinct set of shingles has 128 minima.  Bands of four minima give the buckets in which candidates meet; of each
minimum the lowest four bits are kept, 64 bytes a set.  Within a bucket the similarity is estimated from the
packed bits: minima that differ have equal bits once in sixteen, so a share m of unequal fields stands for 1 - m 16/15.
Sets whose estimate is within four deviations of the wanted similarity, or above, are joined to clusters,
and within each cluster the links are confirmed on the whole sets, which are made anew from the texts.

A pair of similarity 0.8 misses all 32 buckets with a probability of 5e-8, and its estimate falls short with 3e-5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import floor, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bitfilter import bit_filter, hit
from tessera.llm.common import components, save, table, temporary

SIZE, SIMILARITY = 4, (80, 100)
HASHES, ROWS, BITS = 128, 4, 4
BANDS, FIELDS = HASHES // ROWS, 64 // BITS
#: Rows of a bucket that are compared in one go (8 MB), elements of a cluster's sets, and rows that are broadcast.  Fuller buckets
#: and clusters are dealt in blocks of half as much, two of which meet in a task.
HELD_BUCKET, HELD_SETS, HELD_ROWS = 100_000, 2_000_000, 200_000
_RNG = np.random.default_rng(42)
_A = _RNG.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2)
_STEP = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
_LOWEST = np.uint64(sum(1 << k for k in range(0, 64, BITS)))


def most_unequal(similarity: float) -> int:
    """Unequal fields of pairs of just ``similarity``, and four deviations more."""
    q = 1 - 2.0**-BITS
    m = (1 - similarity) * q
    return floor(HASHES * m + 4 * sqrt(HASHES * m * (1 - m)))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of ``size`` words as sorted 64-bit hashes; fewer words are one shingle, none give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([h(b" ".join(words), len(words))], np.uint64)
    each = np.fromiter(map(h, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = each[:n].copy()
    for k in range(1, size):
        out *= np.uint64(_STEP[0])
        out += each[k : k + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(_STEP[1])
    out ^= out >> np.uint64(29)
    return np.unique(out)


def minima(of: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 2**64 - 1, np.uint64)
    for k in range(0, len(of), 512):
        np.minimum(out, (_A[:, None] * of[None, k : k + 512] + _B[:, None]).min(1), out=out)
    return out


def packed(least: np.ndarray) -> bytes:
    """The lowest bits of the minima's upper halves (the lower ones follow from the shingles' own lowest bits)."""
    low = (least >> np.uint64(32)) & np.uint64((1 << BITS) - 1)
    shift = np.arange(FIELDS, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(-1, FIELDS) << shift, axis=1).astype("<u8").tobytes()


def bands(least: np.ndarray) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many fields of two packed signatures differ, row by row."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & _LOWEST).sum(1, dtype=np.int64)


def _sign(size: int):
    names = ["doc_id", "row_key", "n", "digest", "sig", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig, keys = [], [], [], []
            for t in batch.column(2):
                s = shingles(t.as_py(), size)
                n.append(len(s))
                least = minima(s) if len(s) else None
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(packed(least) if len(s) else None)
                keys.append(bands(least) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names)

    return run


def flood(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links of 0..n-1 that connect all that ``near`` links (of a number and the others left, which are near): what is
    reached no longer takes part, so alike rows cost little."""
    out, left, front = [], np.arange(n), []
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
        k = front.pop()
        found = near(k, left)
        if found.any():
            got = left[found].tolist()
            out += [(k, g) for g in got]
            front += got
            left = left[~found]
    return out


def _sorted_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list]:
    """The columns of each run of rows that agree in their first ``keys`` columns; batches are sorted by these."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        starts = np.nonzero((key[:, 1:] != key[:, :-1]).any(0))[0] + 1
        if held and any(held[-1].column(k)[-1].as_py() != key[k, 0] for k in range(keys)):
            yield pa.Table.from_batches(held).columns
            held = []
        for a, b in zip([0, *starts.tolist()], [*starts.tolist(), batch.num_rows], strict=True):
            if a and held:
                yield pa.Table.from_batches(held).columns
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).columns


def _join_buckets(most: int):
    """Links that connect, in each bucket, all whose estimates are high enough: rows (key, i, j, uid, sig), sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def two() -> pa.RecordBatch:
            ids, sig = np.array([p[0] for p in pairs], np.int64), np.stack([p[1] for p in pairs])
            ok = unequal(sig[:, 0], sig[:, 1]) <= most
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids[ok].min(1)), pa.array(ids[ok].max(1))], ["a", "b"])

        for columns in _sorted_runs(batches, 3):
            uid = columns[3].to_numpy()
            sig = np.frombuffer(b"".join(columns[4].to_pylist()), "<u8").reshape(len(uid), -1)
            if len(uid) == 2:  # the most frequent bucket: many at once
                pairs.append((uid, sig))
                if len(pairs) == 10_000:
                    yield two()
            elif len(uid) > 2:
                got = flood(len(uid), lambda k, left, sig=sig: unequal(sig[left], sig[k]) <= most)
                at = uid[np.array(got, np.int64).reshape(-1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(at.min(1)), pa.array(at.max(1))], ["a", "b"])
        if pairs:
            yield two()

    return run


def _confirm(size: int, most: int, similarity: tuple[int, int]):
    """Links that connect, in each cluster, all sets that are similar: rows (cluster, i, j, uid, sig, text), sorted."""
    part, of = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _sorted_runs(batches, 3):
            uid, first = np.unique(columns[3].to_numpy(), return_index=True)  # a row that is repeated whole comes again
            if len(uid) < 2:
                continue
            sig = np.frombuffer(b"".join(columns[4].take(pa.array(first)).to_pylist()), "<u8").reshape(len(uid), -1)
            sets = [shingles(columns[5][k].as_py(), size) for k in first.tolist()]
            n = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            del sets
            known, codes = np.unique(flat, return_inverse=True)
            start = np.concatenate([[0], np.cumsum(n)])
            mark = np.zeros(len(known), bool)

            def near(k, left):
                # Similarity bounds the sizes; the estimate spares most of the sets that are not similar.
                some = (of * np.minimum(n[left], n[k]) >= part * np.maximum(n[left], n[k])) & (unequal(sig[left], sig[k]) <= most)
                at = np.nonzero(some)[0]
                if len(at):
                    mine = codes[start[k] : start[k + 1]]
                    mark[mine] = True
                    met = np.array([np.count_nonzero(mark[codes[start[x] : start[x + 1]]]) for x in left[at].tolist()])
                    mark[mine] = False
                    some[at] = of * met >= part * (n[left[at]] + n[k] - met)
                return some

            got = uid[np.array(flood(len(uid), near), np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(got.min(1)), pa.array(got.max(1))], ["a", "b"])

    return run


def _dealt(rows: DataFrame, key: str, blocks: str, *columns: str) -> DataFrame:
    """(key, i, j, columns): a row for each pair of blocks that its own takes part in; one row where there is one block."""
    own = F.pmod(F.xxhash64("uid"), F.col(blocks)).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col(blocks) - 1), lambda x: (x != own) | (F.col(blocks) == 1))
    each = rows.select("*", own.alias("own"), F.explode(others).alias("other"))
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = each.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *columns)
    return at.repartition(parts, key, "i", "j").sortWithinPartitions(key, "i", "j")


def _blocks(n, held: int):
    """One, or as many that two of them hold ``held``."""
    return F.when(n <= held, 1).otherwise(F.greatest(F.lit(2), F.ceil(2 * n / held))).cast("int")


def near_copies(docs: DataFrame, size: int = SIZE, similarity: tuple[int, int] = SIMILARITY, held_bucket: int = HELD_BUCKET, held_sets: int = HELD_SETS, held_rows: int = HELD_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable over links, its own included), kept.

    Documents are linked if the intersection of their sets of shingles is at least ``similarity`` of the union.  Null and
    empty texts have no shingles and are linked with nothing.  Rows without doc_id take part and name no component (null
    where no row of it has an id; kept only there); repeated rows give repeated rows.  Very long texts are read whole; other columns
    are not read.  No rows, no rows.
    """
    spark, most = docs.sparkSession, most_unequal(similarity[0] / similarity[1])
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), "text")
    with temporary(spark):
        rows = save(given.mapInArrow(_sign(size), "doc_id long, row_key long, n long, digest binary, sig binary, keys array<long>"), "minhash-rows", kept=True)
        whole = rows.where("digest IS NOT NULL")
        units = whole.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("row_key"), F.min("n").alias("n"), F.min_by(F.struct("sig", "keys"), "row_key").alias("s"))
        units = save(units.select(F.monotonically_increasing_id().alias("uid"), "digest", "least", "row_key", "n", "s.sig", "s.keys"), "minhash-sets")
        named = units.select("digest", "uid", "least")
        links = _links(given, units, size, most, similarity, held_bucket, held_sets, held_rows)
        comp = save(components(links), "minhash-cc")
        named = named.join(comp, named.uid == comp.id, "left").select("digest", "least", F.coalesce("component", "uid").alias("component"))
        least = save(named.groupBy("component").agg(F.min("least").alias("component_id")), "minhash-least")
        named = save(named.join(least, "component").select("digest", "component_id"), "minhash-named", kept=True)
    out = rows.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _links(given: DataFrame, units: DataFrame, size: int, most: int, similarity: tuple[int, int], held_bucket: int, held_sets: int, held_rows: int) -> DataFrame:
    """(a, b): links of ``units`` that connect all whose sets are similar."""
    spark = given.sparkSession
    keys = units.select("uid", F.explode("keys").alias("key"))
    shared = save(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "minhash-shared")
    met = save(keys.join(shared.hint("merge"), "key").select("key", "uid", _blocks(F.col("m"), held_bucket).alias("blocks")), "minhash-met")
    met = save(met.join(units.select("uid", "sig"), "uid"), "minhash-buckets")
    joined = _dealt(met, "key", "blocks", "uid", "sig").mapInArrow(_join_buckets(most), "a long, b long").distinct()
    clusters = save(components(joined).withColumnsRenamed({"id": "uid", "component": "cluster"}), "minhash-clusters")
    in_one = clusters.join(units.select("uid", "row_key", "n", "sig"), "uid")
    sizes = in_one.groupBy("cluster").agg(_blocks(F.sum("n"), held_sets).alias("blocks"))
    asked = save(in_one.drop("n").join(sizes, "cluster"), "minhash-asked")
    if asked.limit(held_rows + 1).count() <= held_rows:
        texts = given.select("row_key", "text").join(F.broadcast(asked), "row_key")  # checked: see HELD_ROWS
    else:  # the filter spares most texts the shuffle, the join decides
        key = hit(bit_filter(asked.select("row_key"), "row_key"), F.col("row_key"))
        texts = given.select("row_key", "text").where(key).join(asked.hint("merge"), "row_key")
    found = _dealt(texts, "cluster", "blocks", "uid", "sig", "text").mapInArrow(_confirm(size, most, similarity), "a long, b long")
    return save(found.distinct(), "minhash-links")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
