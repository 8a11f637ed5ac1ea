"""One document of each group of near copies, by wide SimHash fingerprints on a grid of segment popcounts.

A text's fingerprint has ``WORDS`` words of 64 bits.  Two-bit segments are mapped to their bit counts; the counts
of some of the segments are a cell of the grid, and a fingerprint lies in many cells, each of its own choice of segments.  Texts that share
a cell and whose first ``CHECK`` words differ in few enough bits are linked: the Manhattan distance of the grid
points of the first two words, which never exceeds the bits that differ, is compared first, then the bits are.
A share p of differing bits stands for the cosine cos(pi p) of the sets of shingles, and that for the
similarity cos / (2 - cos) of sets of one size.

The grid follows the number of texts: a cell takes so many segments that a text meets about ``MATES`` unrelated ones in
each, and there are so many cells that a pair of the least similarity shares one with a probability of 0.95.  So
comparisons grow with N^1.3, not with a square.  The bits keep 95 in a hundred pairs of just that similarity, nearly
all that are more alike, and some that are less.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, floor, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tessera.llm.bitfilter import bit_filter, hit
from tessera.llm.common import components, free_name, save, temporary, tidy

#: Words that are compared, and words whose segments make the cells.
CHECK, GRID = 4, 16
WORDS = CHECK + GRID
#: Unrelated texts that a text meets in a cell, and segments a cell at least.
MATES, LEAST_RUN = 1000, 6
#: Rows of a cell that are compared in one go, some 10 MB; of a fuller cell, blocks of so many rows are compared two by
#: two.  Also the most overfull cells whose numbers are broadcast.
HELD = 200_000
#: Groups of at most so many rows are compared as whole columns.
SMALL = 12
_LOW = np.uint64(0x5555555555555555)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1) for k in range(WORDS)], np.uint64)


def limit(similarity: float) -> int:
    """The most of the first words' bits that may differ: what is expected at the least similarity, and what
    95 in a hundred pairs of just that similarity stay within."""
    n, p = 64 * CHECK, _differing(similarity)
    return floor(n * p + 1.645 * sqrt(n * p * (1 - p)))


def _differing(similarity: float) -> float:
    return acos(2 * similarity / (1 + similarity)) / pi


def grid(texts: int, similarity: float) -> tuple[int, int]:
    """(segments a cell, cells) for so many texts: counts of one segment agree by chance in three of eight pairs, and
    in pairs of ``similarity`` where no bit differs or both do from unlike ones."""
    p = _differing(similarity)
    run = max(LEAST_RUN, ceil(log(max(1, texts) / MATES) / log(8 / 3)))
    return run, ceil(3.3 / ((1 - p) ** 2 + p * p / 2) ** run)


@lru_cache(8)
def _choices(run: int, count: int) -> np.ndarray:
    """The segments of each cell."""
    rng = np.random.default_rng(11)
    return np.stack([rng.permutation(32 * GRID)[:run] for _ in range(count)])


def signature(text: str | None, size: int) -> bytes | None:
    """The fingerprint's words, little-endian, of the distinct shingles; null without any word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return None
    h = xxhash.xxh64_intdigest
    shingles = [b" ".join(words)] if len(words) <= size else map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    each = np.array(list({h(x, 42) for x in shingles}), np.uint64)
    bits = np.zeros(64 * WORDS, np.int64)
    for s in range(0, len(each), 255):  # sums of up to 255 bits fit a byte
        x = each[s : s + 255, None] + _ODD
        x ^= x >> np.uint64(30)
        x *= _MIX[0]
        x ^= x >> np.uint64(27)
        x *= _MIX[1]
        x ^= x >> np.uint64(31)
        bits += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * bits > len(each), bitorder="little").tobytes()


def points(words: np.ndarray) -> np.ndarray:
    """The bit counts of the words' segments, two bits each."""
    upper = words >> np.uint64(1)
    return ((words ^ upper) & _LOW) | ((words & upper & _LOW) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    low = x & _LOW
    return np.bitwise_count(low).astype(np.int64) + 2 * np.bitwise_count((x >> np.uint64(1)) & _LOW & ~low)


def cells(words: np.ndarray, run: int, count: int) -> np.ndarray:
    """The keys of the ``count`` cells of each row of words, one a column, each of ``run`` segments."""
    p = points(words[:, CHECK:])
    bits = np.unpackbits(p.view(np.uint8).reshape(len(p), -1), axis=1, bitorder="little").reshape(len(p), -1, 2)
    counts, chosen = bits[:, :, 0] + 2 * bits[:, :, 1], _choices(run, count)
    key = np.arange(count, dtype=np.uint64)[None].repeat(len(p), 0)
    for k in range(run):
        key = key * np.uint64(3) + counts[:, chosen[:, k]]
    return key.view(np.int64)


def _near(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the rows of a and b (words, and grid points of the first two) that are linked: the bound first, then the bits."""
    at = np.nonzero(manhattan(at_a, at_b).sum(1) <= most)[0]
    return at[np.bitwise_count(a[at] ^ b[at] if len(a) == len(b) else a ^ b[at]).sum(1) <= most]


def _flood(words: np.ndarray, at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect all rows that are linked: what is reached no longer takes part, so alike rows cost little."""
    out, left, front = [], np.arange(len(words)), []
    w, p = words, at
    while len(left):
        if not front:
            front, left, w, p = [int(left[0])], left[1:], w[1:], p[1:]
        k = front.pop()
        near = _near(words[k : k + 1], w, at[k : k + 1], p, most)
        if len(near):
            got = left[near].tolist()
            out += [(k, g) for g in got]
            front += got
            rest = np.ones(len(left), bool)
            rest[near] = False
            left, w, p = left[rest], w[rest], p[rest]
    return out


def group_links(key: np.ndarray, ids: np.ndarray, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links that connect, within each run of equal keys, all rows that are linked."""
    start = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
    size = np.diff(np.concatenate([start, [len(key)]]))
    own = np.repeat(size, size)
    found, at = [np.empty((0, 2), np.int64)], points(words[:, :2])
    few = (own > 1) & (own <= SMALL)
    for k in range(1, SMALL):
        i = np.nonzero(few[:-k] & (key[k:] == key[:-k]))[0]
        if not len(i):
            break
        i = i[_near(words[i], words[i + k], at[i], at[i + k], most)]
        found.append(np.stack([i, i + k], 1))
    pairs = np.concatenate(found)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    tree = []
    for i, j in pairs.tolist():  # rows of a run; only links that connect something new
        if (a := find(i)) != (b := find(j)):
            root[b] = a
            tree.append((i, j))
    for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        tree += [(s + i, s + j) for i, j in _flood(words[s : s + n], at[s : s + n], most)]
    both = np.array(tree, np.int64).reshape(-1, 2)
    return ids[both[:, 0]], ids[both[:, 1]]


def _words_of(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, n)


def links(units: DataFrame, most: int, run: int, count: int, held: int | None = None) -> DataFrame:
    """(a, b): links of ``units`` (uid, sig) that connect all that share one of ``count`` cells of ``run`` segments and differ in at most ``most`` bits."""
    held = held or HELD
    names = ["cell", "uid", "head"]

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                w = _words_of(part.column(1), WORDS)
                head = pa.array([bytes(x) for x in w[:, :CHECK]], pa.binary())
                each = np.arange(len(w)).repeat(count)
                yield pa.RecordBatch.from_arrays([pa.array(cells(w, run, count).reshape(-1)), part.column(0).take(pa.array(each)), head.take(pa.array(each))], names)

    dealt = units.select("uid", "sig").mapInArrow(deal, "cell long, uid long, head binary")
    # Which cells are overfull is told by a 16th of the rows: it decides how a cell's rows are compared, not which.
    some = units.where(F.xxhash64("uid") % 16 == 0).select("uid", "sig").mapInArrow(deal, "cell long, uid long, head binary")
    full = save(some.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") * 16 > held).select("cell", F.ceil(F.col("n") * 16 / held).cast("int").alias("blocks")), "full-cells")
    n = full.count()
    if n:
        pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("cell", F.least("own", j), F.greatest("own", j)))
        met = dealt.join(F.broadcast(full) if n <= HELD else full, "cell", "left").withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
        dealt = met.select(F.explode(F.when(F.col("blocks").isNull(), F.array("cell")).otherwise(pair)).alias("cell"), "uid", "head")

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out(key, ids, words):
            a, b = group_links(key, ids, words, most)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            key, ids, words = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _words_of(batch.column(2), CHECK)
            if not len(key):
                continue
            if rest and rest[-1][0][-1] == key[0] == key[-1]:
                rest.append((key, ids, words))
                continue
            if rest:
                key, ids, words = (np.concatenate(x) for x in zip(*rest, (key, ids, words), strict=True))
            last = int(np.searchsorted(key, key[-1], "left"))  # the last run may go on
            if last:
                yield out(key[:last], ids[:last], words[:last])
            rest = [(key[last:], ids[last:], words[last:])]
        if rest:
            yield out(*(np.concatenate(x) for x in zip(*rest, strict=True)))

    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.repartition(4 * parts, "cell").sortWithinPartitions("cell")
    return met.mapInArrow(compare, "a long, b long").distinct()


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the one of smallest doc_id stays, all columns as they are.

    Rows are told apart by their place in a written table, so repeated ids and repeated rows are rows like others: of
    equal or near texts one row stays, whatever their ids, and a text without near copies stays even if its id
    occurs again.  Rows without doc_id come after all others; of equal ids the first row in the table stays.
    Null texts and texts without any word are no copies of each other and stay.  Very long texts are read whole.
    No rows, no rows.
    """
    rid, sig = free_name(docs, "rid"), free_name(docs, "sig")
    given = docs.select(F.monotonically_increasing_id().alias(rid), *docs.columns)
    at = given.columns.index("text")
    names = [*given.columns, sig]

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([signature(t.as_py(), size) for t in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names)

    schema = StructType([StructField(f.name, f.dataType, True) for f in given.schema.fields] + [StructField(sig, BinaryType(), True)])
    with temporary(docs.sparkSession):
        rows = save(given.mapInArrow(sign, schema), "signed", kept=True)
        first = _first(rows, rid, sig, similarity)
        gone = save(rows.where(F.col(sig).isNotNull()).select(rid).join(first, rid, "left_anti"), "copies", kept=True)
        # A filter of the rows that go tells most others to stay where they are: only what it lets through is joined.
        maybe = hit(bit_filter(gone, rid), F.col(rid))
    return rows.where(~maybe).select(*docs.columns).union(rows.where(maybe).join(gone.hint("merge"), rid, "left_anti").select(*docs.columns))


def _first(rows: DataFrame, rid: str, sig: str, similarity: float) -> DataFrame:
    """(rid): the first row of each group of near copies."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), F.col(rid).alias("r"))
    units = rows.where(F.col(sig).isNotNull()).groupBy(F.col(sig).alias("sig")).agg(F.min(order).alias("first"))
    units = save(units.withColumn("uid", F.monotonically_increasing_id()), "units")
    comp = components(links(units, limit(similarity), *grid(units.count(), similarity)))
    named = units.select("uid", "first").join(comp, F.col("uid") == F.col("id"), "left").select(F.coalesce("component", "uid").alias("component"), "first")
    return save(named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.r").alias(rid)), "firsts")
