"""SimHash near-duplicates by segment popcounts.

A fingerprint's 32 two-bit segments are mapped to their bit counts, a point of a grid of
32 dimensions.  The Manhattan distance of two points never exceeds the Hamming distance
of their fingerprints, so a range join on the grid loses no link.  The join itself splits
the dimensions into ``groups``: of points within distance d at most d groups differ, so
they share a grid cell in at least one choice of the other groups.  Pairs from a cell pass
the distance bound first and are then verified on the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, save, table, temporary

EVERY_OTHER = 0x5555555555555555
#: Most fingerprints of a cell that are compared in one go; those of a fuller cell are compared in blocks, two by two.
HELD = 20_000


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit fingerprint, unsigned.  Repeated shingles count as often as they occur; no words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    shingles = [h(b" ".join(words), 42)] if len(words) <= size else [h(b" ".join(x), 42) for x in zip(*(words[k:] for k in range(size)), strict=False)]
    bits = np.zeros(64, np.int64)
    for k in range(0, len(shingles), 1 << 16):
        part = np.array(shingles[k : k + (1 << 16)], np.uint64).astype(">u8").view(np.uint8)
        bits += np.unpackbits(part).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """Per row: doc_id, fp (long: the unsigned fingerprint's bits).  Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def popcounts(fp: Column) -> Column:
    """The grid point of a fingerprint: the bit counts 0, 1, 2 of its 32 segments, two bits each."""
    upper = F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseXOR(upper).bitwiseAND(F.lit(EVERY_OTHER))
    two = fp.bitwiseAND(upper).bitwiseAND(F.lit(EVERY_OTHER))
    return one.bitwiseOR(F.shiftleft(two, 1))


def manhattan(a: Column, b: Column) -> Column:
    """The Manhattan distance of two grid points: counts that differ by 1 set the lower bit of a^b, by 2 only the upper."""
    x = a.bitwiseXOR(b)
    low = x.bitwiseAND(F.lit(EVERY_OTHER))
    high = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(EVERY_OTHER)).bitwiseAND(F.bitwise_not(low))
    return F.bit_count(low) + 2 * F.bit_count(high)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masks(groups: int, distance: int, segments: int = 32) -> list[int]:
    """For each choice of the groups of segments that do not differ, the mask of their bits."""
    width = 64 // segments
    cut = [round(k * segments / groups) for k in range(groups + 1)]
    part = [sum(((1 << width) - 1) << (width * s) for s in range(a, b)) for a, b in zip(cut, cut[1:], strict=False)]
    return [_signed(sum(part[k] for k in own)) for own in combinations(range(groups), groups - distance)]


def _cells(points: DataFrame, value: Column, masks: list[int]) -> DataFrame:
    """A row (c, cell, fp) for each fingerprint and mask."""
    keys = F.array(*(F.struct(F.lit(k).alias("c"), value.bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(masks)))
    return points.select("fp", F.explode(keys).alias("k")).select("k.c", "k.cell", "fp")


def _forest(distance: int):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        """Links that connect what is linked within one cell: what is reached no longer takes part, so alike rows cost little."""
        fp = np.unique(cell["fp"].to_numpy())
        left, front, out = fp.view(np.uint64), [], []
        while len(left):
            if not front:
                front, left = [left[0]], left[1:]
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                got = left[near]
                out.append(np.stack([np.full(len(got), x), got], 1))
                front += list(got)
                left = left[~near]
        pairs = np.concatenate(out).view(np.int64) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame({"a": pairs.min(1), "b": pairs.max(1)})

    return run


def links(points: DataFrame, distance: int = 3, groups: int = 6, dense: int = 256, segments: int = 32) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``points`` (fp), a < b, at most ``distance`` bits apart.

    Cells of at most ``dense`` fingerprints give all their linked pairs.  Fuller ones, up to
    ``HELD``, are compared within one task, which gives links that connect all that the cell links.
    The rows of still fuller cells are dealt into blocks of half as many, and each two blocks are compared in a task of their
    own.  So every link is a row, or its ends are connected by rows, no task holds more than ``HELD`` rows or so, and no row
    count grows with a square.  For wider distances the cells may take ``segments`` of one bit (64), whose counts are the bits.
    """
    masks = _masks(groups, distance, segments)
    cells = _cells(points, popcounts(F.col("fp")) if segments == 32 else F.col("fp"), masks)
    sizes = save(cells.groupBy("c", "cell").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    held = save(cells.join(sizes, ["c", "cell"]).select("c", "cell", "n", "fp"), "cells-held")
    few = held.where(F.col("n") <= dense)
    a, b = few.select("c", "cell", F.col("fp").alias("a")), few.select("c", "cell", F.col("fp").alias("b"))
    near = manhattan(popcounts(F.col("a")), popcounts(F.col("b"))) <= distance
    pairs = a.join(b, ["c", "cell"]).where("a < b").where(near).where(hamming(F.col("a"), F.col("b")) <= distance).select("a", "b")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") * 2 / HELD)).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    many = held.where(F.col("n") > dense).select("c", "cell", "fp", (F.col("n") > HELD).alias("full"), blocks.alias("blocks"), own.alias("own"))
    other = F.when(F.col("full"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    dealt = many.select("c", "cell", "fp", "full", "own", F.explode(other).alias("j"))
    pair = [F.when(F.col("full"), x).otherwise(0).alias(k) for k, x in (("i", F.least("own", "j")), ("k", F.greatest("own", "j")))]
    return pairs.union(dealt.select("c", "cell", *pair, "fp").groupBy("c", "cell", "i", "k").applyInPandas(_forest(distance), "a long, b long"))


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 3, groups: int = 6, segments: int = 32, dense: int = 256) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (long), component_id, the smallest doc_id reachable over links.

    Null and empty texts have fingerprint 0, linked like any other.  Rows without doc_id take part
    and do not name a component (which is null where no row of it has an id).  Repeated rows
    give repeated rows.  No table, no rows.
    """
    with temporary(docs.sparkSession):
        by_doc = save(fingerprints(docs, size), "fp", kept=True)
        distinct = save(by_doc.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-distinct")
        comp = save(components(links(distinct.select("fp"), distance, groups, dense, segments)), "fp-cc")
        named = distinct.join(comp, distinct.fp == comp.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
        least = save(named.groupBy("component").agg(F.min("least").alias("component_id")), "fp-least")
        of_fp = save(named.join(least, "component").select("fp", "component_id"), "fp-named", kept=True)
    return by_doc.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
