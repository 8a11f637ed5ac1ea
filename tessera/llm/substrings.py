"""Removal of byte strings that occur twice, by prefix doubling over sparse positions.

A position's rank is the class of the bytes that start there.  Ranks of 1 byte are doubled
within each text up to 100 bytes, pairs of ranks at growing offsets; then Spark ranks, and positions whose rank is unique
drop out.  Not all positions are ranked: of the 100-byte strings in a 200-byte window the one of smallest hash
is its anchor, so equal windows have equal anchors at equal places, and about every fiftieth position is one.

1. The bytes under all windows of an anchor are its span.  Spark groups the pairs (rank of the anchor, rank of its span).
   Of a span that occurs twice all windows do: settled.  An anchor whose rank is unique drops out with its windows.
2. Where spans of one anchor rank differ, one text of each kind of span sends the span's bytes.  These are
   sorted by anchor rank, and of each rank the 200-byte windows are ranked, by doubling again, and compared.
   Anchor ranks with more than ``HELD`` kinds of spans are ranked window by window in Spark instead, so that
   no task holds them together.

Texts are numbered in a table that is written once.  Ranks are 128-bit hashes of the bytes, or of pairs of ranks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bitfilter import bit_filter, hit
from tessera.llm.common import drop, save, table, temporary

WINDOW, GRAM = 200, 100
SPREAD = WINDOW - GRAM  # the places that an anchor can have in its window: 0 .. SPREAD
#: Most kinds of spans of an anchor rank that one task compares.
HELD = 5_000
_A = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD))
_B = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def _join(left: np.ndarray, right: np.ndarray, m: tuple[np.uint64, np.uint64]) -> np.ndarray:
    """Ranks of the strings made of two neighbours: the pair of their ranks, hashed."""
    x = (left * m[0] + right) * m[1]
    return x ^ (x >> np.uint64(29))


class Ranks:
    """Hashed ranks of all strings of a text, of power-of-two lengths by doubling, others from those."""

    def __init__(self, data: bytes, m: tuple[np.uint64, np.uint64] = _A) -> None:
        self.m, self.n = m, len(data)
        self.of_power = [(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * m[1]]
        while 2 << (len(self.of_power) - 1) <= min(self.n, WINDOW):
            w = 1 << (len(self.of_power) - 1)
            r = self.of_power[-1]
            self.of_power.append(_join(r[: len(r) - w], r[w:], m))

    def at(self, places: np.ndarray | None, length: int) -> np.ndarray:
        """Ranks of the strings of ``length`` that start at ``places`` (None: at all)."""
        out, done = None, 0
        for k in range(length.bit_length() - 1, -1, -1):
            if length >> k & 1:
                r = self.of_power[k]
                part = r[places + done] if places is not None else r[done : done + self.n - length + 1]
                out = part if out is None else _join(out, part, self.m)
                done += 1 << k
        return out


def anchors(gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window), by place, of a text of n bytes with the given gram ranks."""
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)  # of equals the leftmost
    low, width = key, 1
    while 2 * width <= SPREAD + 1:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = SPREAD + 1 - width
    if rest:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
    return at[first], first, np.concatenate([first[1:], [n - WINDOW + 1]]) - 1


class Repeats:
    """The steps over one table of texts."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = save(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "numbered", kept=True)

    def spans(self) -> DataFrame:
        """(rid, h, s, t, first, last) of each anchor: its rank, its span's rank (with the anchor's place in it), its windows."""
        names = ["rid", "h", "s", "t", "first", "last"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held: list[list[np.ndarray]] = []
                for rid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    if len(data) < WINDOW:
                        continue
                    gram = Ranks(data).at(None, GRAM)
                    a, first, last = anchors(gram, len(data))
                    d = b"".join(xxhash.xxh3_128_digest(data[x : y + WINDOW]) for x, y in zip(first.tolist(), last.tolist(), strict=True))
                    s = np.frombuffer(d, "<i8").reshape(-1, 2)
                    held.append([np.full(len(a), rid), gram[a].view(np.int64), s[:, 0], s[:, 1] ^ (a - first), first.astype(np.int32), last.astype(np.int32)])
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)

        return self.docs.select("rid", "text").mapInArrow(run, "rid long, h long, s long, t long, first int, last int")

    def find(self) -> DataFrame:
        """(rid, first, last): runs of starts of windows that occur twice."""
        # 1: a span's rank tells its anchor's, whose bytes and place it holds
        found = save(self.spans(), "spans")
        kinds = save(found.groupBy("s", "t").agg(F.any_value("h").alias("h"), F.count("*").alias("n"), F.min(F.struct("rid", "first", "last")).alias("one")), "span-kinds")
        # Both sides are written tables, so that a span that very many texts share can be split over tasks.
        twice = save(kinds.where("n > 1").select("s", "t"), "spans-twice")
        settled = save(found.join(twice.hint("merge"), ["s", "t"]).select("rid", "first", "last"), "settled")
        drop(found)
        # 2
        open_ = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1")
        wanted = kinds.join(open_.hint("merge"), "h").select("one.rid", "h", "one.first", "one.last", (F.col("n") == 1).alias("single"), (F.col("kinds") > HELD).alias("hot"))
        bytes_ = save(self._bytes(wanted), "span-bytes")
        drop(kinds)
        light = bytes_.where("NOT hot").repartition("h").sortWithinPartitions("h").mapInArrow(_compare, "rid long, first int, last int")
        out = settled.union(light)
        hot = bytes_.where("hot")
        if not hot.isEmpty():
            each = save(hot.mapInArrow(_each, "s long, t long, single boolean, rid long, place int"), "windows")
            again = each.groupBy("s", "t").agg(F.count("*").alias("n")).where("n > 1").select("s", "t")
            out = out.union(each.where("single").join(again.hint("merge"), ["s", "t"]).select("rid", F.col("place").alias("first"), F.col("place").alias("last")))
        return out

    def _bytes(self, wanted: DataFrame) -> DataFrame:
        """(h, hot, single, rid, first, w): the spans' bytes, cut where their texts are."""
        of_text = wanted.groupBy("rid").agg(F.collect_list(F.struct("h", "hot", "single", "first", "last")).alias("own"))
        names = ["h", "hot", "single", "rid", "first", "w"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in range(0, batch.num_rows, 500):
                    part = batch.slice(s, 500)
                    own = part.column(2).flatten()
                    n = np.diff(part.column(2).offsets.to_numpy())
                    first, last = (own.field(c).to_numpy() for c in ("first", "last"))
                    at, w = 0, []
                    for k, text in zip(n.tolist(), part.column(1), strict=True):
                        data = text.as_py().encode("utf-8", "surrogatepass")
                        w += [data[x : y + WINDOW] for x, y in zip(first[at : at + k].tolist(), last[at : at + k].tolist(), strict=True)]
                        at += k
                    rid = np.repeat(part.column(0).to_numpy(), n)
                    yield pa.RecordBatch.from_arrays([own.field("h"), own.field("hot"), own.field("single"), pa.array(rid), own.field("first"), pa.array(w, pa.binary())], names)

        return self.docs.select("rid", "text").join(of_text.hint("merge"), "rid").mapInArrow(run, "h long, hot boolean, single boolean, rid long, first int, w binary")


def _windows(w: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(span, place in the span, and the two halves of the rank) of each window of some spans."""
    size = np.array([len(x) for x in w], np.int64)
    n = size - WINDOW + 1
    data = b"".join(w)
    own = np.repeat(np.arange(len(w)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = place + np.repeat(np.cumsum(size) - size, n)
    return own, place, Ranks(data, _A).at(at, WINDOW), Ranks(data, _B).at(at, WINDOW)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (s, t, single, rid, place) for each window of each span."""
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            own, place, s, t = _windows(part.column(5).to_pylist())
            single, rid, first = (part.column(c).to_numpy(zero_copy_only=False)[own] for c in (2, 3, 4))
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(t.view(np.int64)), pa.array(single), pa.array(rid), pa.array((first + place).astype(np.int32))], ["s", "t", "single", "rid", "place"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, first, last): of spans sorted by anchor rank, the runs of windows that another span has too."""
    rest: list[pa.RecordBatch] = []

    def out(rows: pa.RecordBatch) -> pa.RecordBatch:
        own, place, s, t = _windows(rows.column(5).to_pylist())
        order = np.argsort(s)
        if ((s[order][1:] == s[order][:-1]) & (t[order][1:] != t[order][:-1])).any():
            order = np.lexsort((t, s))
        same = (s[order][1:] == s[order][:-1]) & (t[order][1:] == t[order][:-1])
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        single, rid, first = (rows.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4))
        k = np.nonzero(twice & single[own])[0]
        starts = np.concatenate([[True], (own[k][1:] != own[k][:-1]) | (place[k][1:] != place[k][:-1] + 1)])[: len(k)]
        ends = np.concatenate([starts[1:], [True]])[: len(k)]
        lo, hi = k[starts], k[ends]
        return pa.RecordBatch.from_arrays([pa.array(rid[own[lo]]), pa.array((first[own[lo]] + place[lo]).astype(np.int32)), pa.array((first[own[hi]] + place[hi]).astype(np.int32))], ["rid", "first", "last"])

    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            h = part.column(0).to_numpy()
            if rest and rest[-1].column(0)[-1].as_py() == h[-1]:
                rest.append(part)
                continue
            last = int(np.nonzero(h != h[-1])[0][-1]) + 1 if h[0] != h[-1] else 0  # the last rank may go on
            if rest or last:
                yield out(pa.Table.from_batches([*rest, part.slice(0, last)]).combine_chunks().to_batches()[0])
            rest = [part.slice(last)]
    if rest:
        yield out(pa.Table.from_batches(rest).combine_chunks().to_batches()[0])


def remove(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256.

    Every byte goes that is covered by a 200-byte string which starts anywhere else too.
    Texts are their UTF-8 bytes, of any length; null and shorter ones lose nothing.  Repeated rows are each
    other's copies, and lose all.  Other columns are not read, whatever their names.  No rows, no rows.
    """
    with temporary(docs.sparkSession):
        r = Repeats(docs)
        marks = save(r.find().groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "marks", kept=True)

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, runs in batches:
            rows = [cut_text(t, [] if u is None else [(x["first"], x["last"]) for x in u]) for t, u in zip(texts, runs, strict=True)]
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    # Texts without marks do not move.
    marked = hit(bit_filter(marks, "rid"), F.col("rid"))
    both = r.docs.where(marked).join(marks.hint("merge"), "rid", "left").select("doc_id", "text", "runs").union(r.docs.where(~marked).select("doc_id", "text", F.lit(None).cast(marks.schema["runs"].dataType)))
    return both.select("doc_id", cut(F.col("text"), F.col("runs")).alias("r")).select("doc_id", "r.*")


def cut_text(text: str | None, runs: list[tuple[int, int]]) -> tuple[int, int, int, bytes, str]:
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    step = np.zeros(n + 1, np.int64)
    for first, last in runs:
        step[first] += 1
        step[last + WINDOW] -= 1
    gone = np.cumsum(step)[:n] > 0
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
    return n, n - len(kept), spans, kept, hashlib.sha256(kept).hexdigest()


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents")).drop("kept")
