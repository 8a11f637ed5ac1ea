"""Fill-in-the-middle: texts cut at two token bounds and put in prefix-suffix-middle or suffix-prefix-middle order.

A token is a run of other characters with the white space before it, or white space at the end of a text.  One numpy
kernel cuts all texts of a batch together, on Arrow's UTF-8 buffers: a table tells the class of each byte, two
neighbouring bytes tell where tokens end, a cumulative sum that is reset at each text counts the ends, and
``searchsorted`` finds the cuts.  The parts are Arrow slices of the same buffer, joined by Arrow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, table

SEED, RATE, SPM_RATE = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that one call of the kernel takes, but for a single longer text.
SLICE = 1 << 22
#: The class of each byte: white space or not.  All bytes of a longer code point are of the other class.
_SPACE = np.isin(np.arange(256), [ord(c) for c in SPACES])
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def cuts(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, first cut, second cut) of all texts: numbers of tokens, and places in ``data`` where prefix and middle end.

    ``data`` are the texts' bytes one after another, from ``offsets``[k] to ``offsets``[k + 1]; ``draws`` two rows of numbers.
    """
    start, end = offsets[:-1], offsets[1:]
    ends = np.zeros(len(data), bool)
    if len(data):
        space = _SPACE[data]
        np.logical_and(~space[:-1], space[1:], out=ends[:-1])
        ends[end[end > start] - 1] = True
    so_far = np.zeros(len(data) + 1, np.int32)  # tokens that end before each place; int32 as offsets are
    np.cumsum(ends, out=so_far[1:], dtype=np.int32)
    before = so_far[start].astype(np.int64)  # what resets the sum at each text
    n = so_far[end] - before
    units = np.sort(draws % (n + 1).astype(np.uint64), axis=0).astype(np.int64)
    first, second = (np.where(u > 0, np.searchsorted(so_far, (before + u).astype(np.int32)), start) for u in units)
    return n, first, second


def _code_points(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Code points of ``data`` from each a to each b, a <= b, in ascending order."""
    so_far = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=so_far[1:], dtype=np.int32)
    return (so_far[b] - so_far[a]).astype(np.int64)


def _infill(ids: pa.Array, texts: pa.Array, h: list[np.ndarray], rate: int, spm_rate: int) -> pa.RecordBatch:
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8))[offsets[0] : offsets[-1]]
    at = offsets.astype(np.int64) - offsets[0]
    n, first, second = cuts(data, at, np.stack(h[:2]))
    marked = np.zeros(len(texts), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = (at[1:] == at[:-1]) | marked | (h[2] % 100 >= rate)
    spm = ~plain & (h[3] % 100 < spm_rate)
    bounds = np.concatenate([np.stack([at[:-1], first, second], 1).reshape(-1), at[-1:]]).astype(np.int32)
    parts = pa.StringArray.from_buffers(3 * len(texts), pa.py_buffer(bounds), pa.py_buffer(data))
    prefix, middle, suffix = (parts.take(pa.array(np.arange(k, 3 * len(texts), 3))) for k in range(3))
    join = lambda *x: pc.binary_join_element_wise(*x, "")
    p, s, m = (pa.scalar(x) for x in (PREFIX, SUFFIX, MIDDLE))
    tail = join(m, middle)
    output = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(spm), join(s, suffix, p, prefix, tail), join(p, prefix, s, suffix, tail)))
    form = pa.array(np.select([plain, spm], ["plain", "spm"], "psm"), pa.string())
    chars = (pa.array(_code_points(data, a, b), mask=plain) for a, b in ((at[:-1], first), (first, second)))
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), form, *chars, output], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Per row of ``docs``: doc_id, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.

    ``rate`` of a hundred texts are cut, of these ``spm_rate`` of a hundred take the suffix first, drawn by the hash of
    ``seed`` and doc_id, so rows of one doc_id are drawn alike; a null doc_id draws like an empty one.  Null texts count
    as empty; empty texts and those that contain a mark stay plain.  Texts are cut whole, whatever their length:
    a slice of 4 MB at a time, a longer text by itself.  Other columns are not read.  No rows, no rows.
    """
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("hexed", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), hexed.alias("hexed")).select("doc_id", "text", *draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(size, SLICE + (size[a - 1] if a else 0), "right")))
                own = batch.slice(a, b - a)
                h = [own.column(k).to_numpy().astype(np.uint64) for k in range(2, 6)]
                yield _infill(own.column(0), own.column(1).cast(pa.string()), h, rate, spm_rate)
                a = b

    return asked.mapInArrow(run, _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.  A cut text holds no mark, and no part of one joins a mark to another."""
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
