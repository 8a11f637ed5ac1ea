"""Token ids in a fixed-width bit-packed file format.

A file is a run of blocks, each followed by one newline byte.  A block holds whole
documents: a header, a table of (doc_id, place of the first id in the block), and the ids,
each in the fewest bits that the vocabulary needs, most significant bit first.  The width is fixed, so the
id at any place starts at bit place * width: a block is unpacked by numpy in one go, and
one document or one id is read without the rest.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, table
from tessera.llm.pieces import PieceMemo

VOCABULARY = "byte_bpe_50k.json"
MAGIC = b"TKB1"
#: magic, bits an id, task, block of the task, documents, ids, bytes of packed ids
_HEAD = struct.Struct("<4sBIIIQQ")
NO_ID = -(1 << 63)
#: A block is closed when it holds this many ids (one document is never split).
BLOCK_IDS = 1 << 16
BLOCKS_A_FILE = 64
#: Bytes of text whose pieces are told apart in one go.
SLICE = 1 << 22
#: Texts that are not words between single spaces or newlines, in the syntax of Arrow's patterns; those with added tokens are joined to it.
_ODD = r"  | \n|\n |\n\n|\A[ \n]|[ \n]\z|[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in ``bits`` bits; zero bits fill the last byte."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    rows = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(rows.reshape(-1)).tobytes()


def unpack(data: bytes | memoryview, bits: int, first: int, count: int) -> np.ndarray:
    """Ids first .. first + count - 1, reading only the bytes that hold them."""
    if bits == 16:
        return np.frombuffer(data, ">u2", count, 2 * first).astype(np.uint32)
    start, stop = first * bits // 8, -(-(first + count) * bits // 8)
    own = np.unpackbits(np.frombuffer(data, np.uint8, stop - start, start))
    skip = first * bits - 8 * start
    rows = own[skip : skip + count * bits].reshape(count, bits)
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.uint32)
    return (rows * weights).sum(1, dtype=np.uint32)


@dataclass
class Block:
    """A view of one block: nothing is unpacked until it is asked for."""

    bits: int
    task: int
    number: int
    doc_ids: np.ndarray
    starts: np.ndarray  # one more than there are documents
    data: memoryview

    def __len__(self) -> int:
        return len(self.doc_ids)

    def document(self, k: int) -> np.ndarray:
        return unpack(self.data, self.bits, int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))

    def ids(self, first: int, count: int) -> np.ndarray:
        return unpack(self.data, self.bits, first, count)


def write_block(docs: list[tuple[int | None, np.ndarray]], bits: int, task: int, number: int) -> bytes:
    ids = np.concatenate([x for _, x in docs])
    starts = np.cumsum([0] + [len(x) for _, x in docs]).astype("<u8")
    names = np.array([NO_ID if d is None else d for d, _ in docs], "<i8")
    packed = pack(ids, bits)
    return _HEAD.pack(MAGIC, bits, task, number, len(docs), len(ids), len(packed)) + names.tobytes() + starts.tobytes() + packed


def read_blocks(data: bytes) -> Iterator[Block]:
    """The blocks of a file's bytes."""
    at, view = 0, memoryview(data)
    while at < len(data):
        magic, bits, task, number, docs, _, size = _HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += _HEAD.size
        names = np.frombuffer(data, "<i8", docs, at)
        starts = np.frombuffer(data, "<u8", docs + 1, at + 8 * docs)
        at += 8 * (2 * docs + 1)
        yield Block(bits, task, number, names, starts, view[at : at + size])
        at += size + 1


#: What ByteLevel writes for bytes that are no printable signs, a space among them.
_WRITTEN = {b: chr(256 + k) for k, b in enumerate([*range(33), *range(127, 161), 173])}
_one_word = re.compile(r" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9]+|[!-/:-@\[-`{-~]+)").fullmatch
#: Of each byte: 0 space and newline, 1 letters, 2 digits, 3 other signs of ASCII, 4 bytes of other characters.
_KIND = np.array([0 if b in b" \n" else 4 if b > 127 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)


class Tokens:
    """The tokenizers library behind a memo of pieces; ``end`` is appended to each document."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        # In byte-level vocabularies each character of a token stands for one byte.
        self.bytes_of = np.ones(self.size, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        added = self.library.get_added_tokens_decoder()
        self.added = re.compile("|".join(re.escape(t.content) for t in added.values()) or r"(?!)")
        self.odd = "|".join([_ODD, *(re.escape(t.content) for t in added.values())])
        self.memo = PieceMemo(self._pieces, public_tokenizers.PATTERN)
        made = json.loads(self.library.to_str())
        before = made["pre_tokenizer"] or {}
        #: Whether pieces can be encoded apart: byte-level pre-tokens by the usual pattern, texts taken as they are.
        self.apart = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and made["normalizer"] is None

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _pieces(self, pieces: list[str]) -> Iterable[bytes]:
        """Ids of many pieces in one call where each starts anew after the one before."""
        apart = [k for k, p in enumerate(pieces) if len(p) > 1 and p[0] in " \n" and not p[1].isspace() and not p[-1].isspace()]
        out: list[bytes] = [b""] * len(pieces)
        if self.apart:  # one pre-token each: the library's model is asked without what surrounds it
            model = self.library.model
            for k, p in enumerate(pieces):
                if _one_word(p):
                    out[k] = array("I", [t.id for t in model.tokenize(p.encode().decode("latin-1").translate(_WRITTEN))]).tobytes()
            apart = [k for k in apart if not out[k]]
        if apart:
            ids = self._encode("".join(pieces[k] for k in apart))
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(pieces[k].encode()) for k in apart])) + 1
            start = 0
            for k, stop in zip(apart, ends.tolist(), strict=True):
                out[k] = ids[start:stop].tobytes()
                start = stop
        for k in set(range(len(pieces))).difference(apart):
            out[k] = out[k] or self._encode(pieces[k]).tobytes()
        return out

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if not self.apart or self.added.search(text):  # an added token may reach over pieces
            return self._encode(text)
        return np.frombuffer(self.memo.ids(text), "<u4")

    def ids_of(self, texts: pa.Array) -> list[np.ndarray]:
        """``ids`` of each text.  Words between single spaces or newlines are told apart for all texts at once, each kind looked up once."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = pc.invert(pc.match_substring_regex(texts, self.odd)).to_numpy(zero_copy_only=False) & (self.apart and self.memo.usual)
        out: list[np.ndarray | None] = [None] * len(texts)
        at = np.flatnonzero(plain)
        size = pc.binary_length(texts).to_numpy()
        if len(at):
            part = (np.cumsum(size[at]) - size[at]) // SLICE
            for own in np.split(at, np.flatnonzero(np.diff(part)) + 1):
                for k, ids in zip(own.tolist(), self._plain_ids(texts.take(pa.array(own))), strict=True):
                    out[k] = ids
        for k in np.flatnonzero(~plain).tolist():
            out[k] = self.ids(texts[k].as_py())
        return out

    def _plain_ids(self, texts: pa.LargeStringArray) -> list[np.ndarray]:
        """A piece begins at each text's start, space and newline, and where letters, digits and other signs of ASCII
        meet, but for what follows an apostrophe: a pre-token ends there.  So pieces are slices of the texts' buffer."""
        starts = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        if starts[0] == starts[-1]:
            return [np.empty(0, np.uint32)] * len(texts)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[starts[0] : starts[-1]]
        starts = starts - starts[0]
        cut = np.zeros(len(data) + 1, bool)
        kind = _KIND[data]
        cut[:-1] = kind == 0
        cut[1:-1] |= (kind[:-1] < 4) & (kind[1:] < 4) & (kind[:-1] != kind[1:]) & (kind[:-1] > 0) & (data[:-1] != 39)
        cut[starts] = True
        cut = np.flatnonzero(cut)
        pieces = pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        ids = self.memo.each(pieces.dictionary.to_pylist())
        many = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, ids = np.cumsum(many) - many, np.frombuffer(b"".join(ids), "<u4")
        kind = pieces.indices.to_numpy()
        n = many[kind]
        ends = np.concatenate([[0], np.cumsum(n)])
        every = ids[np.repeat(first[kind] - ends[:-1], n) + np.arange(ends[-1])]
        return np.split(every, ends[np.searchsorted(cut, starts[1:-1])])


_MADE: dict[str, Tokens] = {}


def tokens(path: str | None) -> Tokens:
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _MADE:
        _MADE[path] = Tokens(path)
    return _MADE[path]


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = 0, block_ids: int = BLOCK_IDS, blocks_a_file: int = BLOCKS_A_FILE) -> None:
    """Write the ids of every whole text, in ascending doc_id order, to files under ``path``.

    Rows are dealt out in ranges of doc_id, sorted, encoded and packed in one stage; Spark's own
    committer places the files, so a lost executor's task is simply written again.  Null
    texts count as empty and have the end id alone.  Rows without doc_id come first; rows
    that repeat a doc_id follow each other in the order of their texts' hashes.  Very long texts are encoded whole; other
    columns are not read, whatever their names; no rows give no blocks.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()  # rows of one doc_id can be dealt to several tasks
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens(vocabulary)
        bits, task = bits_for(coder.size), TaskContext.get().partitionId()
        last = np.array([end], np.uint32)
        held: list[tuple[int | None, np.ndarray]] = []
        size = number = 0
        emit = lambda b: pa.RecordBatch.from_arrays([pa.array([b], pa.binary())], ["block"])
        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), coder.ids_of(batch.column(1)), strict=True):
                ids = np.concatenate([own, last])
                held.append((doc_id, ids))
                size += len(ids)
                if size >= block_ids:
                    yield emit(write_block(held, bits, task, number))
                    held, size, number = [], 0, number + 1
        if held:
            yield emit(write_block(held, bits, task, number))

    blocks = ordered.mapInArrow(run, "block binary")
    # Bytes go through Spark's text writer as they are: one block, then its newline byte.
    blocks.select(F.col("block").cast("string").alias("value")).write.option("maxRecordsPerFile", blocks_a_file).option("compression", "none").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document: task, block, place (of the document in its task's ids), doc_id, n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for b in read_blocks(data.as_py()):
                    ids = b.ids(0, int(b.starts[-1])).astype("<u4")
                    crc = [zlib.crc32(ids[x:y]) for x, y in zip(b.starts.tolist(), b.starts.tolist()[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), v)) for v in (b.task, b.number)] + [pa.array(np.arange(len(b))), pa.array(b.doc_ids, mask=b.doc_ids == NO_ID), pa.array(b.starts[:-1].astype(np.int64)), pa.array(np.diff(b.starts.astype(np.int64))), pa.array(crc, pa.int64())], ["task", "block", "k", "doc_id", "at", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "task long, block long, k long, doc_id long, at long, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): blocks' sizes are summed by block and laid end to
    end.  The running sum is over blocks (of 2^16 ids), in two steps: within each task, then over tasks."""
    from pyspark.sql import Window

    sizes = rows.groupBy("task", "block").agg(F.sum("n_tokens").alias("n"))
    inside = sizes.select("task", "block", (F.sum("n").over(Window.partitionBy("task").orderBy("block")) - F.col("n")).alias("in_task"))
    totals = sizes.groupBy("task").agg(F.sum("n").alias("n")).orderBy("task").collect()  # one row a task
    offsets, base = [], 0
    for r in totals:
        offsets.append((r.task, base))
        base += r.n
    spark = rows.sparkSession
    starts = inside.join(F.broadcast(spark.createDataFrame(offsets, "task long, base long")), "task").select("task", "block", (F.col("in_task") + F.col("base")).alias("base"))
    return rows.join(starts, ["task", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.common import save

    path = new_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path)
    return with_starts(save(read(spark, path), "token-index"))
