"""Byte-level BPE encoding and decoding by longest matches and backtracking.

The vocabulary's byte strings, mapped to Latin-1, form a pyahocorasick automaton.  A
pre-token's encoding is the one sequence of tokens in which every two neighbours are
compatible, that is, would not have merged differently across their border.  The search
takes the longest match at each position and steps back to shorter ones when neighbours
clash; positions from which nothing fits are marked, so each is left once (linear time).
Compatibility of two tokens depends on them alone and is memoised.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.pieces import PieceMemo

RANKS = "byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    """Encoder and decoder for a rank file; its merges are the ranks, lower first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks, self.pattern = ranks, pattern
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            last = self._last_merge(b, i)
            if last:
                self.parts[i] = last
                self.merged[last] = i
            elif len(b) > 1:
                continue  # no sequence of merges makes this token
            self.automaton.add_word(b.decode("latin-1"), i)
        self.longest = max(map(len, ranks), default=1)
        self.compatible: dict[int, bool] = {}
        self.split = regex.compile(pattern).findall

    def _last_merge(self, b: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``b``: all merges of lower ranks are done first."""
        seq = [b[k : k + 1] for k in range(len(b))]
        while len(seq) > 2:
            best = min(((self.ranks.get(x + y, rank), k) for k, (x, y) in enumerate(zip(seq, seq[1:], strict=False))), default=(rank, 0))
            if best[0] >= rank:
                return None
            seq[best[1] : best[1] + 2] = [seq[best[1]] + seq[best[1] + 1]]
        return (self.ranks[seq[0]], self.ranks[seq[1]]) if len(seq) == 2 else None

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b, side by side, encode to just these two.

        Undoes the later of the two tokens' merges step by step, along their common border:
        a merge across it that comes before the merge undone last would have happened.
        """
        key = a << 32 | b
        if (known := self.compatible.get(key)) is not None:
            return known
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        merged, parts = self.merged, self.parts
        before, good = 1 << 60, True
        while True:
            if merged.get((a, b), before) < before:
                good = False
                break
            # Of merges of one rank the left one comes first, hence b's limit is one more.
            if a > b and a in parts or b not in parts:
                if a not in parts:
                    break
                before, a = a, parts[a][1]
            else:
                before, b = b + 1, parts[b][0]
        self.compatible[key] = good
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None and (whole in self.parts or len(piece) == 1):
            return [whole]
        text, n, longest = piece.decode("latin-1"), len(piece), self.longest
        prefix, token_of, fits = self.automaton.longest_prefix, self.automaton.get, self.fits
        out: list[int] = []
        lengths: list[int] = []
        dead = bytearray(n + 1)
        pos, size = 0, -1  # size: the longest match still to be tried at pos; -1: not looked up yet
        while pos < n:
            if size < 0:
                size = prefix(text[pos : pos + longest])
            while size:
                token = token_of(text[pos : pos + size], -1)
                if token >= 0 and not dead[pos + size] and (not out or fits(out[-1], token)):
                    break
                size -= 1
            if size:
                out.append(token)
                lengths.append(size)
                pos += size
                size = -1
            else:
                dead[pos] = 1
                out.pop()
                size = lengths.pop()
                pos -= size
                size -= 1
        return out

    def encode_text_piece(self, text: str) -> bytes:
        body = text[1:]
        if self.pattern != public_tokenizers.PATTERN:
            split = self.split(text)
        elif body.isalpha() and max(body) < "\u0250":  # " word" or "\nword": what the pattern gives, at less cost
            split = [text] if text[0] == " " else [text] if text[0].isalpha() and text[0] < "\u0250" else self.split(text)
        elif text[0] == " " and body[-1:] in (".", ",") and body[:-1].isalpha() and max(body) < "\u0250":
            split = [text[:-1], text[-1]]
        else:
            split = self.split(text)
        out = [i for x in split for i in self.encode_piece(x.encode())]
        return array("I", out).tobytes()

    def memo(self) -> PieceMemo:
        return PieceMemo(lambda pieces: map(self.encode_text_piece, pieces), self.pattern)

    def encode(self, text: str) -> list[int]:
        return [i for x in self.split(text) for i in self.encode_piece(x.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_MADE: dict[str, tuple[Bpe, PieceMemo, dict[int, bytes]]] = {}


def coder(ranks_path: str | None, pattern: str) -> tuple[Bpe, PieceMemo, dict[int, bytes]]:
    """One coder a worker process and rank file."""
    path = ranks_path or public_tokenizers.path(RANKS)
    if (key := f"{path}\0{pattern}") not in _MADE:
        bpe = Bpe(read_ranks(path), pattern)
        _MADE[key] = (bpe, bpe.memo(), {i: b"%d" % i for i in bpe.bytes_of})
    return _MADE[key]


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per row of ``docs``: doc_id, ids (array of int) of its whole text, and decoded (binary).

    Null and empty texts have no ids, very long ones are encoded whole.  Other columns are not read, whatever their
    names; repeated rows give repeated rows, no rows none.  One narrow stage: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memo, _ = coder(ranks_path, pattern)
        for batch in batches:
            ids = [np.frombuffer(memo.ids(t), "<u4") for t in batch.column(1).to_pylist()]
            decoded = [bpe.decode(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, computed where the ids are, so that no ids move; rows as in ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memo, decimal = coder(ranks_path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = np.frombuffer(memo.ids(text.as_py()), "<u4").tolist()
                rows.append((len(ids), sha(b" ".join(map(decimal.__getitem__, ids))), sha(bpe.decode(ids))))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
