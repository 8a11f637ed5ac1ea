"""Documents to chunks: admission, page clean-up, sentences, overlapping chunks, previews."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULTS
from tessera.functions.scalar import chunk_id, extension, preview, sentences

EXTENSIONS = (".pdf", ".txt", ".md")


def admission(path: Column, length: Column, mime: Column | None = None, max_mb: int = DEFAULTS.max_ingest_mb) -> Column:
    """Why a file is refused, or ``ok``."""
    out = F.when(~extension(path).isin(*EXTENSIONS), "extension").when(length < 1, "empty").when(length > max_mb * 1024 * 1024, "too_large")
    if mime is not None:
        out = out.when(~mime.isin("application/pdf", "text/plain", "text/markdown", "application/octet-stream"), "mime")
    return out.otherwise("ok")


def sniffed(content: Column) -> Column:
    """The type that a file's first bytes tell: PDF by its mark, text if the first kilobyte has no zero byte, else unknown."""
    head = F.hex(F.substring(content, 1, 1024))
    zero = F.exists(F.transform(F.sequence(F.lit(0), F.greatest(F.length(head) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.substring(head, 2 * i + 1, F.lit(2))), lambda b: b == "00")
    return F.when(head.startswith("25504446"), "application/pdf").when(~zero, "text/plain").otherwise("application/x-unknown")


def clean_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (doc, page_num, text) without repeated first and last lines and without empty pages.

    A first or last line goes if it is that of more than half of its document's pages.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    # get() is null past the end, so that pages without lines have neither.
    p = pages.withColumn("lines", lines).withColumn("head", F.get("lines", F.lit(0))).withColumn("foot", F.get("lines", F.size("lines") - 1))
    n = p.groupBy("doc").agg(F.count("*").alias("pages"))
    often = lambda c: p.where(F.col(c).isNotNull()).groupBy("doc", c).agg(F.count("*").alias("n")).join(n, "doc").where(F.col("n") > 0.5 * F.col("pages")).select("doc", c, F.lit(True).alias(f"{c}_often"))
    q = p.join(often("head"), ["doc", "head"], "left").join(often("foot"), ["doc", "foot"], "left")
    first = F.when(F.coalesce("head_often", F.lit(False)), 2).otherwise(1)
    last = F.size("lines") - F.when(F.coalesce("foot_often", F.lit(False)) & (F.size("lines") >= first), 1).otherwise(0)
    kept = F.slice("lines", first, F.greatest(last - first + 1, F.lit(0)))
    return q.select("doc", "page_num", F.array_join(kept, "\n").alias("text")).where("text <> ''")


def chunks(docs: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, least: int = DEFAULTS.min_chunk_size) -> DataFrame:
    """Overlapping sentence-aligned chunks of (source, text), as (chunk_id, source, content, chunk_index, token_count).

    A sentence that would overflow ``size`` tokens closes the chunk, and the next one opens with the longest run of its last
    sentences of at most ``overlap`` tokens.  Chunks under ``least`` tokens are dropped and take no index.  Texts of any
    length take time in proportion: bounds come from running sums of the sentences' tokens, and nothing is shuffled.
    """
    count = F.transform("s", lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda t: t != "")))
    cut = docs.select("source", sentences(F.col("text")).alias("s")).select("source", "s", _bounds(size, overlap, least)(count).alias("b"))
    each = cut.select("source", F.posexplode(F.transform("b", lambda b: F.struct(F.array_join(F.transform(F.sequence(b["first"], b["last"]), lambda i: F.get("s", i)), " ").alias("content"), b["n"].alias("n")))).alias("chunk_index", "c"))
    return each.select(chunk_id(F.col("source"), F.col("chunk_index")).alias("chunk_id"), "source", F.col("c.content").alias("content"), "chunk_index", F.col("c.n").alias("token_count"))


def _bounds(size: int, overlap: int, least: int):
    """First and last sentence, and tokens, of each chunk of a text with so many tokens in each sentence."""

    @F.pandas_udf("array<struct<first:int,last:int,n:int>>")
    def run(counts: pd.Series) -> pd.Series:
        out = []
        for own in counts:
            c = np.concatenate(([0], np.cumsum(own, dtype=np.int64)))  # tokens before each sentence, and all
            after = np.searchsorted(c, c + size, "right") - 1  # past the last sentence that fits from each on
            begin = np.searchsorted(c, c - overlap, "left")  # where the overlap before each begins
            rows, new = [], 0
            while new < len(own):
                first = int(begin[new]) if new else 0
                end = max(int(after[first]), new + 1)
                if (n := int(c[end] - c[first])) >= least:
                    rows.append((first, end - 1, n))
                new = end
            out.append(rows)
        return pd.Series(out)

    return run


def previews(chunks_: DataFrame) -> DataFrame:
    return chunks_.select("chunk_id", preview(F.col("content")).alias("preview"))


def first_previews(chunks_: DataFrame, n: int = 5) -> DataFrame:
    """The previews of each source's first ``n`` chunks, as an upload reports them."""
    return chunks_.where(F.col("chunk_index") < n).select("source", "chunk_index", "chunk_id", preview(F.col("content")).alias("preview"))


#: What stands for the context of a question without passages.
NO_CONTEXT = "No context available."


def _block(ranked: DataFrame, one: Column, questions: DataFrame | None) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("t")))), lambda x: x["t"]), "\n\n---\n\n")
    blocks = ranked.groupBy("query_id").agg(joined.alias("context"))
    return blocks if questions is None else questions.select("query_id").join(blocks, "query_id", "left").fillna({"context": NO_CONTEXT})


def context_block(ranked: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """One text a question from (query_id, rank, content, source, score): numbered passages in rank order.

    Of ``questions``, if given, each has a row, those without passages a fixed text."""
    return _block(ranked, F.format_string("[Doc %d] (relevance: %.2f)\n%s\nSource: %s", F.col("rank").cast("int"), "score", "content", "source"), questions)


def web_block(ranked: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """As ``context_block``, from (query_id, rank, title, content, url, score)."""
    return _block(ranked, F.format_string("[Web %d] (score: %.2f) %s\n%s\nSource: %s", F.col("rank").cast("int"), "score", "title", "content", "url"), questions)


def failure_summary(chunks_: Column, answer: Column) -> Column:
    """The first three passages, 150 characters each, and 500 of the answer."""
    return F.concat_ws("\n", F.array_join(F.transform(F.slice(chunks_, 1, 3), lambda c: F.substring(c, 1, 150)), "\n"), F.substring(answer, 1, 500))


def synthesise(answers: DataFrame, *keys: str) -> DataFrame:
    """Sub-answers (keys, pos, answer) of each question joined in their order: the fallback synthesis."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "answer"))), lambda x: x["answer"]), "\n\n")
    return answers.groupBy(*keys).agg(joined.alias("answer"))


def dual_index(chunks_: DataFrame, corpus: DataFrame, vectors: DataFrame, embed) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to append to the corpus and the vector table, and a status row.

    Each index takes the chunks whose id it lacks; what one took is reported apart from the other.
    """
    new = chunks_.dropDuplicates(["chunk_id"])
    words = new.join(corpus.select("chunk_id"), "chunk_id", "left_anti").select(*chunks_.columns)
    embedded = embed(new.join(vectors.select("chunk_id"), "chunk_id", "left_anti").select(*chunks_.columns))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    status = count(chunks_, "chunk_count").crossJoin(count(words, "bm25_inserted")).crossJoin(count(embedded, "vectors_inserted"))  # one row each
    return words, embedded, status


def index_both(chunks_: DataFrame, words, vectors) -> dict[str, object]:
    """Run both writers, ``words(chunks)`` and ``vectors(chunks)``, each of which returns how many rows it took.

    One that fails is reported and does not hold up the other."""
    out: dict[str, object] = {"chunk_count": chunks_.count(), "errors": []}
    for name, write in (("bm25_inserted", words), ("vectors_inserted", vectors)):
        try:
            out[name] = write(chunks_)
        except Exception as e:  # noqa: BLE001 - whatever a store raises concerns that store only
            out[name] = 0
            out["errors"].append(f"{name}: {type(e).__name__}")
    return out
