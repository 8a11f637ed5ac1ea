"""Files as pages: admitted text and PDF files, JSON reports, web pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.bm25 import Bm25Index
from tessera.operators.ingest import admission, sniffed


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, length, reason, content) of every file under ``path``; reason ``ok`` admits it.  Spark's reader passes over empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source"), "length", admission(F.col("path"), F.col("length"), sniffed(F.col("content"))).alias("reason"), "content")


def text_pages(files: DataFrame) -> DataFrame:
    """One page a .txt or .md file: its text, invalid bytes ignored, trimmed."""
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: bytes(x).decode("utf-8", "ignore").strip())

    own = files.where((F.col("reason") == "ok") & ~F.lower("source").endswith(".pdf"))
    return own.select(F.col("source").alias("doc"), F.lit(1).alias("page_num"), F.pandas_udf(decode, "string")("content").alias("text"))


def pdf_pages(files: DataFrame) -> DataFrame:
    """(doc, page_num, text) of .pdf files, with pdfplumber where it is installed."""
    import io

    import pdfplumber

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                with pdfplumber.open(io.BytesIO(bytes(r.content))) as pdf:
                    yield pd.DataFrame([(r.source, k, p.extract_text() or "") for k, p in enumerate(pdf.pages, 1)], columns=["doc", "page_num", "text"])

    own = files.where((F.col("reason") == "ok") & F.lower("source").endswith(".pdf"))
    return own.select("source", "content").mapInPandas(pages, "doc string, page_num int, text string")


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def page_text(html):
    """A page's visible text, white space as single spaces."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", " "), r"\s+", " "))


def web_search(pages: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """Offline web source: BM25 over pages (page_id, url, html); blank pages are left out."""
    texts = pages.select(F.col("page_id").alias("chunk_id"), F.coalesce("url", F.lit("")).alias("url"), F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), page_text(F.col("html")).alias("content")).where(F.trim("content") != "")
    best = Bm25Index.build(texts).top_k(questions, k)
    return best.join(texts, "chunk_id").select("query_id", "url", "title", "content", F.col("bm25_score").alias("score"), "rank")
