"""Approximate nearest neighbours by an inverted file with product-quantised residuals.

Vectors of unit length lie in the lists of their nearest centres.  A list's file holds packed blocks of codes: what is left
of a vector without its centre, cut in parts, each part the number of the nearest of up to 256 codewords.  A question
probes its nearest lists only, whose folders are the partitions that a search reads.  Distances to codes are
sums of a table that is made once a question and list; the best by codes are scored again on their whole vectors, which are
stored by list too.

Questions are a table like the vectors: those that probe a list are packed in blocks, and blocks of questions meet blocks of codes
in a join by list.  Neither goes through the driver, and a hot list is as many rows as it has blocks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import cosine, exact_round
from tessera.storage import keep, new_path

#: Rows that centres and codewords are fitted on, most lists, vectors a block of codes, questions a block.
SAMPLE_ROWS, MOST_LISTS, CODES, ASKED = 20_000, 4096, 1024, 64
_CODEBOOK = 256


def unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def nearest(centers: np.ndarray, points: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the n centres nearest to each point, the nearest first, of equals the smaller number."""
    return np.argsort((centers**2).sum(1) - 2 * points @ centers.T, axis=1, kind="stable")[:, :n]


def lloyd(points: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k centres of ``points``, fewer where there are fewer distinct points; a centre that loses all its points keeps its place."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centers = distinct[np.sort(rng.permutation(len(distinct))[:k])]
    for _ in range(rounds):
        own = nearest(centers, points, 1)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centers))[:, None]
        centers = np.where(n > 0, sums / np.maximum(n, 1), centers)
    return centers


def _vectors(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False))


@dataclass(frozen=True)
class InvertedFile:
    """A written index.  ``codes`` (list, ids, codes) and ``raw`` (list, id, embedding) are folders with a subfolder a list."""

    path: str
    centers: np.ndarray
    books: np.ndarray  # part, codeword, dimension

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, lists: int | None = None, parts: int | None = None, held: int = 2, sample: int = SAMPLE_ROWS, seed: int = 1) -> InvertedFile:
        """Index every row of ``vectors`` (id, embedding); a vector is held by its ``held`` nearest lists, so that neighbours
        across a border are found from both sides.  Centres and codewords are fitted on the ``sample`` rows of the smallest
        hashes of ids.  Rows without embedding are left out; an empty table gives an index without lists."""
        spark = vectors.sparkSession
        path = path or new_path(spark, "ivf")
        given = vectors.select("id", "embedding").where(F.col("embedding").isNotNull())
        some = given.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toPandas()["embedding"]
        if not len(some):
            return cls(path, np.empty((0, 0)), np.empty((0, 0, 0)))
        points = unit(np.stack(some.to_numpy()))
        width = points.shape[1]
        centers = lloyd(points, lists or int(min(MOST_LISTS, max(1, round(given.count() ** 0.5 / 2)))), seed=seed)
        parts = parts or next(p for p in range(max(1, width // 4), 0, -1) if width % p == 0)
        left = points - centers[nearest(centers, points, 1)[:, 0]]
        fitted = [lloyd(x, _CODEBOOK, seed=seed) for x in np.split(left, parts, axis=1)]
        # Parts of few distinct values have fewer codewords: the last is repeated.
        books = np.stack([np.concatenate([b, np.repeat(b[-1:], _CODEBOOK - len(b), 0)]) for b in fitted])
        out = cls(path, centers, books)
        out._write(given, held)
        return out

    def _write(self, given: DataFrame, held: int) -> None:
        centers, held = self.centers, min(held, len(self.centers))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    own = nearest(centers, unit(_vectors(b.column(1))), held)
                    each = pa.array(np.arange(b.num_rows).repeat(held))
                    yield pa.RecordBatch.from_arrays([pa.array(own.ravel().astype(np.int32)), b.column(0).take(each), b.column(1).take(each)], ["list", "id", "embedding"])

        kinds = [given.schema[c].dataType.simpleString() for c in ("id", "embedding")]
        dealt = given.mapInArrow(assign, f"list int, id {kinds[0]}, embedding {kinds[1]}")
        # Lists are dealt by number and, where they are large, rebalanced: a hot list becomes several files.
        dealt.hint("rebalance", "list").write.partitionBy("list").parquet(f"{self.path}/raw")
        raw = given.sparkSession.read.parquet(f"{self.path}/raw").select("list", "id", "embedding")
        encode = self._encoder(raw.schema["id"].dataType)
        raw.mapInArrow(encode, f"list int, ids array<{kinds[0]}>, codes binary").write.partitionBy("list").parquet(f"{self.path}/codes")
        fs = given.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{self.path}/index.json")
        stream = fs.getFileSystem(given.sparkSession._jsc.hadoopConfiguration()).create(fs, True)
        stream.write(bytearray(json.dumps({"centers": self.centers.tolist(), "books": self.books.tolist()}).encode()))
        stream.close()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> InvertedFile:
        """The index that ``build`` wrote at ``path``."""
        d = json.loads(spark.read.text(f"{path}/index.json", wholetext=True).first()[0])
        return cls(path, np.array(d["centers"]), np.array(d["books"]))

    def _encoder(self, kind):
        centers, books = self.centers, self.books

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = b.column(0).to_numpy()
                for k in np.unique(own):
                    rows = np.nonzero(own == k)[0]
                    for s in range(0, len(rows), CODES):
                        at = pa.array(rows[s : s + CODES])
                        left = unit(_vectors(b.column(2).take(at))) - centers[k]
                        codes = np.stack([nearest(book, x, 1)[:, 0] for book, x in zip(books, np.split(left, len(books), axis=1), strict=True)], 1).astype(np.uint8)
                        ids = b.column(1).take(at)
                        yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([codes.tobytes()], pa.binary())], ["list", "ids", "codes"])

        return encode

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(list, query_id, embedding): a row for each of the ``probes`` lists nearest to a question."""
        centers, n = self.centers, min(probes, len(self.centers))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    own = nearest(centers, unit(_vectors(b.column(1))), n)
                    each = pa.array(np.arange(b.num_rows).repeat(n))
                    yield pa.RecordBatch.from_arrays([pa.array(own.ravel().astype(np.int32)), b.column(0).take(each), b.column(1).take(each)], ["list", "query_id", "embedding"])

        kinds = [queries.schema[c].dataType.simpleString() for c in ("query_id", "embedding")]
        asked = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
        return asked.mapInArrow(probe, f"list int, query_id {kinds[0]}, embedding {kinds[1]}")

    def scan(self, spark: SparkSession, folder: str, lists: list[int]) -> DataFrame:
        """Rows of the folder's ``lists``; no file of another list is read."""
        return spark.read.parquet(f"{self.path}/{folder}").where(F.col("list").isin(lists))

    def candidates(self, asked: DataFrame, lists: list[int], n: int) -> DataFrame:
        """(query_id, id, list): the n nearest by codes of each question of ``asked`` (list, query_id, embedding)."""
        spark, centers, books = asked.sparkSession, self.centers, self.books
        codes = self.scan(spark, "codes", lists)
        block = F.pmod(F.xxhash64("query_id"), F.greatest(F.lit(1), F.ceil(F.col("many") / ASKED)))
        many = asked.groupBy("list").agg(F.count("*").alias("many"))
        packed = asked.join(F.broadcast(many), "list").groupBy("list", block.alias("block")).agg(F.collect_list(F.struct("query_id", "embedding")).alias("asked"))  # a row a list
        kinds = [asked.schema["query_id"].dataType.simpleString(), codes.schema["ids"].dataType.elementType.simpleString()]
        names = ["query_id", "id", "list", "far"]

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for own, asked_, ids, code in zip(*b.columns, strict=True):
                    k, questions, ids = own.as_py(), asked_.values, ids.values
                    left = (unit(_vectors(questions.field(1))) - centers[k]).reshape(len(questions), len(books), 1, -1)
                    far = ((left - books) ** 2).sum(3)  # question, part, codeword
                    at = np.frombuffer(code.as_py(), np.uint8).reshape(-1, len(books)) + _CODEBOOK * np.arange(len(books))
                    sums = np.stack([t[at].sum(1) for t in far.reshape(len(questions), -1)])
                    best = np.argsort(sums, axis=1, kind="stable")[:, :n]
                    m = best.shape[1]
                    yield pa.RecordBatch.from_arrays([questions.field(0).take(pa.array(np.arange(len(questions)).repeat(m))), ids.take(pa.array(best.ravel())), pa.array(np.full(best.size, k, np.int32)), pa.array(np.take_along_axis(sums, best, 1).ravel())], names)

        met = packed.join(codes, "list").select("list", "asked", "ids", "codes").mapInArrow(measure, f"query_id {kinds[0]}, id {kinds[1]}, list int, far double")
        once = met.groupBy("query_id", "id").agg(F.min(F.struct("far", "list")).alias("x")).select("query_id", "id", "x.list", "x.far")
        by = Window.partitionBy("query_id").orderBy("far", "id")
        return once.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n).select("query_id", "id", "list")

    def batch_top_k(self, queries: DataFrame, k: int = 20, probes: int = 10, rescored: int | None = None) -> DataFrame:
        """(query_id, id, vector_score, rank): of each question (query_id, embedding) the k best by cosine of the ``rescored``
        nearest by codes (10 k if not told) in its ``probes`` nearest lists; ties by id.  Zero vectors have score 0."""
        spark = queries.sparkSession
        if not len(self.centers):
            kinds = queries.schema["query_id"].dataType.simpleString()
            return spark.createDataFrame([], f"query_id {kinds}, id bigint, vector_score double, rank int")
        asked = keep(self.probed(queries, probes), "ivf-asked")
        lists = sorted(r[0] for r in asked.select("list").distinct().collect())  # at most MOST_LISTS or what build was told
        best = keep(self.candidates(asked, lists, rescored or 10 * k), "ivf-best")
        raw = self.scan(spark, "raw", lists).withColumnRenamed("embedding", "v")
        whole = best.join(queries.select("query_id", "embedding"), "query_id").join(raw, ["list", "id"])
        scored = whole.select("query_id", "id", exact_round(F.coalesce(cosine(F.col("v"), F.col("embedding")), F.lit(0.0)), 6).alias("vector_score"))
        by = Window.partitionBy("query_id").orderBy(F.col("vector_score").desc(), "id")
        return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
