"""Shared helpers: table access, tables written to the shared folder, components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the text contracts name: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Without ``spark.checkpoint.dir``, a temporary one in local mode, an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Paths of the tables made within each open ``temporary``, the innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables saved within go at the end, but for those saved as ``kept``, which belong to what is around it."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def save(df: DataFrame, tag: str, kept: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    if len(_OPEN) > kept:
        _OPEN[-1 - kept].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete a table made by ``save`` that no plan reads any more."""
    remove(df.sparkSession, df._written_at)


def give_back() -> None:
    """Return to the machine the memory that this process's allocators hold unused."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim:
        trim(0)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` over batches, which gives unused memory back at its end: Spark keeps a Python worker for the next
    task, and what it held at most would stand beside the heap of stages that run no Python."""

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (id, component), component the smallest id.

    Alternates large-star and small-star steps (each a map-side combined minimum and a join
    whose two sides are written tables, so that a hub's edges can be split over tasks) until
    every edge points at its component's smallest id.  No edge list reaches the driver.  Tables are written in as
    many files as their edges need, at least one a core.
    """
    spark = edges.sparkSession
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    n = now.count()
    while True:
        parts = max(spark.sparkContext.defaultParallelism, n // 100_000)
        both = now.union(now.select("v", "u"))
        low = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts), "cc-low")
        # large star: every larger neighbour of u goes to the smallest of u's neighbourhood
        large = save(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(parts), "cc-large")
        # small star: u's smaller neighbours, and u, go to the smallest of them
        least = save(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts), "cc-least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        nxt = save(small.coalesce(parts), "cc")
        before, n = n, nxt.count()
        changed = n != before or not nxt.join(now, ["u", "v"], "left_anti").isEmpty()
        for x in (now, low, large, least):
            drop(x)
        now = nxt
        if not changed:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
