"""Progress events as a sink of streams: a Python data source with commits, so that a reader sees whole batches once.

Tasks write their rows as staged files; the commit of a batch writes a manifest that names them, and a reader follows
manifests only.  A batch that is run again after a failure finds its manifest and adds nothing; an aborted one removes what
it staged.  Paths are taken by ``pyarrow.fs``: the folder may be local or in any store that it knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.schemas import TRACES

NAME = "progress_events"


@dataclass
class Staged(WriterCommitMessage):
    file: str | None
    rows: int


class ProgressEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return ProgressWriter(self.options["path"], schema.fieldNames())


class ProgressWriter(DataSourceStreamWriter):
    def __init__(self, path: str, names: list[str]) -> None:
        self.path, self.names = path, names

    def _at(self, *parts: str) -> tuple[fs.FileSystem, str]:
        store, base = fs.FileSystem.from_uri(self.path)
        return store, "/".join((base, *parts))

    def write(self, iterator: Iterator) -> Staged:
        """One file of JSON lines for a task's rows; no rows, no file."""
        name, out, n = f"{uuid.uuid4().hex}.json", None, 0
        for row in iterator:
            if out is None:
                store, at = self._at("events", name)
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                out = store.open_output_stream(at)
            out.write((json.dumps(dict(zip(self.names, row, strict=True)), default=str) + "\n").encode())
            n += 1
        if out is not None:
            out.close()
        return Staged(name if n else None, n)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        files = [m.file for m in messages if m is not None and m.file]
        store, at = self._at("batches", f"{batchId:012d}.json")
        if store.get_file_info(at).type != fs.FileType.NotFound:  # committed before the failure that made Spark run it again
            self.abort(messages, batchId)
            return
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        _, staged = self._at("batches", f".{uuid.uuid4().hex}")
        with store.open_output_stream(staged) as out:
            out.write(json.dumps({"batch": batchId, "rows": sum(m.rows for m in messages if m is not None), "files": files}).encode())
        store.move(staged, at)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        for m in messages:
            if m is not None and m.file:
                store, at = self._at("events", m.file)
                if store.get_file_info(at).type != fs.FileType.NotFound:
                    store.delete_file(at)


def progress(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each new trace row to the events at ``path``; runs what is there and stops."""
    stream.sparkSession.dataSource.register(ProgressEvents)
    return stream.writeStream.format(NAME).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events(spark: SparkSession, path: str, schema: str = TRACES) -> DataFrame:
    """The committed events, with ``batch``; rows staged by a batch that was not committed are not among them."""
    store, base = fs.FileSystem.from_uri(path)
    none = spark.createDataFrame([], f"{schema}, batch bigint")
    if store.get_file_info(f"{base}/batches").type == fs.FileType.NotFound:
        return none
    listed = spark.read.schema("batch bigint, rows bigint, files array<string>").json(f"{path}/batches/*.json").selectExpr("batch", "explode(files) AS file")
    if store.get_file_info(f"{base}/events").type == fs.FileType.NotFound:
        return none
    rows = spark.read.schema(schema).json(f"{path}/events").selectExpr("*", "_metadata.file_name AS file")
    return rows.join(listed, "file").drop("file")
