"""A versioned log of a plan's state: what each thread had after each node, and where to go on.

An entry is a JSON file that names its thread, step, parent step, node, plain values and the folders of its tables.  Tables are
written once: an entry names again what an earlier one wrote.  Entries appear by a rename, so a reader finds whole
ones.  ``compact`` drops old entries and the tables that only they name.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ENTRY = "thread string, step int, parent int, node string, at double, version int"
VERSION = 1


@dataclass
class Entry:
    step: int
    node: str
    values: dict
    tables: dict[str, DataFrame]


class StateLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _steps(self, thread: str) -> list[int]:
        fs, p = self._fs(f"{self.path}/log/{thread}")
        return sorted(int(n[:-5]) for x in fs.listStatus(p) if (n := x.getPath().getName()).endswith(".json") and n[0] != ".") if fs.exists(p) else []

    def _read(self, thread: str, step: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/log/{thread}/{step:08d}.json", wholetext=True).first()[0])

    def _table(self, df: DataFrame) -> dict[str, str]:
        if not hasattr(df, "_logged_at"):
            path = f"{self.path}/tables/{uuid.uuid4().hex}"
            df.write.parquet(path)
            df._logged_at = path
        return {"path": df._logged_at, "schema": df.schema.json()}

    def append(self, thread: str, node: str, values: dict, tables: dict[str, DataFrame]) -> Entry:
        """The state of ``thread`` after ``node``: its next step.  The returned tables are those written."""
        steps = self._steps(thread)
        step = steps[-1] + 1 if steps else 0
        held = {k: self._table(df) for k, df in tables.items()}
        entry = {"version": VERSION, "thread": thread, "step": step, "parent": steps[-1] if steps else None, "node": node, "at": time.time(), "values": values, "tables": held}
        fs, staged = self._fs(f"{self.path}/log/{thread}/.{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not fs.rename(staged, self._fs(f"{self.path}/log/{thread}/{step:08d}.json")[1]):
            raise RuntimeError(f"step {step} of {thread} is there already: another run writes this thread")
        return self._entry(entry)

    def _entry(self, entry: dict) -> Entry:
        tables = {}
        for k, t in entry["tables"].items():
            schema = StructType.fromJson(json.loads(t["schema"]))
            tables[k] = self.spark.read.schema(schema).parquet(t["path"])
            tables[k]._logged_at = t["path"]
        return Entry(entry["step"], entry["node"], entry["values"], tables)

    def latest(self, thread: str) -> Entry | None:
        steps = self._steps(thread)
        return self._entry(self._read(thread, steps[-1])) if steps else None

    def at(self, thread: str, step: int) -> Entry:
        return self._entry(self._read(thread, step))

    def history(self) -> DataFrame:
        """(thread, step, parent, node, at, version) of all entries."""
        fs, p = self._fs(f"{self.path}/log")
        return self.spark.read.schema(ENTRY).json(f"{self.path}/log/*") if fs.exists(p) else self.spark.createDataFrame([], ENTRY)

    def compact(self, thread: str, keep: int = 1) -> int:
        """Drop all but the last ``keep`` entries of ``thread``, and tables that no entry left names; how many entries went."""
        steps = self._steps(thread)
        old, left = (steps[:-keep], steps[-keep:]) if keep else (steps, [])
        named = {t["path"] for s in left for t in self._read(thread, s)["tables"].values()}
        gone = {t["path"] for s in old for t in self._read(thread, s)["tables"].values()} - named
        for s in old:  # entries first: none is left that names a table which is not there
            fs, p = self._fs(f"{self.path}/log/{thread}/{s:08d}.json")
            fs.delete(p, False)
        for path in gone:
            fs, p = self._fs(path)
            fs.delete(p, True)
        return len(old)
