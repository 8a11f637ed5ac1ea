"""Keyed tables in hash buckets, with snapshots that several tables share.

A table is a list of generations, each written in the same number of buckets by key and sorted by it.  What is put in by a
transaction is one more generation; a manifest names the generations of all tables of a store and appears by a
rename, so that a reader sees all of a transaction or nothing.  A batch is dealt to the buckets, the tables
are not: neither reading nor inserting nor merging moves rows that are there, and a small batch reads the buckets of its keys
only.  ``compact`` writes one generation in place of many.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a batch that are put into the plan as literals, by which buckets are pruned.
LITERAL_KEYS = 500


class KeyedStore:
    """``tables``: name to (key column, schema).  Rows without key are refused."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, str]], buckets: int = 64) -> None:
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets

    # --- manifests ----------------------------------------------------------------------
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/snapshots")
        return sorted(int(n[:-5]) for x in fs.listStatus(p) if (n := x.getPath().getName()).endswith(".json") and n[0] != ".") if fs.exists(p) else []

    def _manifest(self, version: int | None = None) -> dict:
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "tables": {k: [] for k in self.tables}, "batches": {}}
            version = known[-1]
        return json.loads(self.spark.read.text(f"{self.path}/snapshots/{version:08d}.json", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> int:
        version = manifest["version"] + 1
        fs, staged = self._fs(f"{self.path}/snapshots/.{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps({**manifest, "version": version}).encode()))
        out.close()
        to = self._fs(f"{self.path}/snapshots/{version:08d}.json")[1]
        if fs.exists(to) or not fs.rename(staged, to):
            fs.delete(staged, False)
            raise RuntimeError(f"snapshot {version} is there already: another writer was faster")
        return version

    # --- generations --------------------------------------------------------------------
    def _schema(self, name: str):
        return self.spark.createDataFrame([], self.tables[name][1]).schema

    def _write(self, name: str, rows: DataFrame, mode: str) -> dict:
        key = self.tables[name][0]
        gen = f"g{uuid.uuid4().hex}"
        dealt = rows.select(*self._schema(name).fieldNames()).repartition(self.buckets, key)
        dealt.write.bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.path}/{name}/{gen}").format("parquet").saveAsTable(gen)
        return {"gen": gen, "mode": mode}

    def _generation(self, name: str, gen: str) -> DataFrame:
        """The bucketed table of a generation, made known to this session where another one wrote it."""
        if not self.spark.catalog.tableExists(gen):
            key, schema = self.tables[name]
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._schema(name))
            self.spark.sql(f"CREATE TABLE {gen} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}/{gen}'")
        return self.spark.table(gen)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._rows(name, self._manifest(version)["tables"][name])

    def _rows(self, name: str, generations: list[dict], keys: list | None = None) -> DataFrame:
        """Each generation's rows whose keys no later upsert has; joins within buckets."""
        key, out, later = self.tables[name][0], None, []
        for g in reversed(generations):
            rows = self._generation(name, g["gen"])
            rows = rows if keys is None else rows.where(F.col(key).isin(keys))
            for x in later:
                rows = rows.join(x.hint("merge"), key, "left_anti")
            out = rows if out is None else rows.unionByName(out)
            if g["mode"] == "upsert":
                later.append(self._generation(name, g["gen"]).select(key))
        return self.spark.createDataFrame([], self._schema(name)) if out is None else out

    # --- writing ------------------------------------------------------------------------
    @contextmanager
    def transaction(self, batch: tuple[str, int] | None = None) -> Iterator[Transaction]:
        """Changes that become visible together at the end, or not at all.

        ``batch``: (stream, number); a batch whose number, or a later one, was committed before changes nothing.
        """
        now = self._manifest()
        tx = Transaction(self, now)
        tx.repeated = batch is not None and now["batches"].get(batch[0], -1) >= batch[1]
        try:
            yield tx
            if tx.new and not tx.repeated:
                for name, g in tx.new:
                    now["tables"].setdefault(name, []).append(g)
                if batch is not None:
                    now["batches"][batch[0]] = batch[1]
                tx.version = self._publish(now)
        except BaseException:
            for name, g in tx.new:
                self._drop(name, g["gen"])
            raise

    def _drop(self, name: str, gen: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {gen}")
        fs, p = self._fs(f"{self.path}/{name}/{gen}")
        fs.delete(p, True)

    def compact(self, keep: int = 1) -> int:
        """One generation a table; snapshots but the last ``keep`` go, with the generations that only they name."""
        now = self._manifest()
        for name, generations in now["tables"].items():
            if len(generations) > 1:
                now["tables"][name] = [self._write(name, self._rows(name, generations), "insert")]
        version = self._publish(now)
        known = self.versions()
        old, left = known[:-keep], known[-keep:]
        named = {(n, g["gen"]) for v in left for n, gs in self._manifest(v)["tables"].items() for g in gs}
        gone = {(n, g["gen"]) for v in old for n, gs in self._manifest(v)["tables"].items() for g in gs} - named
        for v in old:
            fs, p = self._fs(f"{self.path}/snapshots/{v:08d}.json")
            fs.delete(p, False)
        for n, g in gone:
            self._drop(n, g)
        return version


class Transaction:
    def __init__(self, store: KeyedStore, manifest: dict) -> None:
        self.store, self.manifest = store, manifest
        self.new: list[tuple[str, dict]] = []
        self.repeated, self.version = False, manifest["version"]

    def _generations(self, name: str) -> list[dict]:
        return [*self.manifest["tables"].get(name, []), *(g for n, g in self.new if n == name)]

    def insert_ignore(self, name: str, rows: DataFrame) -> None:
        """Add the rows whose key the table lacks; of equal keys within ``rows`` any one."""
        if self.repeated:
            return
        key = self.store.tables[name][0]
        fresh = self.missing(name, rows.where(F.col(key).isNotNull()).dropDuplicates([key]))
        self.new.append((name, self.store._write(name, fresh, "insert")))

    def missing(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows whose key the table lacks.  ``rows`` are dealt to the buckets; the table stays where it is."""
        key = self.store.tables[name][0]
        some = [r[0] for r in rows.select(key).limit(LITERAL_KEYS + 1).collect()]
        for g in self._generations(name):
            old = self.store._generation(name, g["gen"]).select(key)
            old = old.where(F.col(key).isin(some)) if len(some) <= LITERAL_KEYS else old
            rows = rows.join(old.hint("merge"), key, "left_anti")
        return rows

    def upsert(self, name: str, rows: DataFrame, order: str) -> None:
        """Put in rows in place of those of equal key; of equal keys within ``rows`` that of the largest ``order``."""
        if self.repeated:
            return
        key = self.store.tables[name][0]
        names = self.store._schema(name).fieldNames()
        last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_r")).select("_r.*")
        self.new.append((name, self.store._write(name, last, "upsert")))
