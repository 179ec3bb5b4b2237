"""Derived tables in snapshots by table and vault: a refresh writes new folders for what it touched, and one small file names
the current folder of each.

Readers never see half a refresh: all tables of a vault are written before the pointer moves, and it moves by one atomic
rename. Vaults and tables that did not change are not written again. Writers of different vaults or tables do not undo each
other: each changes its own entries of the pointer, one at a time behind a lock file. Postings are sorted by term within a
vault, so a search skips most of their row groups."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("notes", "edges", "degrees", "postings", "lengths", "state", "vectors")
#: Seconds after which the lock of a writer that died is broken.
LOCK_SECONDS = 60


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def current(self) -> dict | None:
        """The pointer: ``at`` (table to vault to snapshot), ``schemas``, and what else was put with it."""
        p = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _folder(self, table: str, vault: str, snapshot: str) -> str:
        escaped = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(vault)
        return f"{self.root}/{table}/vault={escaped}/snapshot={snapshot}"

    def read(self, table: str, vaults: list[str] | None = None) -> DataFrame | None:
        """A table of the current snapshot, of some vaults or all; none where it was never published."""
        now = self.current()
        if now is None or table not in now["schemas"]:
            return None
        schema = StructType.fromJson(now["schemas"][table])
        wanted = {v: s for v, s in now["at"].get(table, {}).items() if vaults is None or v in vaults}
        folders = [f for v, s in wanted.items() if self._fs.exists(self._path(f := self._folder(table, v, s)))]
        if not folders:
            return self.spark.createDataFrame([], schema)
        full = StructType([*schema.fields, *StructType.fromDDL("snapshot string").fields])
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{table}").parquet(*folders).select(*schema.fieldNames())

    def publish(self, tables: dict[str, DataFrame], vaults: list[str], keep: list[str] | None = None, **meta) -> str:
        """Writes the tables (rows of ``vaults``), side by side, and makes them current for these vaults; of the others only
        ``keep`` stay."""
        name = uuid.uuid4().hex
        if unknown := set(tables) - set(TABLES):
            raise ValueError(f"no such table: {sorted(unknown)}")

        def write(t: str) -> None:
            order = ["vault", "term", "key"]
            out = tables[t].repartitionByRange(*order).sortWithinPartitions(*order) if t == "postings" else tables[t]
            out.withColumn("snapshot", F.lit(name)).write.mode("append").partitionBy("vault", "snapshot").parquet(f"{self.root}/{t}")

        with ThreadPoolExecutor(len(TABLES)) as pool:
            list(pool.map(write, tables))

        def moved(now: dict) -> dict:
            at = {t: {v: s for v, s in of.items() if keep is None or v in keep} for t, of in now["at"].items()}
            for t in tables:
                at[t] = at.get(t, {}) | dict.fromkeys(vaults, name)
            return now | {"at": at, "schemas": now["schemas"] | {t: json.loads(df.schema.json()) for t, df in tables.items()}} | meta

        self._change(moved)
        return name

    def _change(self, moved: Callable[[dict], dict]) -> None:
        """Moves the pointer from what it is now, with no other writer in between."""
        lock = self._path(f"{self.root}/.LOCK")
        self._fs.mkdirs(self._path(self.root))
        began = time.monotonic()
        while not self._fs.createNewFile(lock):
            if time.monotonic() - began > LOCK_SECONDS:
                self._fs.delete(lock, False)
                began = time.monotonic()
            time.sleep(0.05)
        try:
            self._point(moved(self.current() or {"at": {}, "schemas": {}}))
        finally:
            self._fs.delete(lock, False)

    def _point(self, now: dict) -> None:
        temporary, target = self._path(f"{self.root}/.CURRENT-{uuid.uuid4().hex}"), self._path(f"{self.root}/CURRENT")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(json.dumps(now).encode()))
        stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        context.rename(temporary, target, overwrite)

    def vacuum(self) -> int:
        """Deletes the folders of snapshots that are not current; how many."""
        now, n = (self.current() or {"at": {}}), 0
        escape = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for t in TABLES:
            live = {(escape(v), s) for v, s in now["at"].get(t, {}).items()}
            top = self._path(f"{self.root}/{t}")
            if not self._fs.exists(top):
                continue
            for by_vault in self._fs.listStatus(top):
                if by_vault.isDirectory():
                    for s in self._fs.listStatus(by_vault.getPath()):
                        at = (by_vault.getPath().getName().removeprefix("vault="), s.getPath().getName().removeprefix("snapshot="))
                        if at not in live:
                            self._fs.delete(s.getPath(), True)
                            n += 1
        return n
