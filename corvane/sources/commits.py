"""Tables that several writers change together, by optimistic commits.

A store is a folder with ``data``, where every write gets a folder of its own, and
``versions``, one small file for each commit that says which folders make up each table.
A commit writes its data first and then creates the file of the next version, by a
rename that fails if the file is there. So a reader sees a version whole or not at all,
a run that dies in between leaves the version before it as it was, and of two writers
that began at the same version one gets a ``Conflict`` and begins anew on what the other
has left: nothing is lost.

A table is a list of folders, or, where rows are changed by their key, a folder for each
bucket of a hash of the key, of which a change rewrites only those that it touches.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


@dataclass
class Replace:
    """The whole table anew."""

    rows: DataFrame


@dataclass
class Append:
    """Rows beside those that are there."""

    rows: DataFrame


@dataclass
class Upsert:
    """Rows by their key, in place of those that have it; a key may come once only."""

    rows: DataFrame
    key: list[str]
    buckets: int = 64


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name in ``spark.checkpoint.dir``; on a local master without that setting, in a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="corvane-store-")
    return f"{top}/store-{uuid.uuid4().hex}"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The last version; 0 before the first commit."""
        folder = self._at("versions")
        if not self._fs.exists(folder):
            return 0
        names = (f.getPath().getName() for f in self._fs.listStatus(folder))
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _manifest(self, version: int | None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"meta": {}, "tables": {}}
        stream = self._fs.open(self._at(f"versions/{version:020}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def meta(self, version: int | None = None) -> dict:
        """What the commit of a version, or the last one, has put beside its tables."""
        return self._manifest(version)["meta"]

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version, or the last one; None before its first write."""
        table = self._manifest(version)["tables"].get(name)
        return None if table is None else self._rows(table)

    def _rows(self, table: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        folders = table["folders"] if buckets is None else [table["folders"][str(b)] for b in buckets if str(b) in table["folders"]]
        folders = sorted(set(folders.values() if isinstance(folders, dict) else folders))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def commit(self, base: int, meta: dict | Callable[[], dict] | None = None, **writes: Replace | Append | Upsert) -> int:
        """Write version ``base + 1``: the tables of ``base`` with these changes, and ``meta`` over what was there.

        ``meta`` may be a function, which is called when the data are written. Raises ``Conflict`` if that version is there already.
        """
        manifest, made = self._manifest(base), []
        try:
            for name, write in writes.items():
                folder = f"data/{uuid.uuid4().hex}"
                made.append(folder)
                manifest["tables"][name] = self._written(manifest["tables"].get(name), write, folder)
            manifest["meta"] |= (meta() if callable(meta) else meta) or {}
            self._create(base + 1, json.dumps(manifest))
        except BaseException:
            for folder in made:
                self._fs.delete(self._at(folder), True)
            raise
        return base + 1

    def _written(self, there: dict | None, write: Replace | Append | Upsert, folder: str) -> dict:
        if isinstance(write, Upsert):
            return self._merged(there, write, folder)
        write.rows.write.parquet(f"{self.path}/{folder}")
        before = there["folders"] if there and isinstance(write, Append) else []
        return {"schema": write.rows.schema.jsonValue(), "folders": [*before, folder]}

    def _merged(self, there: dict | None, write: Upsert, folder: str) -> dict:
        table = there or {"schema": write.rows.schema.jsonValue(), "folders": {}, "key": write.key, "buckets": write.buckets}
        bucket = F.pmod(F.xxhash64(*table["key"]), F.lit(table["buckets"])).cast("int").alias(_BUCKET)
        delta = f"{self.path}/{folder}/delta"
        write.rows.select("*", bucket).write.parquet(delta)
        new = self.spark.read.parquet(delta)
        if not new.groupBy(*table["key"]).count().where("count > 1").isEmpty():
            raise ValueError(f"rows repeat a key of {table['key']}")
        touched = [r[0] for r in new.select(_BUCKET).distinct().collect()]  # as many as there are buckets at most
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in table["key"]]
        old = self._rows(table, touched).select("*", bucket).alias("o").join(new.alias("n"), _all(same), "left_anti")
        # a bucket of any size is written by tasks of Spark's advisory size
        new.unionByName(old).hint("rebalance", F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}/rows")
        self._fs.delete(self._hadoop.Path(delta), True)
        return table | {"folders": table["folders"] | {str(b): f"{folder}/rows/{_BUCKET}={b}" for b in touched}}

    def _create(self, version: int, text: str) -> None:
        """A version's file, made whole or not at all, and never twice."""
        beside, there = self._at(f"versions/.{uuid.uuid4().hex}"), self._at(f"versions/{version:020}")
        stream = self._fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        none = getattr(self._hadoop, "Options$Rename").NONE
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        options[0] = none
        try:
            self._hadoop.FileContext.getFileContext(there.toUri(), self._conf).rename(beside, there, options)
        except Exception as e:
            self._fs.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} of {self.path} is there already") from e
            raise

    def update(self, change: Callable[[Store, int], dict | None], attempts: int = 20) -> int:
        """Commit what ``change`` makes of the last version; after a conflict, of the version then last.

        ``change(store, version)`` returns the arguments of ``commit``, or None if there is nothing to write.
        """
        for _ in range(attempts):
            base = self.version()
            made = change(self, base)
            if made is None:
                return base
            try:
                return self.commit(base, **made)
            except Conflict:
                continue
        raise Conflict(f"{attempts} attempts on {self.path} met other writers")

    def sweep(self, keep: int = 10, older_than_ms: int = 86_400_000) -> int:
        """Delete versions before the last ``keep``, and data that no version left names; both only if old enough
        that no reader or writer is still at them. How many folders went."""
        last, before = self.version(), int(time.time() * 1000) - older_than_ms
        names, gone = set(), 0
        for f in self._fs.listStatus(self._at("versions")) if last else []:
            n = f.getPath().getName()
            if n.isdigit() and int(n) <= last - keep and f.getModificationTime() < before:
                self._fs.delete(f.getPath(), False)
            elif n.isdigit():
                for t in self._manifest(int(n))["tables"].values():
                    names |= {x.split("/")[1] for x in (t["folders"].values() if isinstance(t["folders"], dict) else t["folders"])}
        for f in self._fs.listStatus(self._at("data")) if self._fs.exists(self._at("data")) else []:
            if f.getPath().getName() not in names and f.getModificationTime() < before:
                gone += bool(self._fs.delete(f.getPath(), True))
        return gone


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def merged_keys(store: Store, name: str, rows: DataFrame, key: list[str]) -> int:
    """Add rows whose key the table lacks; those that are there stay. Safe beside other writers."""

    def change(store: Store, version: int) -> dict | None:
        there, new = store.read(name, version), rows.dropDuplicates(key)
        if there is not None:
            same = _all([F.col(f"n.{k}").eqNullSafe(F.col(f"t.{k}")) for k in key])
            new = new.alias("n").join(there.alias("t"), same, "left_anti")
        return None if new.isEmpty() else {name: Append(new)}

    return store.update(change)


def recorded(store: Store, table: str, rows: DataFrame, key: list[str], private: list[str], buckets: int = 64) -> DataFrame:
    """Put rows into a table by their key, and give back what is public of those that were written."""
    store.update(lambda s, v: {table: Upsert(rows, key, buckets)})
    return store.read(table).join(rows.select(*key), key, "left_semi").drop(*private)
