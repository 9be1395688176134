"""Writes that can be repeated: replaced tables, append-only logs, entries published once."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Where a table stands while a new one takes its place.
_OLD = "__old"


def replace(df: DataFrame, path: str) -> None:
    """The whole table anew: written beside the old one, which steps aside before the new one takes its place.

    A run that stops in between leaves the old table whole, where ``stored`` finds it.
    Readers by the path alone find no table for the instant between the two renames;
    tables that are read all the time belong into a ``Store``.
    """
    spark, beside = df.sparkSession, f"{path}__new-{uuid.uuid4().hex}"
    try:
        df.write.parquet(beside)
        if exists(spark, path):
            remove(spark, f"{path}{_OLD}")
            _rename(spark, path, f"{path}{_OLD}")
        _rename(spark, beside, path)
    finally:
        remove(spark, beside)
    remove(spark, f"{path}{_OLD}")


def append_log(df: DataFrame, path: str) -> None:
    """Rows at the end of a log of JSON lines."""
    df.write.mode("append").json(path)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, by the file system that Spark reads the path with."""
    p, fs = _file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all that is in it; False if there was none."""
    p, fs = _file_system(spark, path)
    return fs.delete(p, True)


def _rename(spark: SparkSession, path: str, to: str) -> bool:
    """Move a folder to a name that is free; False if it is taken. One step on a file system like HDFS."""
    p, _ = _file_system(spark, path)
    hadoop, sc = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext
    kinds = getattr(hadoop, "Options$Rename")
    options = sc._gateway.new_array(kinds, 1)
    options[0] = kinds.NONE
    there = hadoop.Path(to)
    try:
        hadoop.FileContext.getFileContext(there.toUri(), sc._jsc.hadoopConfiguration()).rename(p, there, options)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "ParentNotDirectory" in str(e) or "not empty" in str(e):
            return False
        raise
    return True


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None before its first write; after a run that stopped while it replaced the table, the old one."""
    for p in (path, f"{path}{_OLD}"):
        if exists(spark, p):
            return spark.read.parquet(p)
    return None


def publish(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not there yet, one row for a key, and say how many.

    Publishing the same rows again writes nothing. The rows are counted as they are written.
    """
    new = df.dropDuplicates([key])
    there = stored(df.sparkSession, path)
    if there is not None:
        new = new.join(there.select(key), key, "left_anti")
    seen = Observation()
    new.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def publish_entry(df: DataFrame, root: str, ident: str) -> bool:
    """Publish a folder of rows under an id in the queue ``root/ready``; False if that id is there already.

    The entry is built in ``root/staging``, where nobody looks, and moved by one rename, so a
    reader sees it whole or not at all. The queue must be there: to create it on demand
    would make a wrong root look like a working one.
    """
    spark = df.sparkSession
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", ident):
        raise ValueError(f"not an id for an entry: {ident!r}")
    if not exists(spark, f"{root}/ready"):
        raise FileNotFoundError(f"no queue at {root}/ready; it is created once, by whoever reads it")
    if exists(spark, f"{root}/ready/{ident}"):
        return False
    staged = f"{root}/staging/{ident}-{uuid.uuid4().hex}"
    try:
        df.write.json(staged)
        return _rename(spark, staged, f"{root}/ready/{ident}")
    finally:
        remove(spark, staged)


def upsert(df: DataFrame, path: str, key: str, ignore: list[str] | None = None) -> int:
    """Write each row by its key unless the stored row is the same but for ``ignore``; how many were written.

    A key may come once only. The new table takes the old one's place as by ``replace``.
    """
    spark = df.sparkSession
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"rows repeat a value of {key}")
    there, seen = stored(spark, path), Observation()
    if there is None:
        replace(df.observe(seen, F.count("*").alias("n")), path)
        return seen.get["n"]
    values = [c for c in df.columns if c != key and c not in (ignore or [])]
    old = there.select(key, F.struct(*values).alias("__old"))
    changed = df.join(old, key, "left").where(~F.struct(*values).eqNullSafe(F.col("__old"))).drop("__old")
    n = changed.count()
    if n:
        replace(changed.unionByName(there.join(changed.select(key), key, "left_anti")), path)
    return n
