"""Append-only logs of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Column of the lines that do not parse.
BAD = "_bad"


def read_log(spark: SparkSession, path: str, schema: StructType, bad: str = "fail") -> DataFrame:
    """Rows of a log with an explicit schema.

    A line that does not parse fails the query (``fail``), goes (``skip``), or stays as a
    row of nulls with the line in ``_bad`` (``keep``). Blank lines are no rows.
    """
    if bad == "fail":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    with_bad = StructType([*schema.fields]).add(BAD, StringType())
    rows = spark.read.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
    if bad == "keep":
        return rows
    if bad != "skip":
        raise ValueError(f"no such policy: {bad}")
    # a query on the bad column alone is refused by Spark, one that names others too is not
    return rows.where(F.col(BAD).isNull()).drop(BAD)


def read_state(spark: SparkSession, path: str, schema: StructType, corrupt: str = "fail") -> DataFrame:
    """A keyed state of JSON lines: no rows before its first write, and never none for a corrupt one
    unless ``corrupt`` says skip."""
    from corvane.sources.sinks import exists

    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_log(spark, path, schema, corrupt)


def since(log: DataFrame, at: str, cutoff) -> DataFrame:
    """Rows strictly after the cutoff."""
    return log.where(F.col(at) > cutoff)
