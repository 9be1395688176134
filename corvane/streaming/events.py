"""Event streams: repeats removed, and strike ledgers with state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from corvane.operators.strikes import fold


def without_repeats(stream: DataFrame, key: str, at: str, delay: str = "10 minutes") -> DataFrame:
    """Each key once within ``delay`` of event time; the state is bounded by it, not by a count."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def strike_ledger(stream: DataFrame, key: str) -> DataFrame:
    """The ledger of each key after each micro-batch that touches it (update mode), from rows
    (key, at, seq, kind).

    Events of one micro-batch act in order of ``at``, then ``seq``; between micro-batches
    they act as they arrive. Without late events the last row of each key is that of the
    batch ledger. A micro-batch's events of one key are sorted in one task: bound them by
    ``maxFilesPerTrigger`` at the source.
    """
    schema = f"{key} long, strikes long, until long, ignored long"

    def step(group: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        strikes, until, ignored = state.get if state.exists else (0, 0, 0)
        strikes, until, more = fold(strikes, until, list(zip(rows["at"].tolist(), rows["kind"], strict=True)))
        state.update((strikes, until, ignored + more))
        yield pd.DataFrame({key: [group[0]], "strikes": [strikes], "until": [until], "ignored": [ignored + more]})

    return stream.select(key, "at", "seq", "kind").groupBy(key).applyInPandasWithState(step, schema, "strikes long, until long, ignored long", "update", GroupStateTimeout.NoTimeout)


def queued_files(spark: SparkSession, folder: str, schema: StructType, at_once: int = 100) -> DataFrame:
    """A folder as a queue of JSON files: each once, at most ``at_once`` for a trigger, with ``path``.

    Files act in order of their names inside a micro-batch if it is sorted by ``path``.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).json(folder)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def routed(stream: DataFrame, *routes: tuple[str, Column], otherwise: str = "image") -> DataFrame:
    """Each event with the first route whose condition holds, in this order."""
    route = F.lit(otherwise)
    for name, holds in reversed(routes):
        route = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(route)
    return stream.withColumn("route", route)


def armed_sessions(stream: DataFrame, key: str, span_ms: int = 120_000) -> DataFrame:
    """Sessions that one event arms and the next picture of its key uses: rows (key, at, session),
    from rows (key, at, seq, kind) with kind arm or use; consumed in time, else expired; none
    if nothing was armed. Events of a micro-batch act in order of ``at``, then ``seq``.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(group: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        armed = state.get[0] if state.exists else -1
        out = []
        for at, what in zip(rows["at"].tolist(), rows["kind"], strict=True):
            if what == "arm":
                armed = at
            else:
                out.append((group[0], at, "none" if armed < 0 else "consumed" if at - armed <= span_ms else "expired"))
                armed = -1
        state.update((armed,))
        yield pd.DataFrame(out, columns=[key, "at", "session"])

    return stream.select(key, "at", "seq", "kind").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at long, session string", "armed long", "append", GroupStateTimeout.NoTimeout)
