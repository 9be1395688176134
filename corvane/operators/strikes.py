"""A strike ledger: each rejection outside a cooldown adds a strike, and the n-th one
closes the key for the n-th Fibonacci number of minutes; an acceptance ends the cooldown."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def minutes(n: int) -> int:
    a, b = 0, 1
    for _ in range(n):
        a, b = b, a + b
    return a


def fold(strikes: int, until: int, events: list[tuple[int, str]]) -> tuple[int, int, int]:
    """(strikes, until, ignored) after (time in ms, kind) events in order."""
    ignored = 0
    for at, kind in events:
        if kind == "accept":
            until = 0
        elif at < until:
            ignored += 1
        else:
            strikes += 1
            until = at + minutes(strikes) * 60_000
    return strikes, until, ignored


def ledger(events: DataFrame, key: str) -> DataFrame:
    """The ledger of each key from rows (key, at, seq, kind); keys with no such row have none.

    Each task streams through its sorted events and holds one key's three numbers, so a
    key with very many events costs time in its task but no memory.
    """
    kind = events.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple | None = None
        for batch in batches:
            done = []
            for k, at, what in zip(batch[key].to_pylist(), batch["at"].to_pylist(), batch["kind"].to_pylist(), strict=True):
                if state is None or state[0] != k:
                    if state:
                        done.append(state)
                    state = (k, 0, 0, 0)
                strikes, until, more = fold(state[1], state[2], [(at, what)])
                state = (k, strikes, until, state[3] + more)
            if done:
                yield _rows(done, batch.schema.field(key).type)
        if state:
            yield _rows([state], batch.schema.field(key).type)

    def _rows(done: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], of), *(pa.array(c, pa.int64()) for c in columns[1:])], [key, "strikes", "until", "ignored"])

    rows = events.where(events[key].isNotNull()).select(key, "at", "seq", "kind").repartition(key).sortWithinPartitions(key, "at", "seq")
    return rows.mapInArrow(run, f"{key} {kind}, strikes long, until long, ignored long")
