"""State that ends by timers, and state that is bounded by a count.

These streams need the RocksDB state store (``ROCKSDB``). Rows of a key arrive in any
order within a micro-batch and act in order of time; across micro-batches they act as
they arrive. What a key has to sort is its own rows of one micro-batch, which the
source's limits bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvane.operators.strikes import fold

#: The setting that these streams need.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Sessions(StatefulProcessor):
    """One armed session a key at most; a timer at its end."""

    def __init__(self, key: str, span_ms: int):
        self.key, self.span = key, span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.armed = handle.getValueState("armed", "at long")

    def _disarm(self, at: int) -> None:
        self.armed.clear()
        self.handle.deleteTimer(at + self.span + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((r for df in rows for r in zip(df["ms"].tolist(), df["seq"].tolist(), df["kind"].tolist(), strict=True)))
        out = []
        for at, _, kind in events:
            armed = self.armed.get()[0] if self.armed.exists() else None
            if armed is not None and at > armed + self.span:  # its timer has yet to come
                out.append((key[0], armed + self.span, "expired"))
                self._disarm(armed)
                armed = None
            if kind == "arm":
                if armed is not None:
                    self._disarm(armed)
                self.armed.update((at,))
                self.handle.registerTimer(at + self.span + 1)
            elif armed is None:
                out.append((key[0], at, "none"))
            else:
                out.append((key[0], at, "consumed"))
                self._disarm(armed)
        yield pd.DataFrame(out, columns=[self.key, "at", "session"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.armed.exists():
            at = self.armed.get()[0]
            self.armed.clear()
            yield pd.DataFrame([(key[0], at + self.span, "expired")], columns=[self.key, "at", "session"])

    def close(self) -> None:
        pass


def timed_sessions(stream: DataFrame, key: str, span_ms: int = 120_000, delay: str = "0 seconds") -> DataFrame:
    """Sessions that one event arms and the next picture of its key uses: rows (key, at, session).

    From rows (key, at timestamp, seq, kind) with kind arm or use. A use is ``consumed``
    within the span, else ``none``; a session that nobody uses ends by a timer, when the
    watermark passes its end, as ``expired`` at that time, without a further event of its
    key, and its state goes.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, F.col("at"), "seq", "kind", F.unix_millis(F.col("at").cast("timestamp")).alias("ms")).withWatermark("at", delay)
    return rows.groupBy(key).transformWithStateInPandas(_Sessions(key, span_ms), f"{key} {kind}, at long, session string", "Append", "EventTime")


class _Ledger(StatefulProcessor):
    """Strikes and cooldown of a key; forgotten when nothing came for a while."""

    def __init__(self, key: str, ttl_ms: int | None):
        self.key, self.ttl = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ledger", "strikes long, until long, ignored long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((r for df in rows for r in zip(df["at"].tolist(), df["seq"].tolist(), df["kind"].tolist(), strict=True)))
        strikes, until, ignored = self.state.get() if self.state.exists() else (0, 0, 0)
        strikes, until, more = fold(strikes, until, [(at, kind) for at, _, kind in events])
        self.state.update((strikes, until, ignored + more))
        yield pd.DataFrame([(key[0], strikes, until, ignored + more)], columns=[self.key, "strikes", "until", "ignored"])

    def close(self) -> None:
        pass


def timed_ledger(stream: DataFrame, key: str, ttl_ms: int | None = None) -> DataFrame:
    """The ledger of each key after each micro-batch that touches it, from rows (key, at, seq, kind).

    With ``ttl_ms`` a key's ledger is forgotten when it was not touched for that long (of
    processing time); without, strikes never decay, as the rule has it, and neither does the state.
    """
    kind = stream.schema[key].dataType.simpleString()
    mode = "ProcessingTime" if ttl_ms else "None"
    return stream.select(key, "at", "seq", "kind").groupBy(key).transformWithStateInPandas(_Ledger(key, ttl_ms), f"{key} {kind}, strikes long, until long, ignored long", "Update", mode)


class _Recent(StatefulProcessor):
    """The last ids of a key, oldest first."""

    def __init__(self, ident: str, kind: str, columns: list[str], last: int):
        self.ident, self.kind, self.columns, self.last = ident, kind, columns, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", f"id {self.kind}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        order = [x[0] for x in self.seen.get()] if self.seen.exists() else []
        known = set(order)
        for df in rows:
            new = []
            for i, ident in enumerate(df[self.ident].tolist()):
                if ident not in known:
                    new.append(i)
                    order.append(ident)
                    known.add(ident)
                    if len(order) > self.last:
                        known.discard(order[-self.last - 1])
            del order[: -self.last]
            if new:
                yield df.iloc[new][self.columns]
        self.seen.put([(x,) for x in order])

    def close(self) -> None:
        pass


def without_recent_repeats(stream: DataFrame, key: str, ident: str, last: int = 1_000) -> DataFrame:
    """Rows whose id is not among the last ``last`` ids of their key that passed; the state is bounded by that count, not by time."""
    kind = stream.schema[ident].dataType.simpleString()
    return stream.groupBy(key).transformWithStateInPandas(_Recent(ident, kind, stream.columns, last), stream.schema, "Append", "None")
