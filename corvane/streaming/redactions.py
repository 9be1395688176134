"""Messages without those that are taken back, as a stream, and the walk that finds what it let go as late.

The stream holds a message for as long as it may be taken back and then lets it through,
or not; its state is bounded by that time and the watermark's delay. What comes after the
watermark is in no stream: ``missed`` finds it later, by one join over what has landed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def kept(messages: DataFrame, redactions: DataFrame, ident: str, at: str, within: str, delay: str = "10 minutes") -> DataFrame:
    """Messages that no redaction within ``within`` after them names (append mode).

    ``redactions(ident, at)``; a message with several is still one that is gone. The
    watermark is that of the stream that is further behind, so a quiet stream of
    redactions needs a row now and then, which may name no message. Messages without an id
    or a time are in no result.
    """
    m = messages.withWatermark(at, delay)
    r = redactions.select(F.col(ident).alias("__ident"), F.col(at).alias("__at")).withWatermark("__at", delay)
    hit = (F.col(ident) == F.col("__ident")) & (F.col("__at") >= F.col(at)) & (F.col("__at") <= F.col(at) + F.expr(f"interval {within}"))
    return m.join(r, hit, "left_outer").where("__ident is null").drop("__ident", "__at")


def settled_until(query: StreamingQuery) -> str | None:
    """The watermark of a stream's last micro-batch, before which it takes no more rows; None before the first."""
    return (query.lastProgress or {}).get("eventTime", {}).get("watermark")


def settled(messages: DataFrame, at: str, within: str, until: str) -> DataFrame:
    """Messages that the stream has decided on by ``until``, or let go as late."""
    return messages.where(F.col(at) + F.expr(f"interval {within}") < F.to_timestamp(F.lit(until)))


def missed(landed: DataFrame, delivered: DataFrame, redactions: DataFrame, ident: str, at: str, within: str, until: str) -> DataFrame:
    """Messages that landed and were neither delivered nor taken back, up to where the stream has decided.

    Messages that wait in the stream's state are newer than that. Unlike the stream the walk
    knows every redaction by now, so it takes a message as gone however late it was taken back.
    """
    rows = settled(landed.where(F.col(ident).isNotNull()), at, within, until)
    return rows.join(delivered.select(ident), ident, "left_anti").join(redactions.select(ident), ident, "left_anti")
