"""Text, number and time rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def duration(minutes: Column) -> Column:
    """1 minute, 5 minutes, 1 hour, 3 hours, 1h 5m."""
    hours, rest = F.floor(minutes / 60), minutes % 60
    plain = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))
    return F.when(minutes < 60, plain(minutes, "minute")).when(rest == 0, plain(hours, "hour")).otherwise(F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m")))


def backoff_ms(attempts: Column, first: int = 600_000, most: int = 7_200_000) -> Column:
    """``first`` doubled for each further attempt, at most ``most``."""
    return F.least(F.lit(first) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempts - 1)), F.lit(float(most))).cast("long")


def fibonacci_minutes(n: Column) -> Column:
    """The n-th Fibonacci number (1, 1, 2, 3, 5, ...), 0 below 1."""
    pair = F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    done = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), pair, lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b")), lambda s: s["a"])
    return F.when(n >= 1, done).otherwise(F.lit(0).cast("long"))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return ((F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60) * 1_000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1_000)).cast("long")


def entry_id(*parts: Column) -> Column:
    """A key that is the same in every run: sanitised parts, 64 characters at most."""
    return F.substring(F.regexp_replace(F.concat_ws("-", *parts), r"[^A-Za-z0-9_-]", "_"), 1, 64)
