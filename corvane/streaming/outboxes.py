"""An outbox that outlives its runs: reports come in, answers settle them, one pass sweeps what is due.

It is the table ``outbox(post_id, mxc, queued_at, attempts, last_class, next_try_at)`` of a
store, at most ``cap`` rows. Every change reads the last version and commits the next one,
anew if another writer was first, so writers lose nothing of each other's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import outbox
from corvane.sources.commits import Replace, Store

KEY = ["post_id", "mxc"]
SCHEMA = "post_id long, mxc string, queued_at long, attempts long, last_class string, next_try_at long"
#: A pass takes no answer that would begin later than this after its start.
BUDGET_MS = 480_000


def _now(store: Store, version: int) -> DataFrame:
    there = store.read("outbox", version)
    return store.spark.createDataFrame([], SCHEMA) if there is None else there


def report(store: Store, new: DataFrame, now: int, cap: int = outbox.CAP) -> dict:
    """Queue reports ``new(post_id, mxc)``, due at once: those that are there change nothing, past the cap further ones are refused."""
    counts: dict[str, int] = {}

    def change(s: Store, version: int) -> dict | None:
        valid = new.where((F.col("post_id") > 0) & (F.col("mxc") != ""))
        rows = outbox.added(_now(s, version), valid, KEY, F.lit(now).cast("long"), cap).persist()
        try:
            counts.clear()
            counts.update({r.state: r["count"] for r in rows.groupBy("state").count().collect()})
            # at most ``cap`` rows, so they may come to the driver and the plan begins anew
            kept = rows.where("state <> 'refused'").select(*(f.split()[0] for f in SCHEMA.split(", "))).collect() if counts.get("queued") else []
        finally:
            rows.unpersist()
        return {"outbox": Replace(s.spark.createDataFrame(kept, SCHEMA))} if kept else None

    store.update(change)
    return {"queued": counts.get("queued", 0), "refused": counts.get("refused", 0)}


def answered(store: Store, answers: DataFrame, now: int) -> None:
    """Settle entries by ``answers(post_id, mxc, cls)``: accepted and dropped ones go, others wait longer each time."""
    store.update(lambda s, v: {"outbox": Replace(_settled(_now(s, v), answers, now))})


def _settled(there: DataFrame, answers: DataFrame, now: int) -> DataFrame:
    rows = outbox.settled(there, answers.dropDuplicates(KEY), KEY, F.lit(now).cast("long"))
    return rows.select(*(F.col(c).cast(kind) for c, kind in (f.split() for f in SCHEMA.split(", "))))


def flush(store: Store, ask: Callable[[DataFrame], DataFrame], now: int, batch: int = outbox.BATCH, breaker: int = outbox.BREAKER, budget_ms: int = BUDGET_MS) -> dict:
    """One pass over what is due: ``ask`` adds ``cls`` and ``took`` (ms) to the first ``batch`` entries.

    Answers count in order, up to the ``breaker``-th unanswered one in a row, and as long as
    those before them took no longer than the budget; the others wait for the next pass.
    """
    tally: dict = {}

    def change(s: Store, version: int) -> dict | None:
        there = _now(s, version)
        due = there.where(~F.coalesce(F.col("next_try_at") > now, F.lit(False)))
        n = due.count()
        first = due.orderBy(*(F.col(c).asc_nulls_first() for c in ("next_try_at", "queued_at", *KEY))).limit(batch)
        swept = outbox.sweep(ask(first), F.lit(now).cast("long"), ["next_try_at", "queued_at", *KEY], batch, breaker)
        before = F.coalesce(F.sum("took").over(Window.partitionBy(F.lit(0)).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most ``batch`` rows
        rows = swept.withColumn("late", before > budget_ms).collect()
        sent = [r for r in rows if not r.late]
        tally.clear()
        tally.update(due=n, sent=len(sent), accepted=sum(r.cls == "accepted" for r in sent), dropped=sum(r.cls in outbox.DROPPED for r in sent), deferred=n - len(sent), stopped=None)
        tally["kept"] = tally["sent"] - tally["accepted"] - tally["dropped"]
        if len(sent) < len(rows):
            tally["stopped"] = "budget"
        elif len(sent) >= breaker and all(r.cls == "retry" for r in sent[-breaker:]):
            tally["stopped"] = "unanswered"
        if not sent:
            return None
        answers = s.spark.createDataFrame([(r.post_id, r.mxc, r.cls) for r in sent], "post_id long, mxc string, cls string")
        return {"outbox": Replace(_settled(there, answers, now))}

    store.update(change)
    return tally
