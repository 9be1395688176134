"""One run of a walk back through the history of many rooms at once: what it reaches, its tally and its report.

A run reads a room's pages from the newest on and handles the pictures on them until a
cap is reached, after the failures that earlier runs owe. What it reaches is found from
counts of pages (at most ``most_pages`` for a room) and from places inside a page, so no
room's history is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pictures and pages of one run, and outcomes other than done.
CAP, PAGES = 500, 40
OUTCOMES = {"tags-blocked": "blocked", "strip-refused": "refused", "held-hidden": "hidden", "failed": "failed"}
_COUNTS = ("done", "blocked", "refused", "hidden", "failed")
_FAILURE = "array<struct<event_id:string,url:string,attempts:long,error:string>>"

# The words of a report, in their order.
_PARTS = {
    "retried": "earlier failure(s) retried",
    "blocked": "posted but tag state blocked",
    "refused": "NOT posted: generation data would not strip (see the [strip] lines)",
    "hidden": "NOT posted: the booru holds them under a deleted or jailed post (see the [skip] lines; not retried)",
    "failed": "failed (retried on the next run)",
}
_CAPPED = "stopped at the cap"
_CLOSED, _OPEN_GAP = "; caught up to where the last walk began", "; the gap since the last walk is NOT fully walked (!backfill restart walks it)"
_START = "; reached the start of the room (or the furthest back the bot may read)"
_OLDER, _RESUMES = "; OLDER HISTORY NOT YET WALKED (", ") -- the sweep resumes it, or !backfill"
_ERROR, _STALLED, _AT_CAP = "stopped by an error, named in the bridge log's history page line", "the homeserver's pagination token stopped moving", "this run's picture cap was reached"


def _class(outcome: Column) -> Column:
    out = F.lit("done")
    for name, part in OUTCOMES.items():
        out = F.when(outcome == name, part).otherwise(out)
    return out


def _owed(owed: DataFrame, room: str, cap: int) -> DataFrame:
    """What becomes of each owed failure: carried (beyond the cap), unreadable, dropped, or its outcome's class.

    A room owes at most what its runs' caps left, so its list is sorted in one task."""
    w = Window.partitionBy(room).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    readable = ~F.col("outcome").isin("unreadable", "gone")
    before = F.coalesce(F.count_if(readable).over(w), F.lit(0))
    became = F.when(before >= cap, "carried").when(F.col("outcome") == "unreadable", "unreadable").when(F.col("outcome") == "gone", "dropped").otherwise(_class(F.col("outcome")))
    return owed.withColumn("became", became)


def run(rooms: DataFrame, pages: DataFrame, pictures: DataFrame, owed: DataFrame, room: str, cap: int = CAP, most_pages: int = PAGES) -> DataFrame:
    """The result of a run for each of ``rooms(room, start)``, where ``start`` is the token to go on from.

    ``pages(room, page, first, end, error)``: the answers of the history, ``page`` from 1,
    with the token a page begins at, the one of the next (null at the start of the room),
    or an error. ``pictures(room, page, seq, event_id, url, outcome, error)``: the pictures of
    each page, ``seq`` in their order, with what handling one gives. ``owed(room, seq,
    event_id, url, attempts, outcome, error)``: failures of earlier runs, where the outcome
    may also be ``unreadable`` (kept as it is) or ``gone`` (dropped, not retried).

    Adds ``seen done blocked refused hidden failed retried pages capped cursor
    reached_start stalled head error failures dropped``. A run stops part-way through a page
    at the cap, and its cursor stays at that page's start.
    """
    old = _owed(owed, room, cap)
    tried = F.col("became").isin(*_COUNTS)
    debts = old.groupBy(room).agg(F.count_if(tried).alias("retried"))
    # a page counts while the run is not full before it, and up to the first that ends the walk
    per_page = pictures.where(F.col("page") <= most_pages).groupBy(room, "page").agg(F.count("*").alias("n"))
    w = Window.partitionBy(room).orderBy("page")
    walk = pages.where(F.col("page") <= most_pages).join(per_page, [room, "page"], "left").join(rooms.select(room, "start"), room).join(debts, room, "left")
    walk = walk.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.coalesce("retried", F.lit(0)))
    walk = walk.withColumn("at", F.coalesce(F.lag("end").over(w), F.when(F.col("page") == 1, F.col("start"))))
    stops = F.when(F.col("error").isNotNull(), "error").when(F.col("before") + F.col("n") > cap, "partial").when(F.col("end").isNull(), "start").when(F.col("end").eqNullSafe(F.col("at")), "stalled")
    walk = walk.withColumn("stops", stops).withColumn("stopped", F.coalesce(F.count("stops").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0)
    walk = walk.where(~F.col("stopped") & (F.col("before") < cap))
    read = F.col("stops").isNull() | (F.col("stops") != "error")
    last = F.max_by(F.struct("stops", F.when(F.col("stops").isNull(), F.col("end")).otherwise(F.col("at")).alias("cursor"), "error"), "page")
    walked = walk.groupBy(room).agg(F.count_if(read).alias("pages"), F.sum(F.when(read, F.col("n"))).alias("seen"), last.alias("last"), F.max(F.when(F.col("start").isNull() & (F.col("page") == 1) & read, F.col("first"))).alias("head"))

    # pictures of a page that is read whole need no place in it
    place = F.row_number().over(Window.partitionBy(room, "page").orderBy("seq"))
    found = pictures.join(walk.where(read).select(room, "page", "before"), [room, "page"]).withColumn("i", place).where(F.col("before") + F.col("i") <= cap)
    found = found.select(room, F.col("page").cast("long").alias("page"), "seq", "event_id", "url", F.lit(0).cast("long").alias("attempts"), "error", _class(F.col("outcome")).alias("became"))
    old = old.select(room, F.lit(0).cast("long").alias("page"), "seq", "event_id", "url", F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), "error", "became")
    failure = F.struct("page", "seq", F.col("event_id").cast("string").alias("event_id"), "url", (F.col("attempts") + F.when(F.col("became") == "failed", 1).otherwise(0)).alias("attempts"), "error")
    listed = lambda *classes: F.array_sort(F.collect_list(F.when(F.col("became").isin(*classes), failure)))
    plain = lambda c: F.transform(c, lambda f: F.struct(f["event_id"].alias("event_id"), f["url"].alias("url"), f["attempts"].alias("attempts"), f["error"].alias("error")))
    tally = found.unionByName(old).groupBy(room).agg(
        *(F.count_if(F.col("became") == c).alias(c) for c in _COUNTS),
        plain(listed("failed", "carried", "unreadable")).alias("failures"), plain(listed("dropped")).alias("dropped"),
    )
    out = rooms.join(walked, room, "left").join(tally, room, "left").join(debts, room, "left")
    numbers = {c: F.coalesce(c, F.lit(0)).cast("long") for c in (*_COUNTS, "retried", "pages", "seen")}
    lists = {c: F.coalesce(c, F.array().cast(_FAILURE)) for c in ("failures", "dropped")}
    out = out.withColumns({**numbers, **lists})
    handled = sum((F.col(c) for c in _COUNTS[1:]), F.col(_COUNTS[0]))
    why = F.col("last")["stops"]
    ends = {"reached_start": why == "start", "stalled": why == "stalled"}
    out = out.withColumns({"capped": handled >= cap, **{k: F.coalesce(v, F.lit(False)) for k, v in ends.items()}, "error": F.when(why == "error", F.col("last")["error"]), "cursor": F.when(F.col("last").isNull(), F.col("start")).otherwise(F.col("last")["cursor"])})
    return out.select(*rooms.columns, "seen", *_COUNTS, "retried", "pages", "capped", "cursor", "reached_start", "stalled", "head", "error", "failures", "dropped")


def report(kind: Column, room: Column, ms: Column) -> Column:
    """A line on a run's result (its columns as ``run`` gives them): every count that is not zero, and how the walk ended."""
    say = lambda n, words: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {words}")))
    bits = F.concat_ws(", ", F.concat(F.col("done").cast("string"), F.lit(" done")), *(say(n, words) for n, words in _PARTS.items()), F.when(F.col("capped"), _CAPPED))
    why = F.when(F.coalesce(F.col("error"), F.lit("")) != "", _ERROR).when(F.col("stalled"), _STALLED).when(F.col("capped"), _AT_CAP).otherwise(F.concat(F.lit("this run's "), F.col("pages").cast("string"), F.lit("-page budget was spent")))
    tail = F.when(kind == "gap", F.when(F.col("reached_start"), _CLOSED).otherwise(_OPEN_GAP)).when(kind == "retry", "").when(F.col("reached_start"), _START).otherwise(F.concat(F.lit(_OLDER), why, F.lit(_RESUMES)))
    # halves go up
    seconds = F.floor(ms / 1000 + 0.5).cast("string")
    return F.concat(F.lit("[backfill] "), room.cast("string"), F.lit(": "), F.col("seen").cast("string"), F.lit(" image(s) found, "), bits, F.lit(" in "), seconds, F.lit("s"), tail)
