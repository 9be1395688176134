"""A view of stored rows that follows a polled list, version by version.

The store has the tables ``names(name)`` and ``posts(post_id, mxc, md5, flagged,
banished)`` of the list as last read, the stored rows ``state(room, mxc, post_id, tags,
rating, sources)`` by (room, mxc), the writes that are ``held`` while the list is unread,
and those that are ``parked`` while their post is flagged. Beside them each version says
which version of the list the rows were last projected from. A change touches the rows of
the posts that joined or left, or of all of both lists if names changed; these alone are
read again from what is known of their posts, so a row whose post left the list gets its
tags back. A projection that is not complete is owed again after a while.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corvane.operators import snapshots
from corvane.sources.commits import Replace, Store, Upsert

# How long a list counts as fresh, until an incomplete projection is tried again, and how many writes wait.
FRESH_MS, RETRY_MS, WAITING = 1_800_000, 300_000, 1_000
KEY = ["room", "mxc"]
_NAMES = "__names"


def stored(store: Store, rows: DataFrame) -> None:
    """Put rows into the state, in place of those of the same room and mxc."""
    store.update(lambda s, v: {"state": Upsert(rows, KEY)})


def is_fresh(store: Store, now: int) -> bool:
    at = store.meta().get("checked_at")
    return at is not None and now - at < FRESH_MS


def refresh(store: Store, status: str, now: int, generation: str | None = None, names: DataFrame | None = None, posts: DataFrame | None = None) -> str:
    """Take in an answer: ``ok`` with a list, ``not-modified``, which confirms the one that is held, or anything else, which changes nothing."""
    if status == "ok" and names is not None and posts is not None:
        store.update(lambda s, v: {"names": Replace(names.select("name").distinct()), "posts": Replace(posts.select("post_id", "mxc", "md5", "flagged", "banished")), "meta": {"generation": generation, "list": v + 1, "checked_at": now}})
        return "ok"
    if status == "not-modified" and store.meta().get("list"):
        store.update(lambda s, v: {"meta": {"checked_at": now}})
        return "not-modified"
    return "unreadable"


def waits(store: Store, table: str, rows: DataFrame, now: int) -> None:
    """Add rows to ``held`` or ``parked``, in place of those with their key; beyond ``WAITING`` the oldest go."""
    key = [*KEY, "post_id"]

    def change(s: Store, version: int) -> dict:
        there, new = s.read(table, version), rows.withColumn("at", F.lit(now).cast("long"))
        if there is not None:
            new = new.unionByName(there.join(new.select(key), key, "left_anti"))
        # a top-k by time, not a sort of all rows in one task
        return {table: Replace(new.orderBy(F.desc("at"), *key).limit(WAITING))}

    store.update(change)


def _with_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The rows with all names in one column; the names of a list are one row of bounded size."""
    return rows.join(F.broadcast(names.agg(F.collect_set("name").alias(_NAMES))))


def _content(rows: DataFrame, base_tags: Column, base_sources: Column) -> DataFrame:
    names = F.col(_NAMES)
    return rows.select("room", "mxc", "post_id", snapshots.without_names(base_tags, names).alias("tags"), "rating", snapshots.without_names_in(base_sources, names).alias("sources"))


def drain_held(store: Store, projections: DataFrame, now: int, refused: DataFrame | None = None) -> int:
    """Write what was held, from what is known of the posts or else as it was, without the names, if the list is fresh.

    ``projections(post_id, p_tags, p_sources, ...)``; rooms in ``refused(room)`` take no
    write, and their rows are let go. How many rows were written.
    """
    held = store.read("held")
    if held is None or not is_fresh(store, now):
        return 0
    version = store.version()
    rows = _with_names(held.join(projections.select("post_id", "p_tags", "p_sources"), "post_id", "left"), store.read("names", version))
    known = F.coalesce(F.size("p_tags") > 0, F.lit(False))
    rows = _content(rows, F.when(known, F.col("p_tags")).otherwise(F.col("tags")), F.when(known, F.col("p_sources")).otherwise(F.col("sources")))
    return _drained(store, "held", version, rows if refused is None else rows.join(refused, "room", "left_anti"), held.where("false"))


def drain_parked(store: Store, projections: DataFrame, visible: DataFrame, now: int) -> int:
    """Write the parked rows whose post left the list, as it is seen now; drop those banished or hidden, keep the flagged.

    ``visible(post_id, legacy, rating)``; a post whose lookup failed (``projections.failed``)
    waits. How many rows were written.
    """
    parked = store.read("parked")
    if parked is None or not is_fresh(store, now):
        return 0
    version = store.version()
    rows = snapshots.drained(parked, store.read("posts", version), visible).join(projections.select("post_id", "p_tags", "p_sources", "failed"), "post_id", "left")
    action = F.when((F.col("action") == "write") & F.coalesce("failed", F.lit(False)), "keep").otherwise(F.col("action"))
    rows = rows.withColumn("action", action)
    seen = visible.select("post_id", F.col("legacy").alias("v_tags"), F.col("rating").alias("v_rating"))
    free = _with_names(rows.where("action = 'write'").join(seen, "post_id"), store.read("names", version)).withColumn("rating", F.coalesce("v_rating", "rating"))
    known = F.coalesce(F.size("p_tags") > 0, F.lit(False))
    none = F.create_map().cast("map<string,array<string>>")
    free = _content(free, F.when(known, F.col("p_tags")).otherwise(F.coalesce("v_tags", F.array().cast("array<string>"))), F.when(known, F.col("p_sources")).otherwise(none))
    return _drained(store, "parked", version, free, rows.where("action = 'keep'").select(parked.columns))


def _drained(store: Store, table: str, version: int, rows: DataFrame, rest: DataFrame) -> int:
    seen = Observation()
    # of rows for one place the one that came last counts
    rows = rows.groupBy(*KEY).agg(F.max_by(F.struct("post_id", "tags", "rating", "sources"), "post_id").alias("r")).select(*KEY, "r.*").observe(seen, F.count("*").alias("n"))
    store.commit(version, state=Upsert(rows, KEY), **{table: Replace(rest)})
    return seen.get["n"]


def owed(store: Store, now: int) -> bool:
    """Whether the list that is held has yet to be projected, and is fresh, and no retry of it is put off."""
    meta = store.meta()
    if not is_fresh(store, now) or meta.get("projected", {}).get("generation") == meta["generation"]:
        return False
    later = meta.get("deferred") or {}
    return not (later.get("generation") == meta["generation"] and now < later["until"])


def project(store: Store, projections: DataFrame, now: int) -> dict:
    """Rewrite the rows that the list's change since the last projection touches: counts of rows by what became of them.

    ``projections(post_id, p_tags, p_sources, legacy, failed)``, as ``reprojected`` has them.
    Rows that would not change are not written. The counts are taken while the rows are.
    """
    version = store.version()
    meta, state = store.meta(version), store.read("state", version)
    names, posts = store.read("names", version), store.read("posts", version).select("post_id", "mxc")
    was = meta.get("projected", {}).get("version")
    old_names, old_posts = (names.where("false"), posts.where("false")) if was is None else (store.read("names", was), store.read("posts", was).select("post_id", "mxc"))
    touched = snapshots.affected(old_posts, posts, old_names, names, known=was is not None)
    rows = snapshots.reprojected(_with_names(state, names), touched, projections, F.col(_NAMES))
    one = Window.partitionBy(*KEY).orderBy("post_id")  # a row found by its mxc and its post counts once
    rows = rows.withColumn("i", F.row_number().over(one)).where("i = 1")
    seen = Observation()
    classes = {a: F.count_if(F.col("action") == a).alias(a) for a in ("write", "current", "left")}
    rows = rows.observe(seen, *classes.values(), F.count_if(F.coalesce(F.col("source") == "failed", F.lit(False))).alias("failed"))
    changed = rows.where("action = 'write'").select(*state.columns)

    def after() -> dict:
        if seen.get["failed"]:
            return {"deferred": {"generation": meta["generation"], "until": now + RETRY_MS}}
        return {"projected": {"generation": meta["generation"], "version": meta["list"]}, "deferred": None}

    store.commit(version, after, state=Upsert(changed, KEY))
    return dict(seen.get) | {"complete": not seen.get["failed"]}


def tick(store: Store, projections: DataFrame, visible: DataFrame, now: int, status: str, **answer) -> dict:
    """One poll: take in the answer, write what was held and what is free again, project if that is owed."""
    done = {"read": refresh(store, status, now, **answer), "held": drain_held(store, projections, now), "parked": drain_parked(store, projections, visible, now), "projected": None}
    if owed(store, now):
        done["projected"] = project(store, projections, now)
    return done
