"""Queries over state that outlives a run: acquisition in micro-batches, views kept up to date, outboxes, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import scans
from corvane.plans.registry import query
from corvane.plans.states import _projections
from corvane.sources.commits import Store, recorded, shared_folder
from corvane.streaming import acquire, outboxes, redactions, views

# users as partitions, events as messages with up to three parts each
_MESSAGES = """(select *, event_type = 'view' and event_id % 7 = 0 own, event_type = 'signup' and value > 95 withheld, event_type = 'error' and value < 20 and event_id % 4 > 1 fails from events)"""
_MARKS = "(select distinct user_id, user_id * 5 as was from events where user_id % 2 = 0)"
_STEPS = f"""m as (select e.* from {_MESSAGES} e left join {_MARKS} k using (user_id) where was is null or event_id > was),
s as (select user_id, min(event_id) as halt from m where withheld or (fails and not own) group by 1)"""


def _messages(t) -> DataFrame:
    return t("events").select("user_id", "event_id", "event_type", "value")


def _deliver(messages: DataFrame, _: int) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    fails = (kind == "error") & (F.col("value") < 20) & (i % 4 > 1)
    status = lambda j: F.when(fails & (j == 1), acquire.TRANSIENT).when((i + j) % 11 == 0, "refused").when((i + j) % 5 == 0, "held").otherwise("posted")
    part = lambda j: F.struct((i * 10 + j).alias("part"), status(j).alias("status"), F.when((i + j) % 11 == 0, "too large").alias("why"))
    parts = F.transform(F.sequence(F.lit(0), (i % 4).cast("int")), lambda j: part(j.cast("long")))
    return messages.withColumns({"own": (kind == "view") & (i % 7 == 0), "withheld": (kind == "signup") & (F.col("value") > 95), "parts": F.slice(parts, F.lit(1), (i % 4).cast("int"))})


def _marks(t) -> DataFrame:
    return t("events").where("user_id % 2 = 0").select("user_id", (F.col("user_id") * 5).alias("after")).distinct()


@query(f"""with {_STEPS}, p as (select user_id, event_id, j, case when fails and j = 1 then 'transient' when (event_id + j) % 11 = 0 then 'refused' when (event_id + j) % 5 = 0 then 'held' else 'posted' end status
from (select m.*, halt, unnest(range(event_id % 4)) j from m left join s using (user_id) where not own and (halt is null or event_id < halt or (event_id = halt and not withheld))) where halt is null or event_id < halt or j < 1)
select user_id, event_id, event_id * 10 + j as part, status, case when (event_id + j) % 11 = 0 then 'too large' end why from p""")
def acquired_parts(t):
    """One outcome for every part up to where its partition stops."""
    stepped = acquire.steps(_deliver(_messages(t), 0), _marks(t), "user_id", "event_id")
    return acquire.outcomes(stepped, "user_id", "event_id")


@query(f"""with {_STEPS} select user_id, coalesce(max(event_id) filter (halt is null or event_id < halt), any_value(was)) as after, any_value(halt is not null) stopped from m left join s using (user_id) left join {_MARKS} k using (user_id) group by 1""")
def acquired_marks(t):
    """Watermarks after four micro-batches, one of them replayed: those of one pass over all messages."""
    messages = _messages(t)
    spark = messages.sparkSession
    store = Store(spark, shared_folder(spark))
    last = messages.agg(F.max("event_id")).first()[0] or 0
    marks = _marks(t).select("user_id", "after", F.lit(0).cast("long").alias("messages"), F.lit(None).cast("string").alias("stopped"))
    store.commit(0, marks=acquire.Upsert(marks, ["user_id"], 16))
    for number in (0, 1, 1, 2, 3):
        part = messages.where((F.col("event_id") * 4 > number * last) & (F.col("event_id") * 4 <= (number + 1) * last) | F.lit(number == 0) & (F.col("event_id") == 0))
        acquire.acquire(store, part, number, _deliver, "user_id", "event_id")
    seen = messages.join(_marks(t).withColumnRenamed("after", "was"), "user_id", "left").where("was is null or event_id > was").select("user_id").distinct()
    return store.read("marks").join(seen, "user_id", "left_semi").select("user_id", "after", F.col("stopped").isNotNull().alias("stopped"))


# customers as posts, orders as stored rows; two lists follow each other, the second one with other names
_LISTS = ("c_custkey % 7 = 0", "c_custkey % 7 = 0 and c_acctbal > 0 or c_custkey % 11 = 0")


def _list(t, i: int) -> DataFrame:
    k = F.col("c_custkey")
    return t("customer").where(_LISTS[i]).select(k.alias("post_id"), F.concat(F.lit("mxc"), k.cast("string")).alias("mxc"), F.md5(k.cast("string").cast("binary")).alias("md5"), (k % 2 == 0).alias("flagged"), F.lit(False).alias("banished"))


def _rows(t) -> DataFrame:
    o = t("orders")
    sources = F.create_map(F.lit("auto"), F.array(F.lower("o_orderstatus")), F.lit("creator"), F.array(F.lit("kept"), F.lit("p")))
    return o.select((F.col("o_custkey") % 25).alias("room"), F.concat(F.lit("mxc"), F.col("o_orderkey").cast("string")).alias("mxc"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("post_id"), F.array(F.lower("o_orderpriority"), F.lower("o_orderstatus"), F.lit("low")).alias("tags"), F.lit("s").alias("rating"), sources.alias("sources"))


_PROJECTED = """(select c_custkey as post_id, case when c_custkey % 2 = 0 then ['p', lower(c_mktsegment)] else [] end as p_tags, case when c_custkey % 3 = 0 then ['low', 'legacy', lower(c_mktsegment)] end as legacy from customer where c_custkey % 5 <> 1)"""
_ROWS = """(select o_custkey % 25 as room, 'mxc' || o_orderkey as mxc, case when o_orderkey % 3 <> 0 then o_custkey end as post_id, [lower(o_orderpriority), lower(o_orderstatus), 'low'] as tags from orders)"""


@query(f"""with p as (select c_custkey as id, 'mxc' || c_custkey as pm, {_LISTS[1]} as now from customer where ({_LISTS[0]}) or ({_LISTS[1]})),
j as (select s.room, s.mxc, coalesce(s.post_id, m.id) as target, s.post_id, s.tags, h.id is not null or m.id is not null as hit from {_ROWS} s left join p m on m.pm = s.mxc left join p h on h.id = s.post_id),
k as (select j.*, case when len(x.p_tags) > 0 then x.p_tags when x.legacy is not null then x.legacy else j.tags end as base from j left join {_PROJECTED} x on x.post_id = j.target),
l as (select room, mxc, case when hit then target else post_id end as post_id, case when hit then list_filter(base, lambda x: x not in ('p', 'low')) else tags end as tags from k)
select room, count(*) as n, sum(post_id) as posts, sum(len(tags)) as n_tags, sum(strlen(list_aggregate(tags, 'string_agg', ','))) as chars from l group by 1""")
def maintained_view(t):
    """Stored rows after two lists, one after the other: those of one projection of all posts that either names."""
    rows = _rows(t)
    spark = rows.sparkSession
    known = _projections(t).withColumn("failed", F.lit(False))
    visible = t("customer").select(F.col("c_custkey").alias("post_id"), F.array().cast("array<string>").alias("legacy"), F.lit("s").alias("rating"))
    store = Store(spark, shared_folder(spark))
    views.stored(store, rows)
    for i, names in enumerate((["urgent"], ["p", "low"])):
        own = t("region").limit(1).select(F.explode(F.array(*map(F.lit, names))).alias("name"))
        views.tick(store, known, visible, i, "ok", generation=str(i), names=own, posts=_list(t, i))
    return store.read("state").groupBy("room").agg(F.count("*").alias("n"), F.sum("post_id").alias("posts"), F.sum(F.size("tags")).alias("n_tags"), F.sum(F.octet_length(F.array_join("tags", ","))).alias("chars"))


_ASKED = """case (post_id + strlen(mxc)) % 4 when 0 then 'accepted' when 1 then 'no_such_post' when 2 then '404' else 'retry' end"""


@query(f"""with half as (select max(event_id) // 2 as h from events), a as (select distinct user_id as post_id, event_type as mxc from events, half where event_id <= h and user_id > 0 order by 1, 2 limit 60),
b as (select post_id, mxc, {_ASKED} as cls from a qualify true), c as (select * from b where cls in ('404', 'retry')),
d as (select distinct user_id as post_id, event_type as mxc from events, half where event_id > h and user_id > 0), e as (select * from d anti join c using (post_id, mxc) order by 1, 2 limit (select 60 - count(*) from c)),
f as (select post_id, mxc, {_ASKED} as cls from e)
select post_id, mxc, 0 as queued_at, 1 as attempts, cls as last_class, 600001 as next_try_at from c union all select post_id, mxc, 2, 1, cls, 600003 from f where cls in ('404', 'retry')""".replace(" qualify true", ""))
def outbox_passes(t):
    """What an outbox of 60 holds after two rounds of reports, each with a pass over what is due."""
    e = t("events").select("event_id", F.col("user_id").alias("post_id"), F.col("event_type").alias("mxc"))
    store = Store(e.sparkSession, shared_folder(e.sparkSession))
    half = (e.agg(F.max("event_id")).first()[0] or 0) // 2
    cls = F.element_at(F.array(*map(F.lit, ("accepted", "no_such_post", "404", "retry"))), ((F.col("post_id") + F.octet_length("mxc")) % 4 + 1).cast("int"))
    ask = lambda due: due.withColumns({"cls": cls, "took": F.lit(1)})
    for now, part in ((0, e.where(F.col("event_id") <= half)), (2, e.where(F.col("event_id") > half))):
        outboxes.report(store, part, now, cap=60)
        outboxes.flush(store, ask, now + 1, breaker=1_000)
    return store.read("outbox")


@query("""select o_custkey % 50 as room, count(*) as n, max(o_orderkey) as last from orders where o_custkey % 50 not in (select c_custkey % 50 from customer where c_custkey % 9 = 4 and c_custkey < 200) group by 1""")
def pruned_layout(t):
    """State by room, with the folders of denied rooms left out of the scan."""
    o = t("orders").select((F.col("o_custkey") % 50).alias("room"), "o_orderkey")
    path = f"{shared_folder(o.sparkSession)}/by-room"
    scans.layout(o, path, "room")
    denied = t("customer").where("c_custkey % 9 = 4 and c_custkey < 200").select((F.col("c_custkey") % 50).alias("room"))
    return scans.undenied(o.sparkSession.read.schema(o.schema).parquet(path), "room", denied).groupBy("room").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


# events as messages; a purchase takes back the message whose id is seven less; each fourth hour's events land after all others
_LATE = "hour(ts) % 4 = 3"


@query("""with m as (select event_id, user_id, ts from events where event_type <> 'purchase'), r as (select event_id - 7 as event_id, ts from events where event_type = 'purchase'),
g as (select distinct m.event_id from m join r using (event_id))
select event_id, user_id from m anti join g using (event_id)""")
def unredacted_messages(t):
    """Messages that nobody took back: what the stream lets through, what the walk after it finds, and what was still waiting."""
    e = t("events").select("event_id", "user_id", "event_type", "ts")
    spark = e.sparkSession
    top = shared_folder(spark)
    rows = e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("taken", F.when(F.col("event_type") == "purchase", F.col("event_id") - 7))
    until = None
    for late in (False, True):
        rows.where(f"({_LATE}) = {late}").write.mode("append").parquet(f"{top}/landed")
        through = redactions.kept(*_sides(spark.readStream.schema(rows.schema).parquet(f"{top}/landed")), "event_id", "ts", "3 days")
        query = through.writeStream.format("parquet").option("path", f"{top}/through").option("checkpointLocation", f"{top}/offsets").trigger(availableNow=True).start()
        query.awaitTermination()
        until = redactions.settled_until(query) or until
    landed, gone = _sides(spark.read.schema(rows.schema).parquet(f"{top}/landed"))
    sent = spark.read.schema(through.schema).parquet(f"{top}/through")
    found = redactions.missed(landed, sent, gone, "event_id", "ts", "3 days", until)
    waiting = landed.join(redactions.settled(landed, "ts", "3 days", until).select("event_id"), "event_id", "left_anti")
    waiting = waiting.join(sent.select("event_id"), "event_id", "left_anti").join(gone.select("event_id"), "event_id", "left_anti")
    later = gone.select("event_id").distinct()  # taken back after the stream's three days
    return sent.join(later, "event_id", "left_anti").unionByName(found).unionByName(waiting).select("event_id", "user_id")


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("taken is null").select("event_id", "user_id", "ts"), rows.where("taken is not null").select(F.col("taken").alias("event_id"), "ts")


@query("""select doc_id as post_id, lang || ' ' || source as tags from documents where doc_id % 3 = 0 and doc_id % 2 = 1 union all select doc_id, 'again ' || source from documents where doc_id % 6 = 0""")
def recorded_projection(t):
    """Partitions put into a table by their post, a later one in place of an earlier, and the public part of those that were written last."""
    d, post = t("documents"), F.col("doc_id").alias("post_id")
    store = Store(d.sparkSession, shared_folder(d.sparkSession))
    private = F.concat_ws(" ", "source", "lang").alias("creator")
    recorded(store, "partitions", d.where("doc_id % 2 = 0").select(post, F.concat_ws(" ", "lang", "lang").alias("tags"), private), ["post_id"], ["creator"], 16)
    tags = F.concat_ws(" ", F.when(F.col("doc_id") % 2 == 0, "again").otherwise(F.col("lang")), "source").alias("tags")
    return recorded(store, "partitions", d.where("doc_id % 3 = 0").select(post, tags, private), ["post_id"], ["creator"], 16)
