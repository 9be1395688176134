"""Queries of states: snapshots and re-projection, walks and checkpoints, the outbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as fx
from corvane.operators import outbox, snapshots, walks
from corvane.plans.registry import query

# The analogue: an order is a stored row of a room (its customer), with a post (its
# customer's number modulo 97) or none, and words of its priority and status as tags;
# post p is flagged or banished by the snapshots of customers with small or large balances.
_OLD = "(select c_custkey as post_id, 'mxc' || c_custkey as mxc from customer where c_custkey % 7 = 0)"
_NEW = "(select c_custkey as post_id, 'mxc' || c_custkey as mxc from customer where c_custkey % 7 = 0 and c_acctbal > 0 or c_custkey % 11 = 0)"


def _posts(t, where: str):
    return t("customer").where(where).select(F.col("c_custkey").alias("post_id"), F.concat(F.lit("mxc"), F.col("c_custkey").cast("string")).alias("mxc"))


def _snapshots(t):
    return _posts(t, "c_custkey % 7 = 0"), _posts(t, "c_custkey % 7 = 0 and c_acctbal > 0 or c_custkey % 11 = 0")


def _names(t, *names: str):
    return t("region").limit(1).select(F.explode(F.array(*map(F.lit, names))).alias("name"))


@query(f"""with o as {_OLD}, n as {_NEW}, d as (select post_id, count(*) k from (select post_id from o union all select post_id from n) group by 1)
select 'same names' as case_, count(*) filter (k = 1) as posts, sum(post_id) filter (k = 1) as ids from d union all select 'other names', count(*), sum(post_id) from d union all select 'unknown before', count(*), sum(post_id) from d""")
def affected_posts(t):
    """With the same names only posts that joined or left; with other or unknown ones all of both lists."""
    old, new = _snapshots(t)
    one, two = _names(t, "urgent", "p"), _names(t, "p", "urgent", "low")
    cases = {"same names": snapshots.affected(old, new, one, one), "other names": snapshots.affected(old, new, one, two), "unknown before": snapshots.affected(old, new, one, one, known=False)}
    out = [df.agg(F.count("*").alias("posts"), F.sum("post_id").alias("ids")).select(F.lit(k).alias("case_"), "posts", "ids") for k, df in cases.items()]
    return out[0].union(out[1]).union(out[2])


_STATE = """(select o_custkey % 25 as room, 'mxc' || (o_orderkey % 211) as mxc, case when o_orderkey % 3 <> 0 then o_custkey end as post_id, [lower(o_orderpriority), lower(o_orderstatus), 'low'] as tags, o_orderkey from orders)"""
_PROJ = """(select c_custkey as post_id, case when c_custkey % 2 = 0 then ['p', lower(c_mktsegment)] else [] end as p_tags, case when c_custkey % 3 = 0 then ['low', 'legacy', lower(c_mktsegment)] end as legacy, c_custkey % 13 = 5 as failed from customer where c_custkey % 5 <> 1)"""


def _state(t):
    o = t("orders")
    tags = F.array(F.lower("o_orderpriority"), F.lower("o_orderstatus"), F.lit("low"))
    own = F.create_map(F.lit("auto"), F.array(F.lower("o_orderstatus")), F.lit("creator"), F.array(F.lit("kept"), F.lit("p")))
    return o.select((F.col("o_custkey") % 25).alias("room"), F.concat(F.lit("mxc"), (F.col("o_orderkey") % 211).cast("string")).alias("mxc"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("post_id"), tags.alias("tags"), F.lit("s").alias("rating"), own.alias("sources"))


def _projections(t):
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    return t("customer").where("c_custkey % 5 <> 1").select(
        k.alias("post_id"), F.when(k % 2 == 0, F.array(F.lit("p"), F.lower("c_mktsegment"))).otherwise(none).alias("p_tags"),
        F.create_map(F.lit("auto"), F.array(F.lower("c_mktsegment")), F.lit("creator"), F.array(F.lit("p"))).alias("p_sources"),
        F.when(k % 3 == 0, F.array(F.lit("low"), F.lit("legacy"), F.lower("c_mktsegment"))).alias("legacy"), (k % 13 == 5).alias("failed"),
    )


@query(f"""with p as (select post_id, mxc from {_NEW}), s as {_STATE}, j as (select s.*, coalesce(s.post_id, m.post_id) target from s left join p m on s.mxc = m.mxc where s.post_id in (select post_id from p) or m.post_id is not null),
k as (select j.*, case when x.failed then 'failed' when len(x.p_tags) > 0 then 'projection' when x.legacy is not null then 'legacy' else 'own' end source, case when not coalesce(x.failed, false) and len(x.p_tags) > 0 then x.p_tags when not coalesce(x.failed, false) and x.legacy is not null then x.legacy else j.tags end base
from j left join {_PROJ} x on x.post_id = j.target), l as (select *, list_filter(base, lambda x: x not in ('low', 'p')) as stripped from k)
select source, count(*) n, sum(len(stripped)) tags, sum(target) posts from l group by 1""")
def reprojection(t):
    """Stored rows that a changed snapshot touches, rewritten from what is known of their posts, without the flagged names."""
    _, new = _snapshots(t)
    r = snapshots.reprojected(_state(t), new, _projections(t), F.array(F.lit("low"), F.lit("p")))
    return r.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.size("tags")).alias("tags"), F.sum("post_id").alias("posts"))


@query(f"""with p as (select post_id, mxc from {_NEW}), s as {_STATE}, j as (select s.*, coalesce(s.post_id, m.post_id) target from s left join p m on s.mxc = m.mxc where s.post_id in (select post_id from p) or m.post_id is not null)
select case when x.failed then case when tags[2] = 'f' then 'write' else 'left' end when s2.known then 'write' when j.post_id is null then 'write' when tags[2] = 'f' then 'write' else 'current' end as action, count(*) n
from j left join {_PROJ} x on x.post_id = j.target left join (select post_id as pid, len(p_tags) > 0 or legacy is not null as known from {_PROJ}) s2 on s2.pid = j.target group by 1""")
def reprojection_writes(t):
    """The same with the name f flagged: rows that would not change are not written, failed lookups leave clean rows."""
    _, new = _snapshots(t)
    return snapshots.reprojected(_state(t), new, _projections(t), F.array(F.lit("f"))).groupBy("action").agg(F.count("*").alias("n"))


@query("""with parked as (select o_orderkey, o_custkey as post_id, md5(cast(o_custkey as varchar)) md5 from orders where o_orderkey % 10 = 3), listed as (select md5(cast(c_custkey as varchar)) md5, c_acctbal < 2000 flagged, c_acctbal > 8000 banished from customer)
select case when flagged then 'keep' when banished then 'drop banished' when post_id not in (select c_custkey from customer where c_mktsegment <> 'BUILDING') then 'drop hidden' else 'write' end action, count(*) n from parked join listed using (md5) group by 1""")
def parked_drain(t):
    c = t("customer")
    parked = t("orders").where("o_orderkey % 10 = 3").select("o_orderkey", F.col("o_custkey").alias("post_id"), F.md5(F.col("o_custkey").cast("string").cast("binary")).alias("md5"))
    listed = c.select(F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("md5"), (F.col("c_acctbal") < 2000).alias("flagged"), (F.col("c_acctbal") > 8000).alias("banished"))
    visible = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("post_id"))
    return snapshots.drained(parked, listed, visible).groupBy("action").agg(F.count("*").alias("n"))


@query("""with p as (select user_id, epoch_us(ts) // 1000 as ms, event_id, case when event_type = 'click' then 200 when event_type = 'view' then 304 else 503 end status, event_id as generation from events),
h as (select *, last_value(case when status = 200 then generation end ignore nulls) over w holds, max(case when status = 200 then ms end) over w first200 from p window w as (partition by user_id order by ms, event_id rows unbounded preceding)),
k as (select *, max(case when status in (200, 304) and holds is not null then ms end) over (partition by user_id order by ms, event_id rows unbounded preceding) checked from h)
select event_id, holds, coalesce(ms - checked < 1800000, false) as fresh from k""")
def polled_snapshot(t):
    """What a polled list holds after each answer: 304 confirms, an error keeps, half an hour is the grace."""
    e = t("events")
    status = F.when(F.col("event_type") == "click", 200).when(F.col("event_type") == "view", 304).otherwise(503)
    p = e.select("user_id", fx.epoch_ms(F.col("ts")).alias("at"), "event_id", status.alias("status"), F.col("event_id").alias("generation"))
    return snapshots.polled(p, "user_id", ["at", "event_id"], F.floor(F.col("at") / 86_400_000)).select("event_id", "holds", "fresh")


_SAVED = """(select c_custkey k, case c_custkey % 4 when 0 then 'command' when 1 then 'rejoin' when 2 then 'sweep' else 'join' end "trigger", c_custkey % 17 = 0 restart, case when c_custkey % 5 <> 0 then c_custkey * 10 end head, case when c_custkey % 3 = 0 then c_custkey end as cursor, c_custkey % 2 = 0 reached, c_custkey % 7 attempts from customer)"""
_PLAN = """case when restart or not (coalesce(reached, false) or cursor is not null or head is not null) then 'initial' when "trigger" = 'command' then case when reached then 'initial' else 'resume' end
when "trigger" = 'rejoin' and head is not null then 'gap' when not reached then 'resume' when attempts < 5 then 'retry' else 'skip' end"""


def _saved(t):
    k = F.col("c_custkey")
    trigger = F.when(k % 4 == 0, "command").when(k % 4 == 1, "rejoin").when(k % 4 == 2, "sweep").otherwise("join")
    failed = F.array(F.struct(k.alias("event_id"), F.lit("u").alias("url"), (k % 7).alias("attempts")))
    s = t("customer").select(k.alias("k"), trigger.alias("trigger"), (k % 17 == 0).alias("restart"), F.when(k % 5 != 0, k * 10).alias("head"), F.when(k % 3 == 0, k).alias("cursor"), (k % 2 == 0).alias("reached_start"), failed.alias("failed"))
    return s.withColumn("plan", walks.plan(F.col("trigger"), F.col("restart"), F.col("head"), F.col("cursor"), F.col("reached_start"), F.col("failed")))


@query(f"""select "trigger", {_PLAN} as plan, count(*) n from {_SAVED} group by 1, 2""")
def walk_plan(t):
    """What to do next in each partition, from its checkpoint and what asks for it."""
    return _saved(t).groupBy("trigger", "plan").agg(F.count("*").alias("n"))


@query(f"""with s as (select *, {_PLAN} as plan, k % 3 as pages, k * 10 + 5 as r_head, case when k % 6 < 3 then k + 1 end as r_cursor, k % 6 < 4 as r_reached from {_SAVED}),
n as (select k, plan, case when plan = 'initial' and pages > 0 then r_head when plan = 'gap' and r_reached then r_head else head end head, case when pages > 0 and plan in ('initial', 'resume') then r_cursor else cursor end as cursor,
coalesce(case when pages > 0 and plan in ('initial', 'resume') then r_reached else reached end, false) reached_start, case when attempts + 1 >= 5 then 0 else 1 end + 1 as failed, case when attempts + 1 >= 5 then 1 else 0 end as abandoned from s)
select * from n""")
def walk_checkpoints(t):
    """The checkpoint after a run: it only goes forward, and failures out of attempts are put away."""
    k = F.col("k")
    failures = F.array(
        F.struct(k.alias("event_id"), F.lit("u").alias("url"), (k % 7).alias("attempts")), F.struct(k.alias("event_id"), F.lit("u").alias("url"), (k % 7 + 1).alias("attempts")),
        F.struct(F.lit(None).cast("long").alias("event_id"), F.lit("v").alias("url"), F.lit(9).cast("long").alias("attempts")),
    )
    run = _saved(t).drop("failed").select("*", failures.alias("failures"), (k % 3).alias("pages"), (k * 10 + 5).alias("r_head"), F.when(k % 6 < 3, k + 1).alias("r_cursor"), (k % 6 < 4).alias("r_reached_start"), F.lit(None).cast("array<struct<event_id:bigint,url:string,attempts:bigint>>").alias("abandoned"))
    return walks.next_state(run).select("k", "plan", "head", "cursor", "reached_start", F.size("failed").alias("failed"), F.size("abandoned").alias("abandoned"))


@query("""with m as (select user_id, event_id, event_type = 'error' and value < 20 transient, event_type = 'signup' and value > 95 withheld from events), s as (select user_id, min(event_id) filter (transient or withheld) stop from m group by 1)
select m.user_id, max(event_id) filter (stop is null or event_id < stop) watermark, count(*) filter (stop is null or event_id < stop) messages, max(case when event_id = stop then case when withheld then 'withheld' else 'transient' end end) stopped from m join s using (user_id) group by 1""")
def acquire_watermarks(t):
    """How far each partition got before the first message that failed for now or was withheld."""
    transient = (F.col("event_type") == "error") & (F.col("value") < 20)
    return walks.watermarks(t("events"), "user_id", "event_id", transient, (F.col("event_type") == "signup") & (F.col("value") > 95))


@query("""with n as (select user_id k, count(*) delivered, bool_and(event_type <> 'error' or value >= 5) ok from events where event_type <> 'view' and user_id % 3 <> 0 group by 1), b as (select user_id k, count(*) delivered, true ok from events where event_type = 'view' group by 1)
select k, delivered, ok, 'this' from_pass from n union all select k, delivered, ok, 'previous' from b where k not in (select k from n)""")
def carried_status(t):
    """Status of this pass, and of the one before for partitions that this one has not reached."""
    e = t("events").withColumnRenamed("user_id", "k")
    now = e.where("event_type <> 'view' and k % 3 <> 0").groupBy("k").agg(F.count("*").alias("delivered"), F.bool_and((F.col("event_type") != "error") | (F.col("value") >= 5)).alias("ok"))
    before = e.where("event_type = 'view'").groupBy("k").agg(F.count("*").alias("delivered"), F.lit(True).alias("ok"))
    return walks.carried_over(now, before, "k")


@query("""select c_custkey k, c_custkey % 2 = 0 reached_start from customer where not (c_custkey % 9 * 100000 < 300000) and (c_custkey % 2 <> 0 or c_custkey % 7 < 5)""")
def sweep_partitions(t):
    """Partitions that need a walk, without those walked in the last five minutes."""
    now = F.lit(10_000_000).cast("long")
    rows = _saved(t).withColumn("last_run_at", now - F.col("k") % 9 * 100_000)
    return walks.needing_work(rows, now).select("k", "reached_start")


@query("""with w as (select user_id, max(event_id) filter (ts < timestamp '2024-01-20') head from events group by 1) select user_id, count(*) late, count(*) filter (event_type = 'error') dropped from events join w using (user_id) where head is null or event_id > head group by 1""")
def late_events(t):
    """Events after the head that a walk left; those that are gone by now are dropped."""
    e = t("events")
    walked = e.groupBy("user_id").agg(F.max(F.when(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"), F.col("event_id"))).alias("head"))
    gone = e.where("event_type = 'error'").select("event_id")
    return walks.late_events(walked, e, gone, "user_id", "event_id").groupBy("user_id").agg(F.count("*").alias("late"), F.count_if("dropped").alias("dropped"))


@query("""select user_id, d || ' done' || case when r > 0 then ', ' || r || ' refused' else '' end || case when f > 0 then ', ' || f || ' failed' else '' end as said from (select user_id, count(*) filter (event_type = 'purchase') d, count(*) filter (event_type = 'signup' and value > 90) r, count(*) filter (event_type = 'error') f from events group by 1)""")
def walk_summaries(t):
    """One line for each partition, with the counts that are not zero."""
    kind = F.col("event_type")
    s = t("events").groupBy("user_id").agg(F.count_if(kind == "purchase").alias("d"), F.count_if((kind == "signup") & (F.col("value") > 90)).alias("r"), F.count_if(kind == "error").alias("f"))
    return s.select("user_id", walks.summary(F.col("d"), refused=F.col("r"), failed=F.col("f")).alias("said"))


_ANSWER = """case when event_id % 6 = 0 then 'accepted' when event_id % 6 = 1 then case when event_id % 4 = 1 then 'no_such_post' else 'unreadable' end when value < 10 then '404' when value < 20 then '403' when value < 60 then 'retry' else 'unreadable' end"""


def _answers(t):
    i, v = F.col("event_id"), F.col("value")
    accepted = F.when(i % 6 == 0, True).when(i % 6 == 1, False)
    status = F.when(v < 10, 404).when(v < 15, 401).when(v < 20, 403).when(v < 40, 503).when(v < 60, None).otherwise(418)
    return t("events").select("event_id", "user_id", "event_type", fx.epoch_ms(F.col("ts")).alias("at"), outbox.answer_class(accepted, F.when(i % 4 == 1, "no_such_post").otherwise("odd"), status).alias("cls"))


@query(f"select cls, count(*) n, min((event_id, 'post ' || event_id || ' ' || event_type))[2] as first from (select *, {_ANSWER} cls from events) group by 1")
def answer_classes(t):
    """Answers by class, each with its first example."""
    example = F.concat_ws(" ", F.lit("post"), F.col("event_id").cast("string"), "event_type")
    return _answers(t).groupBy("cls").agg(F.count("*").alias("n"), F.min(F.struct("event_id", example.alias("x")))["x"].alias("first"))


@query(f"select case when event_id % 5 = 0 then case event_id % 4 when 0 then 'kept' when 1 then 'raw-md5-conflict' when 2 then 'raw-md5-mismatch' else 'failed' end else 'failed' end state, count(*) n from events group by 1")
def conflict_classes(t):
    reason = F.element_at(F.array(*map(F.lit, ("poster_mismatch", "raw_md5_conflict", "raw_md5_mismatch", "else"))), (F.col("event_id") % 4 + 1).cast("int"))
    state = outbox.conflict_class(F.when(F.col("event_id") % 5 == 0, 409).otherwise(500), reason)
    return t("events").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""with held as (select distinct user_id as post_id, event_type as mxc from events where event_type in ('click', 'view')), new as (select distinct user_id as post_id, event_type as mxc from events where event_type <> 'view'), f as (select post_id, mxc, row_number() over (order by post_id, mxc) i from new anti join held using (post_id, mxc))
select 'held' state, count(*) n from held union all select case when i <= greatest(0, (select 40 - count(*) from held)) then 'queued' else 'refused' end, count(*) from f group by 1""")
def outbox_adds(t):
    """Reports that come in: held ones change nothing, past the cap (40) they are refused."""
    e = t("events").select(F.col("user_id").alias("post_id"), F.col("event_type").alias("mxc")).distinct()
    none = F.lit(0).cast("long")
    held = e.where("mxc in ('click', 'view')").select("post_id", "mxc", none.alias("queued_at"), none.alias("attempts"), F.lit(None).cast("string").alias("last_class"), none.alias("next_try_at"))
    return outbox.added(held, e.where("mxc <> 'view'"), ["post_id", "mxc"], F.lit(1).cast("long"), cap=40).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""select attempts, last_class, count(*) n, sum(next_try_at) next from (select event_id % 3 + 1 as attempts, cls last_class, 1000 + cast(least(600000 * pow(2, greatest(0, event_id % 3)), 7200000) as bigint) next_try_at from (select *, {_ANSWER} cls from events) where event_id % 2 = 0 and cls not in ('accepted', 'no_such_post')
union all select event_id % 3, null, 0 from events where event_id % 2 = 1) group by 1, 2""")
def outbox_settles(t):
    """The outbox after answers to every second entry: settled ones go, the others wait twice as long."""
    a = _answers(t)
    box = a.select("event_id", (F.col("event_id") % 3).alias("attempts"), F.lit(None).cast("string").alias("last_class"), F.lit(0).cast("long").alias("next_try_at"))
    s = outbox.settled(box, a.where("event_id % 2 = 0"), ["event_id"], F.lit(1000))
    return s.groupBy("attempts", "last_class").agg(F.count("*").alias("n"), F.sum("next_try_at").alias("next"))


@query(f"""with d as (select event_id, cls, row_number() over (order by ms, event_id) i from (select event_id, epoch_us(ts) // 1000 as ms, {_ANSWER} cls from events where event_id % 7 <> 2) qualify i <= 200), g as (select *, count(*) filter (cls <> 'retry') over (order by i) g from d),
s as (select *, case when cls = 'retry' then row_number() over (partition by g, cls = 'retry' order by i) else 0 end silent from g) select event_id, i, cls from s where i <= coalesce((select min(i) from s where silent >= 3), 1000)""")
def outbox_sweep(t):
    """One pass over the due entries: 200 at most, up to the third unanswered one in a row."""
    a = _answers(t).withColumn("next_try_at", F.when(F.col("event_id") % 7 == 2, F.lit(10**15)).otherwise(F.col("at")))
    return outbox.sweep(a, F.lit(10**14), ["at", "event_id"], breaker=3).select("event_id", "i", "cls")
