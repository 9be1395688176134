"""Every query of the library by name, with SQL that returns the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as fx
from corvane.operators import joins, permissions, rollup, sets, strikes
from corvane.plans.registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]


def _k(column: str = "props"):
    return F.coalesce(F.get_json_object(column, "$.k").cast("long"), F.lit(0).cast("long"))


K = "coalesce(cast(json_extract_string(props, '$.k') as bigint), 0)"


@query("""with o as (select o_custkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) r from orders)
select c_mktsegment, count(*) planned, count(*) filter (o_orderstatus = 'F') done, count(*) filter (o_orderstatus is null) untouched,
round(count(*) filter (o_orderstatus = 'F') / count(*), 6) ratio from customer left join (select * from o where r = 1) on c_custkey = o_custkey group by 1""")
def completion_ratio(t):
    """Plan rows against the latest outcome of each."""
    last = rollup.latest(t("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return rollup.completion(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), last, "o_custkey", "c_mktsegment", F.col("o_orderstatus") == "F")


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1")
def latest_wins(t):
    return rollup.latest(t("events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""select event_id, user_id, used, greatest(0, 20 - used) remaining from
(select event_id, user_id, count(*) over (partition by user_id order by epoch_us(ts) // 1000 range between 86399999 preceding and current row) used from events)""")
def rolling_budget(t):
    e = t("events").select("event_id", "user_id", fx.epoch_ms(F.col("ts")).alias("at"))
    return rollup.trailing(e, "user_id", "at", 86_400_000, 20).drop("at")


OUTBOX = f"(select event_id, epoch_us(ts) // 1000 queued_at, {K} % 7 attempts, case when {K} % 7 = 0 then null else epoch_us(ts) // 1000 + cast(least(600000 * pow(2, greatest(0, {K} % 7 - 1)), 7200000) as bigint) end next_try_at, event_type as cls, (select max(epoch_us(ts) // 1000) from events) as now from events)"


def _outbox(t) -> DataFrame:
    e = t("events").select("event_id", fx.epoch_ms(F.col("ts")).alias("queued_at"), (_k() % 7).alias("attempts"), F.col("event_type").alias("cls"))
    now = e.agg(F.max("queued_at").alias("now"))
    return e.withColumn("next_try_at", F.when(F.col("attempts") > 0, F.col("queued_at") + fx.backoff_ms(F.col("attempts")))).join(F.broadcast(now))  # one row


@query(f"select event_id, attempts, next_try_at from {OUTBOX} where next_try_at is null or next_try_at <= now order by next_try_at nulls first, queued_at, event_id limit 200")
def due_queue(t):
    return rollup.due(_outbox(t), "next_try_at", F.col("now"), ["next_try_at", "queued_at", "event_id"], 200).select("event_id", "attempts", "next_try_at")


@query("""with p as (select min(doc_id) post, md5(text) raw, md5(lower(text)) folded from documents where lang = 'en' group by text),
d as (select doc_id, md5(text) raw, md5(lower(text)) folded from documents),
f as (select folded, min(post) post from p group by 1), r as (select raw, min(post) post from p group by 1)
select doc_id, coalesce(f.post, r.post) post, case when f.post is not null then 'folded' when r.post is not null then 'raw' end via
from d left join f using (folded) left join r using (raw)""")
def fallback_dedup(t):
    """Each text by its folded digest, else by the digest of its bytes."""
    d = t("documents").select("doc_id", "lang", F.md5("text").alias("raw"), F.md5(F.lower("text")).alias("folded"))
    posts = d.where("lang = 'en'")
    by = [(k, k, posts.groupBy(k).agg(F.min("doc_id").alias("post"))) for k in ("folded", "raw")]
    return joins.first_match(d, by, "post").select("doc_id", "post", "via")


@query("""select l_returnflag, count(*) n, sum(l_linenumber) lines from (select distinct l_orderkey, l_linenumber, l_returnflag from lineitem
where l_partkey in (select p_partkey from part where p_size >= 48) or l_suppkey in (select s_suppkey from supplier where s_acctbal < 0)) group by 1""")
def disjunctive_match(t):
    parts = t("part").where("p_size >= 48").select(F.col("p_partkey").alias("l_partkey"))
    suppliers = t("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    found = joins.by_either(t("lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"], ("l_partkey", parts), ("l_suppkey", suppliers))
    return found.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query("""with m as (select c_custkey, min(c_custkey) over (partition by c_nationkey) owner from customer where c_mktsegment = 'BUILDING')
select coalesce(owner, o_custkey) owner, count(*) n from orders left join m on o_custkey = c_custkey group by 1""")
def merge_masters(t):
    c = t("customer").where("c_mktsegment = 'BUILDING'")
    m = c.join(c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("master")), "c_nationkey").select("c_custkey", "master")
    return joins.by_alias(t("orders"), m, "o_custkey", "c_custkey", "master").groupBy("owner").agg(F.count("*").alias("n"))


PAIRS = "(select s_suppkey old, s_suppkey + 1 new from supplier where s_acctbal < 1000)"


def _supplier_pairs(t) -> DataFrame:
    return t("supplier").where("s_acctbal < 1000").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 1).alias("new"))


@query(f"select new, case when s_suppkey is null then 'missing' else 'moved' end status, count(*) n from lineitem join {PAIRS} on l_suppkey = old left join supplier on s_suppkey = new group by 1, 2")
def repoint_pairs(t):
    alive = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    return joins.moved(t("lineitem"), _supplier_pairs(t), "l_suppkey", "old", "new", alive).groupBy("new", "status").agg(F.count("*").alias("n"))


@query("select o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0) group by 1")
def unseen_targets(t):
    return t("orders").select("o_custkey").distinct().join(t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")


@query("""with recursive e as (select user_id, epoch_us(ts) // 1000 // 600 as t, row_number() over (partition by user_id order by epoch_us(ts) // 1000 // 600, event_id) i, event_type from events where event_type in ('error', 'signup')),
f(n, a, b) as (select 0, 0::bigint, 1::bigint union all select n + 1, b, a + b from f where n < 80),
s(user_id, i, strikes, until, ignored) as (select user_id, 0::bigint, 0::bigint, 0::bigint, 0::bigint from e group by 1
union all select s.user_id, s.i + 1, case when event_type = 'error' and t >= until then strikes + 1 else strikes end, case when event_type = 'signup' then 0 when t < until then until else t + (select a from f where n = strikes + 1) * 60000 end,
case when event_type = 'error' and t < until then ignored + 1 else ignored end from s join e on e.user_id = s.user_id and e.i = s.i + 1)
select user_id, max_by(strikes, i) strikes, max_by(until, i) until, max_by(ignored, i) ignored from s group by 1""")
def strike_cooldown(t):
    """Errors as rejections, signups as acceptances; time runs 600 times as fast, so that cooldowns are met."""
    e = t("events").where(F.col("event_type").isin("error", "signup"))
    kind = F.when(F.col("event_type") == "signup", "accept").otherwise("reject")
    return strikes.ledger(e.select("user_id", F.floor(fx.epoch_ms(F.col("ts")) / 600).alias("at"), F.col("event_id").alias("seq"), kind.alias("kind")), "user_id")


@query("""with m as (select *, count(*) filter (event_type <> 'error') over (partition by user_id order by ts, event_id rows unbounded preceding) g from events)
select user_id, count(*) length, min((ts, event_id))[2] first_event_id from m where event_type = 'error' group by user_id, g""")
def failure_streaks(t):
    return rollup.runs(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.to_date("ts")).drop("first_ts")


@query("""select coalesce(previous, 'none') previous, event_type, count(*) n from (select event_type, lag(event_type) over (partition by user_id order by ts, event_id) previous from events) group by 1, 2""")
def transitions(t):
    e = rollup.with_previous(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type", F.to_date("ts"))
    return e.groupBy(F.coalesce("previous", F.lit("none")).alias("previous"), "event_type").agg(F.count("*").alias("n"))


@query("""with a as (select c_custkey k, c_nationkey a, c_mktsegment b from customer), n as (select o_custkey k, max((o_orderkey, o_orderpriority))[2] p from orders group by 1)
select case when a.k is null then 'insert' when a.b = case when p like '1%' then 'BUILDING' else a.b end then 'same' else 'update' end action, count(*) c from n left join a using (k) group by 1""")
def upsert_no_op(t):
    """Writes that would change nothing are told apart."""
    stored = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("b"))
    last = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max(F.struct("o_orderkey", "o_orderpriority"))["o_orderpriority"].alias("p"))
    new = last.join(stored, "k", "left").select("k", F.when(F.col("p").startswith("1"), "BUILDING").otherwise(F.col("b")).alias("b"))
    return joins.upsert_changes(stored, new, "k", ["b"]).groupBy("action").agg(F.count("*").alias("c"))


@query("select doc_id, substr(regexp_replace(source || '-' || lang || '-' || doc_id || '-' || substr(text, 1, 60), '[^A-Za-z0-9_-]', '_', 'g'), 1, 64) entry from documents")
def entry_ids(t):
    return t("documents").select("doc_id", fx.entry_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string"), F.substring("text", 1, 60)).alias("entry"))


@query("""with w as (select conv_id, turn, list_sort(list_distinct(string_split_regex(lower(text), '[^a-z]+'))) x from conversations where role = 'user'),
p as (select conv_id, turn, x, lag(x) over (partition by conv_id order by turn) o from w)
select conv_id, turn, len(list_filter(x, lambda y: not list_contains(o, y))) added, len(list_filter(o, lambda y: not list_contains(x, y))) removed from p where o is not null""")
def tag_delta(t):
    """What each turn adds to and removes from the set before it."""
    w = t("conversations").where("role = 'user'").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), "[^a-z]+")).alias("x"))
    p = rollup.with_previous(w, "conv_id", ["turn"], "x").where("previous is not null")
    return p.select("conv_id", "turn", F.size(F.array_except("x", "previous")).cast("long").alias("added"), F.size(F.array_except("previous", "x")).cast("long").alias("removed"))


@query("select o_orderkey, o_orderstatus from orders where o_orderkey > 500 order by 1 limit 100")
def keyset_page(t):
    return rollup.page_after(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 500, 100)


@query("select doc_id, source, rank from (select doc_id, source, row_number() over (partition by source order by n_chars desc, doc_id) rank from documents) where rank <= 5")
def capped_groups(t):
    return rollup.first_of_each(t("documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), "doc_id"], 5).drop("n_chars")


@query("""with s as (select user_id, event_type, count(*) n from events group by 1, 2) select user_id, event_type favourite, n from (select *, row_number() over (partition by user_id order by n desc, event_type) r from s) where r = 1""")
def favourite_type(t):
    """Largest count of each user; ties go to the first name."""
    s = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "event_type")).alias("x")).select("user_id", F.col("x.event_type").alias("favourite"), (-F.col("x.m")).alias("n"))


@query("""with r as (select distinct p_size n from part) select n, cast(least(600000 * pow(2, greatest(0, n - 1)), 7200000) as bigint) backoff,
case when n * 7 < 60 then (n * 7) || ' minute' || case when n * 7 = 1 then '' else 's' end when n * 7 % 60 = 0 then (n * 7 // 60) || ' hour' || case when n * 7 // 60 = 1 then '' else 's' end else (n * 7 // 60) || 'h ' || (n * 7 % 60) || 'm' end said,
(with recursive f(i, a, b) as (select 0, 0::bigint, 1::bigint union all select i + 1, b, a + b from f where i < 60) select max(case when i = n then a end) from f) fib from r""")
def schedule_table(t):
    n = F.col("n")
    return t("part").select(F.col("p_size").alias("n")).distinct().select("n", fx.backoff_ms(n).alias("backoff"), fx.duration(n * 7).alias("said"), fx.fibonacci_minutes(n).alias("fib"))


@query("""with g as (select user_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over (partition by user_id order by ts, event_id) gap from events) select user_id, count(*) filter (gap > 43200000) lost, max(gap) longest from g group by 1""")
def heartbeat_gaps(t):
    e = t("events").select("user_id", "ts", "event_id", fx.epoch_ms(F.col("ts")).alias("at"))
    g = rollup.with_previous(e, "user_id", ["ts", "event_id"], "at", F.to_date("ts")).withColumn("gap", F.col("at") - F.col("previous"))
    return g.groupBy("user_id").agg(F.count_if(F.col("gap") > 43_200_000).alias("lost"), F.max("gap").alias("longest"))


