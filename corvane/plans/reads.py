"""Queries of scans, scopes, permissions and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import levels, messages, names, prompts
from corvane.functions import text as fx
from corvane.operators import backfill, joins, outbox, permissions, rollup, scans, sets, snapshots
from corvane.plans.registry import query

K = "coalesce(cast(json_extract_string(props, '$.k') as bigint), 0)"


def _k():
    return F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long"))


@query("select event_id, user_id from events where event_id <= 700 order by ts desc, event_id desc limit 100")
def history_page(t):
    """One page backwards from an upper bound."""
    return scans.page_before(t("events").select("event_id", "user_id", "ts"), ["ts", "event_id"], 100, F.col("event_id") <= 700).drop("ts")


@query("""with w as (select distinct o_custkey * 3 as event_id from orders) select event_id, event_type, e.event_type is not null found from w left join events e using (event_id)""")
def point_reads(t):
    wanted = t("orders").select((F.col("o_custkey") * 3).alias("event_id")).distinct()
    return scans.point_reads(wanted, t("events").select("event_id", "event_type"), "event_id")


@query("""with r as (select distinct c_nationkey from customer), n as (select n_nationkey, n_name from nation where n_regionkey <> 0) select c_nationkey, n_name, greatest(0, (select count(*) from r) - 15) more from r left join n on n_nationkey = c_nationkey order by n_name nulls last, c_nationkey limit 15""")
def partition_names(t):
    rooms = t("customer").select("c_nationkey").distinct()
    known = t("nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return scans.named(rooms, known, "c_nationkey", "n_name", 15)


@query("""with c as (select source, count(distinct doc_id) complete, count(distinct doc_id) filter (doc_id in (select doc_id from labels)) visible from documents group by 1)
select source, complete, case when source <> 'src3' then visible end visible, case when source <> 'src3' then complete - visible end sealed from c""")
def sealed_gap(t):
    """A complete and a restricted scan of each partition; unknown where a scan failed."""
    d = t("documents").select("source", "doc_id")
    seen = d.join(t("labels").select("doc_id"), "doc_id", "left_semi")
    return scans.gap(d, seen, "source", "doc_id", d.where("source = 'src3'"))


@query("""select conv_id, turn, i, part from (select conv_id, turn, unnest(string_split(text, ' ')) part, generate_subscripts(string_split(text, ' '), 1) - 1 i from conversations where turn > conv_id % 3)""")
def incremental_index(t):
    """Messages after each partition's offset, one row for each part."""
    c = t("conversations")
    offsets = c.select("conv_id", (F.col("conv_id") % 3).alias("offset")).distinct()
    return scans.exploded_after(c.select("conv_id", "turn", F.split("text", " ").alias("parts")), offsets, "conv_id", "turn", "parts").select("conv_id", "turn", "i", "part")


@query("select conv_id, greatest(max(turn), max(case when conv_id % 2 = 0 then 100 end)) as \"offset\" from conversations group by 1")
def index_offsets(t):
    c = t("conversations")
    old = c.where("conv_id % 2 = 0").select("conv_id", F.lit(100).cast("long").alias("offset")).distinct()
    return scans.next_offsets(c, old, "conv_id", "turn")


@query("""select source as k, count(*) as "rows", count(*) filter (n_chars <= 9000) good, case when count(*) filter (n_chars > 9000) > 0 then min((doc_id, n_chars || ' chars')) filter (n_chars > 9000)[2] end reason, count(*) filter (n_chars > 9000) = 0 ok from documents group by 1""".replace("filter (n_chars > 9000)[2] end reason", "filter (n_chars > 9000) end reason").replace("min((doc_id, n_chars || ' chars'))", "arg_min(n_chars || ' chars', doc_id)"))
def isolated_passes(t):
    """One partition's bad row fails that partition only."""
    d = t("documents").withColumnRenamed("source", "k")
    return scans.isolated(d, "k", F.col("n_chars") > 9000, F.concat(F.col("n_chars").cast("string"), F.lit(" chars")), "doc_id")


@query("""with p as (select year(o_orderdate) g, o_orderkey // 400 as page, min(o_orderkey) low, max(o_orderkey) high from orders where not (year(o_orderdate) = 1998 and o_orderkey // 400 = 1) group by 1, 2)
select g, page, low, high from p where g = (select max(g) from (select g from p group by 1 having min(page) = 0 and max(page) + 1 = count(*)))""")
def consistent_pages(t):
    """The newest generation that was read whole."""
    o = t("orders").select(F.year("o_orderdate").alias("g"), F.floor(F.col("o_orderkey") / 400).alias("page"), "o_orderkey").where("not (g = 1998 and page = 1)")
    pages = o.groupBy("g", "page").agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    return scans.consistent(pages, "g", "page", "low", "high")


@query("""select coalesce(reason, 'good') reason, count(*) n from (select case when not coalesce(l_quantity between 1 and 45, false) then 'quantity' when not coalesce(l_discount < 0.09, false) then 'discount' when not l_shipdate >= timestamp '1993-01-01' then 'date' end reason from lineitem) group by 1""")
def checked_rows(t):
    """Rows by the first rule that they break."""
    rows = scans.checked(t("lineitem"), ("quantity", F.col("l_quantity").between(1, 45)), ("discount", F.col("l_discount") < 0.09), ("date", F.col("l_shipdate") >= F.lit("1993-01-01").cast("timestamp_ntz")))
    return rows.groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count("*").alias("n"))


@query("""select l_orderkey, l_linenumber, p_type, s_name from lineitem left join part on p_partkey = l_partkey left join (select * from supplier where s_acctbal >= 0) on s_suppkey = l_suppkey""")
def key_lookups(t):
    """Rows with what two lookup tables say of them; a hidden or missing key gives null."""
    l = t("lineitem")
    parts = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    visible = t("supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return l.join(parts, "l_partkey", "left").join(visible, "l_suppkey", "left").select("l_orderkey", "l_linenumber", "p_type", "s_name")


@query("select distinct lower(split_part(p_type, ' ', 1)) prefix from part where regexp_matches(lower(split_part(p_type, ' ', 1)), '^[a-z0-9]{1,16}\\z') and lower(split_part(p_type, ' ', 1)) <> 'promo'")
def allowed_prefixes(t):
    return t("part").select(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("prefix")).where(names.legal_prefix(F.col("prefix"), ["promo"])).distinct()


@query("""select o_custkey, count(*) n, max(o_orderkey) last from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING') and o_orderstatus = 'F' group by 1""")
def pruned_state_scan(t):
    """State of partitions that are not denied; the predicate reaches the scan."""
    denied = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t("orders").where("o_orderstatus = 'F'").join(denied, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


@query("""select count(*) spent, greatest(0, 50 - count(*)) remaining, greatest(0, 600000 - (m - max(a))) wait_ms from (select epoch_us(ts) // 1000 as a, max(epoch_us(ts) // 1000) over () as m from events) where a > m - 86400000 group by m""")
def spent_budget(t):
    """What a log of the last day leaves of a budget, and how long to wait for the spacing."""
    e = t("events").select(fx.epoch_ms(F.col("ts")).alias("a"))
    now = e.agg(F.max("a").alias("m"))
    s = e.join(F.broadcast(now)).where("a > m - 86400000").groupBy("m").agg(F.count("*").alias("spent"), F.max("a").alias("last"))
    zero = F.lit(0).cast("long")
    return s.select("spent", F.greatest(zero, 50 - F.col("spent")).alias("remaining"), F.greatest(zero, 600_000 - (F.col("m") - F.col("last"))).alias("wait_ms"))


@query("""with s as (select user_id, event_type, avg(value) / 100 score from events group by 1, 2), b as (select user_id, string_agg(event_type, ',' order by event_type) filter (score >= case event_type when 'error' then 0.6 when 'view' then 0.52 else 0.35 end) tags from s group by 1)
select user_id, coalesce(tags, '') tags, (select arg_min(event_type, (-score, event_type)) from s x where x.user_id = b.user_id) rating from b""")
def score_tags(t):
    """Keys of a score map over the bar of their kind, and its best key; rows without a kind count for neither, and none is best without a user."""
    s = t("events").groupBy("user_id", "event_type").agg((rollup.exact_avg("value") / 100).alias("score"))
    known = F.when(F.col("event_type").isNotNull(), F.struct("event_type", "score"))
    s = s.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(known))).alias("m"))
    bars = F.create_map(F.lit("error"), F.lit(0.6), F.lit("view"), F.lit(0.52))
    return s.select("user_id", F.array_join(scans.above(F.col("m"), bars), ",").alias("tags"), F.when(F.col("user_id").isNotNull(), scans.best(F.col("m"))).alias("rating"))


@query("""select s_suppkey, case when not regexp_matches(id, '^[0-9]{1,20}\\z') then 'not an id' when not regexp_matches(prefix, '^[a-z0-9]{1,16}\\z') or prefix = 'china' then 'prefix' when s_acctbal < 500 then 'not allowed' when n_regionkey = 2 then 'awaiting invite' else 'indexed' end state from
(select s.*, n_regionkey, case when s_suppkey % 9 = 4 then 'x' else '' end || s_suppkey as id, lower(n_name) prefix from supplier s join nation on n_nationkey = s_nationkey)""")
def target_status(t):
    """Each configured target with the first reason against it, by precedence."""
    n = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.lower("n_name").alias("prefix"), "n_regionkey")
    rows = t("supplier").join(n, "s_nationkey", "left").withColumn("id", F.concat(F.when(F.col("s_suppkey") % 9 == 4, "x").otherwise(""), F.col("s_suppkey").cast("string")))
    allowed = t("supplier").where("s_acctbal >= 500").select("s_suppkey", F.lit(True).alias("allowed"))
    member = t("supplier").join(t("nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey", "left_semi").select("s_suppkey", F.lit(True).alias("member"))
    rows = rows.join(allowed, "s_suppkey", "left").join(member, "s_suppkey", "left")
    against = messages.first_reason((F.col("id").rlike(r"^[0-9]{1,20}\z"), "not an id"), (names.legal_prefix(F.col("prefix"), ["china"]), "prefix"), (F.col("allowed"), "not allowed"), (F.col("member"), "awaiting invite"))
    return rows.select("s_suppkey", F.coalesce(against, F.lit("indexed")).alias("state"))


@query("""with e as (select event_id, user_id, event_type, value, lag(event_type) over (partition by user_id order by ts, event_id) p from events) select route, count(*) n from (select case when event_type = 'signup' then case when p is null then 'invite' when p = 'signup' then 'profile' when p = 'error' then 'rejoin' else 'join' end
when user_id % 5 = 0 then 'denied' when event_type = 'error' then 'removal' when event_type = 'view' and value < 20 then 'edit' when event_type = 'view' then 'command' else 'image' end route from e) group by 1""")
def event_routes(t):
    """Each event to one route, by precedence."""
    e = rollup.with_previous(t("events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"], "event_type", F.to_date("ts"))
    kind, p = F.col("event_type"), F.col("previous")
    membership = F.when(p.isNull(), "invite").when(p == "signup", "profile").when(p == "error", "rejoin").otherwise("join")
    route = F.when(kind == "signup", membership).when(F.col("user_id") % 5 == 0, "denied").when(kind == "error", "removal").when((kind == "view") & (F.col("value") < 20), "edit").when(kind == "view", "command").otherwise("image")
    return e.groupBy(route.alias("route")).agg(F.count("*").alias("n"))


@query("""select event_id, user_id from events where event_type in ('click', 'purchase') and user_id % 4 <> 1 and value >= 10 and props is not null and not (coalesce(json_extract_string(props, '$.k')::bigint, 0) % 10 = 3) and ts >= timestamp '2024-01-05' order by ts desc, event_id desc limit 50""")
def image_events(t):
    """Six conditions, edits left out, newest first."""
    e = t("events").where(F.col("event_type").isin("click", "purchase") & (F.col("user_id") % 4 != 1) & (F.col("value") >= 10) & F.col("props").isNotNull() & (_k() % 10 != 3) & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")))
    return scans.page_before(e.select("event_id", "user_id", "ts"), ["ts", "event_id"], 50).drop("ts")


@query("""select why, xok, name_ok, count(*) n from (select why, why is null as xok, source not in ('src5', 'src6') name_ok from (select source, case when source = 'src0' then 'own' when source in ('src1', 'src2') then 'bot' when lang <> 'en' then 'not an image (' || lang || ')' end why from documents)) group by 1, 2, 3""".replace("select why, why is null as xok", "select case when why is null and source in ('src5', 'src6') then 'no account id' else why end why, why is null as xok"))
def scope_classify(t):
    """Own before bot before kind before name; whether the row and its name are in scope is kept apart."""
    s, lang = F.col("source"), F.col("lang")
    ground = F.when(s == "src0", "own").when(s.isin("src1", "src2"), "bot").when(lang != "en", F.concat(F.lit("not an image ("), lang, F.lit(")")))
    d = t("documents").select(ground.alias("ground"), (~s.isin("src5", "src6")).alias("name_ok")).withColumn("xok", F.col("ground").isNull())
    why = F.when(F.col("xok") & ~F.col("name_ok"), "no account id").otherwise(F.col("ground"))
    return d.groupBy(why.alias("why"), "xok", "name_ok").agg(F.count("*").alias("n"))


@query("""select conv_id, turn, role = 'user' and length(regexp_replace(text, '[^e]', '', 'g')) <= 3 and not contains(text, '?') withheld from conversations where turn % 2 = 0""")
def withheld_messages(t):
    """Messages of a person of which every part is empty."""
    letters = F.regexp_replace("text", "[^e]", "")
    parts = [F.when(F.length(letters) > 3, letters), F.array().cast("array<string>"), F.filter(F.split("text", r"\?"), lambda x, i: i > 0)]
    empty = [F.coalesce(parts[0] == "", F.lit(True)), F.size(F.coalesce(parts[1], F.array().cast("array<string>"))) == 0, F.size(parts[2]) == 0]
    return t("conversations").where("turn % 2 = 0").select("conv_id", "turn", ((F.col("role") == "user") & empty[0] & empty[1] & empty[2]).alias("withheld"))


@query("""select event_id, event_id % 4 = 0 as edit, case when event_id % 4 = 0 and event_type = 'click' then 'm' || event_id end as media from events""")
def edits(t):
    """Which events replace another one, and the local id of the picture that they bring."""
    url = F.concat(F.lit("mxc://own.host/m"), F.col("event_id").cast("string"))
    content = F.to_json(F.struct(F.when(F.col("event_id") % 4 == 0, F.struct(F.lit("m.replace").alias("rel_type"))).alias("relates"), F.when(F.col("event_type") == "click", F.struct(url.alias("url"))).alias("new_content")))
    e = t("events").select("event_id", content.alias("content"))
    edit = F.coalesce(F.get_json_object("content", "$.relates.rel_type") == "m.replace", F.lit(False))
    media = F.regexp_extract(F.get_json_object("content", "$.new_content.url"), "^mxc://own\\.host/([A-Za-z0-9_-]+)$", 1)
    return e.select("event_id", edit.alias("edit"), F.when(edit & (media != ""), media).alias("media"))


@query("""select conv_id, turn, len(list_filter(w, lambda x: x not in ('the', 'a', 'to'))) kept, len(list_filter(w, lambda x: x in ('the', 'a', 'to'))) > 0 carried from (select conv_id, turn, string_split(lower(text), ' ') w from conversations)""")
def stripped_names(t):
    """Tags without unwanted names, and whether there were any."""
    unwanted = F.array(*map(F.lit, ("the", "a", "to")))
    w = F.split(F.lower("text"), " ")
    sources = F.create_map(F.lit("all"), w)
    kept = F.size(F.element_at(snapshots.without_names_in(sources, unwanted), "all")).cast("long")
    return t("conversations").select("conv_id", "turn", kept.alias("kept"), snapshots.carries_any(F.array().cast("array<string>"), sources, unwanted).alias("carried"))


@query("""select doc_id, lang || ' ' || source || case when source = lang then '' else ' ' || lang || '_' || source end || case when n_chars > 3000 then ' ai-generated' else '' end tags, source || ' ' || lang as kept, lang || ' x' edited from documents""")
def public_tags(t):
    """The public list of up to five inputs, once each in order; private words without public labels; an edited set."""
    lang, source = F.col("lang"), F.col("source")
    none = F.lit(None).cast("array<string>")
    public = sets.merged(F.array(lang, source), F.array(source, lang), F.array(F.concat_ws("_", lang, source)), F.when(F.col("n_chars") > 3000, F.array(F.lit("ai-generated"))), none)
    kept = sets.kept(F.array(source, F.lit("no_train"), lang, F.lit("ai-generated")), ["ai-generated", "no_train"])
    edited = sets.edited(F.array(source, lang), F.array(F.lit("x"), lang), F.array(source))
    join = lambda c: F.array_join(c, " ")
    return t("documents").select("doc_id", join(public).alias("tags"), join(kept).alias("kept"), join(edited).alias("edited"))


@query("""select event_id, case when event_id % 3 <> 0 then 'type=' || event_type || case when event_id % 3 = 1 then ',user=' || user_id else '' end end as said from events""")
def generation_records(t):
    """A record's fields with zero characters scrubbed; null without fields."""
    fields = F.map_filter(F.create_map(F.lit("type"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("\x00"), "event_type")), F.lit("user"), F.when(F.col("event_id") % 3 == 1, F.concat(F.col("user_id").cast("string"), F.lit("\x00")))), lambda k, v: v.isNotNull())
    clean = F.transform_values(fields, lambda k, v: F.replace(v, F.lit("\x00"), F.lit("")))
    said = F.array_join(F.transform(F.map_entries(clean), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return t("events").select("event_id", F.when(F.size(fields) > 0, said).alias("said"))


@query("""select e.event_id, case when user_id % 7 = 0 and coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) % 13 >= 12 then 9007199254740991 else coalesce(try_cast(json_extract_string(props, '$.level') as bigint), try_cast(json_extract_string(props, '$.k') as bigint), 0) end as level
from events e where user_id in (select user_id from events where event_type = 'purchase')""")
def power_levels(t):
    """Level of each event of a buyer: its owner's without bound from version 12 on, else its own, else the default, else 0."""
    buyers = t("events").where("event_type = 'purchase'").select("user_id")
    owner = (F.col("user_id") % 7 == 0) & (_k() % 13 >= 12)
    level = F.when(owner, F.lit(9_007_199_254_740_991)).otherwise(F.coalesce(F.get_json_object("props", "$.level").cast("long"), _k()))
    return joins.in_scope(t("events"), (buyers, "user_id")).select("event_id", level.alias("level"))


@query(f"""with m as (select user_id, 1::bigint << ({K} % 60) mask, case event_type when 'click' then 'base' when 'view' then 'group' else 'member' end stage, case when value < 50 or event_type = 'click' then 'allow' else 'deny' end kind, user_id % 11 = 3 own from events),
s as (select user_id, coalesce(bit_or(mask) filter (stage = 'base'), 0) b, coalesce(bit_or(mask) filter (stage = 'group' and kind = 'deny'), 0) gd, coalesce(bit_or(mask) filter (stage = 'group' and kind = 'allow'), 0) ga,
coalesce(bit_or(mask) filter (stage = 'member' and kind = 'deny'), 0) md, coalesce(bit_or(mask) filter (stage = 'member' and kind = 'allow'), 0) ma, bool_or(own) own from m group by 1),
f as (select user_id, case when own or b & 8 <> 0 then -1 else ((((b & ~gd) | ga) & ~md) | ma) end permissions from s)
select user_id, permissions, permissions & 1024 <> 0 as view, permissions & 1024 <> 0 and permissions & 65536 <> 0 as history, permissions & 1024 <> 0 and permissions & 2048 <> 0 as send, permissions & 1024 <> 0 and permissions & 65536 <> 0 and permissions & 64 <> 0 as react from f""")
def permission_fold(t):
    """Masks folded in order; owners and administrators may do everything; what that allows."""
    kind = F.when((F.col("value") < 50) | (F.col("event_type") == "click"), "allow").otherwise("deny")
    stage = F.when(F.col("event_type") == "click", "base").when(F.col("event_type") == "view", "group").otherwise("member")
    masks = t("events").select("user_id", F.call_function("shiftleft", F.lit(1).cast("long"), (_k() % 60).cast("int")).alias("mask"), stage.alias("stage"), kind.alias("kind"), (F.col("user_id") % 11 == 3).alias("own"))
    p = permissions.folded(masks, "user_id", "mask", "stage", ["base", "group", "member"], owner="own", administrator=8)
    return p.select("user_id", "permissions", permissions.presence(F.col("permissions"), 1024, 65536, 2048, 64).alias("x")).select("user_id", "permissions", "x.*")


@query("select event_type, count(*) n, count(*) filter (value >= 50) high, count(*) filter (value < 10) low, max(value) most, count(distinct user_id) users, bool_or(value > 99) capped from events group by 1")
def outcome_tally(t):
    """Counts of each outcome and its flags in one aggregation."""
    v = F.col("value")
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(v >= 50).alias("high"), F.count_if(v < 10).alias("low"), F.max("value").alias("most"), F.count_distinct("user_id").alias("users"), F.bool_or(v > 99).alias("capped"))


OUTBOX = f"(select event_id, epoch_us(ts) // 1000 queued_at, {K} % 7 attempts, case when {K} % 7 = 0 then null else epoch_us(ts) // 1000 + cast(least(600000 * pow(2, greatest(0, {K} % 7 - 1)), 7200000) as bigint) end next_try_at, event_type as cls, (select max(epoch_us(ts) // 1000) from events) as now from events)"


def _outbox(t) -> DataFrame:
    e = t("events").select("event_id", fx.epoch_ms(F.col("ts")).alias("queued_at"), (_k() % 7).alias("attempts"), F.col("event_type").alias("cls"))
    now = e.agg(F.max("queued_at").alias("now"))
    return e.withColumn("next_try_at", F.when(F.col("attempts") > 0, F.col("queued_at") + fx.backoff_ms(F.col("attempts")))).join(F.broadcast(now))  # one row


@query(f"""select *, case when depth = 0 then null when over_24h > 0 or depth >= 4000 then 'error' else 'warn' end severity from (select case when queued_at > now - 3000000 then 'new' when queued_at > now - 60000000 then 'recent' else 'all' end box, count(*) depth, count(*) filter (next_try_at is null or next_try_at <= now) due, count(*) filter (attempts = 0) never_tried,
count(*) filter (attempts > 0 and cls = 'error') kept_error, count(*) filter (now - queued_at > 3600000) over_1h, count(*) filter (now - queued_at > 86400000) over_24h, min((queued_at, event_id))[2] oldest, round((max(now) - min(queued_at)) / 1000.0)::bigint oldest_s from {OUTBOX} group by 1)""")
def outbox_status(t):
    """Depth, what is due, kept and old, the oldest entry, and how bad that is, of each outbox."""
    age, q = F.col("now") - F.col("queued_at"), F.col("queued_at")
    box = F.when(q > F.col("now") - 3_000_000, "new").when(q > F.col("now") - 60_000_000, "recent").otherwise("all")
    s = _outbox(t).groupBy(box.alias("box")).agg(
        F.count("*").alias("depth"), F.count_if(F.coalesce(F.col("next_try_at") <= F.col("now"), F.lit(True))).alias("due"), F.count_if(F.col("attempts") == 0).alias("never_tried"), F.count_if((F.col("attempts") > 0) & (F.col("cls") == "error")).alias("kept_error"),
        F.count_if(age > 3_600_000).alias("over_1h"), F.count_if(age > 86_400_000).alias("over_24h"), F.min(F.struct("queued_at", "event_id"))["event_id"].alias("oldest"), F.round(F.max(age) / 1000).cast("long").alias("oldest_s"),
    )
    return s.withColumn("severity", outbox.severity(F.col("over_24h"), F.col("depth")))


@query("""with w as (select distinct conv_id, role, x as word from (select conv_id, role, unnest(string_split_regex(lower(text), '[^a-z]+')) x from conversations where role in ('user', 'assistant')) where x <> ''),
k as (select conv_id, word, bool_or(role = 'user') u, bool_or(role = 'assistant') a from w group by 1, 2)
select conv_id, case when u and a then 'both' when u then 'user_only' else 'assistant_only' end part, count(*) n from k where (u and a) or a or word not in ('please', 'the') group by 1, 2""")
def provenance_partition(t):
    """Words of a conversation by who used them; public labels are nobody's own."""
    words = t("conversations").select("conv_id", "role", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word")).where("word <> ''")
    parts = sets.source_of(words, ["conv_id", "word"], "role", "user", "assistant", labels=["please", "the"], value="word")
    return parts.groupBy("conv_id", "part").agg(F.count("*").alias("n"))


@query("""with c as (select doc_id, source a, lang b, case when n_chars % 2 = 0 then source else lang end m from documents)
select doc_id, case when m = a then a else '' end as both, case when m = a then b else b || '' end || case when m = a then '' when m = b then '' else '' end as left_, null as x from c""".replace(", null as x", "").replace("case when m = a then a else '' end as both, case when m = a then b else b || '' end || case when m = a then '' when m = b then '' else '' end as left_", "m as both, case when m = a then b else a end as auto_only, 'mine' as creator_only, case when m = a then b else a end || ' ' || m || ' meta' as spectrum"))
def provenance_lists(t):
    """The same on the lists of one row: both, automatic only, creator only, and the spectrum of what is public."""
    lang, source = F.col("lang"), F.col("source")
    auto = F.array(source, lang)
    creator = F.array(F.when(F.col("n_chars") % 2 == 0, source).otherwise(lang), F.lit("no_train"), F.lit("mine"))
    p = sets.provenance(creator, auto, F.array(F.lit("meta")), ["ai-generated", "no_train"])
    join = lambda c: F.array_join(f"p.{c}", " ").alias(c)
    return t("documents").select("doc_id", p.alias("p")).select("doc_id", *map(join, ("both", "auto_only", "creator_only", "spectrum")))


@query("""select o_orderpriority, count(*) n, sum(case when c_nationkey in (select n_nationkey from nation where n_regionkey in (1, 2)) then 1 else 0 end) in_scope
from orders join customer on o_custkey = c_custkey group by 1""")
def semi_scope(t):
    """Orders inside and outside of a scope, in one join with a flag."""
    nations = t("nation").where(F.col("n_regionkey").isin(1, 2)).select(F.col("n_nationkey").alias("c_nationkey"), F.lit(1).alias("x"))
    customers = t("customer").join(nations, "c_nationkey", "left").select(F.col("c_custkey").alias("o_custkey"), F.coalesce("x", F.lit(0)).alias("x"))
    return t("orders").join(customers, "o_custkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("x").alias("in_scope"))


@query("""select lang, source, n, chars, latest from (select lang, source, count(*) n, sum(n_chars) chars, max(doc_id) latest from documents where source in (select source from documents where n_chars > 12000) group by 1, 2) order by 1""")
def state_levels(t):
    """Rows by room with a semi join on a subquery, coalesced and ordered."""
    d = t("documents")
    wanted = d.where("n_chars > 12000").select("source").distinct()
    return d.join(wanted, "source", "left_semi").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("doc_id").alias("latest")).orderBy("lang")


@query("""select o_custkey, count(*) members from orders where o_orderpriority <> '5-LOW' group by 1 having count(*) > 0 union all select c_custkey, -1 from customer where c_custkey not in (select o_custkey from orders where o_orderpriority <> '5-LOW')""")
def member_counts(t):
    """Members of each room, -1 where none could be read."""
    counts = t("orders").where("o_orderpriority <> '5-LOW'").groupBy("o_custkey").agg(F.count("*").alias("members"))
    rooms = t("customer").select(F.col("c_custkey").alias("o_custkey"))
    return rooms.join(counts, "o_custkey", "full").select("o_custkey", F.coalesce("members", F.lit(-1).cast("long")).alias("members"))


@query("""with d as (select source, lang, count(*) n from documents group by 1, 2) select source, arg_max(text, (length(text), -doc_id)) is not null as found, max(length(text)) as longest, arg_min(doc_id, (-length(text), doc_id)) as id from documents group by 1""")
def longest_texts(t):
    """The longest text of each source; the first of equal ones."""
    pick = F.min(F.struct((-F.length("text")).alias("n"), "doc_id"))
    return t("documents").groupBy("source").agg(F.lit(True).alias("found"), pick.alias("p")).select("source", "found", (-F.col("p.n")).cast("long").alias("longest"), F.col("p.doc_id").alias("id"))


@query("""select event_id from (select event_id, (event_id * 7919) % 1000003 || '' as snow from events) order by try_cast(snow as hugeint), event_id limit 120""")
def numeric_order(t):
    """Ids that are texts of numbers, in the order of the numbers."""
    snow = ((F.col("event_id") * 7919) % 1000003).cast("string")
    return t("events").select("event_id", snow.alias("snow")).orderBy(F.col("snow").cast("decimal(20,0)"), "event_id").limit(120).select("event_id")


@query("select doc_id, source from documents order by n_chars desc, doc_id limit 60")
def newest_first(t):
    return t("documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(60).drop("n_chars")


@query("""with m as (select *, count(*) filter (event_type <> 'error') over (partition by user_id order by ts, event_id rows unbounded preceding) g from events), r as (select user_id, g, count(*) n, max((ts, event_id)) last from m where event_type = 'error' group by 1, 2),
f as (select user_id, min((ts, event_id)) as stop from (select *, row_number() over (partition by user_id, g order by ts, event_id) k from m where event_type = 'error') where k >= 2 group by 1)
select e.user_id, count(*) sent, bool_or(f.stop is not null) stopped from events e left join f using (user_id) where f.stop is null or (e.ts, e.event_id) <= f.stop group by 1""")
def stopped_runs(t):
    """Each key up to its second failure in a row, and whether that came."""
    return rollup.until_failures(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2, F.to_date("ts"))


@query("""select user_id, max(a) most, arg_min(event_id, (-a, event_id)) as event_id from (select user_id, event_id, coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) % 7 a from events) group by 1""")
def most_attempts(t):
    """The row with most attempts of each key; the first of equal ones."""
    return t("events").groupBy("user_id").agg(F.min(F.struct((-(_k() % 7)).alias("a"), "event_id")).alias("x")).select("user_id", (-F.col("x.a")).alias("most"), F.col("x.event_id").alias("event_id"))


@query("""select a.user_id, count(*) n from (select distinct user_id, event_type from events) a group by 1""")
def once_each(t):
    """Rows that repeat a key are alike: one of each stays."""
    return t("events").dropDuplicates(["user_id", "event_type"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""select lower(x) as name, count(*) filter (s = 1) > 0 as left_, count(*) filter (s = 2) > 0 as right_ from (select n_name x, 1 s from nation where n_regionkey < 3 union all select n_name, 2 from nation where n_regionkey > 1) group by 1""")
def name_union(t):
    """The union of two sets of names, each name once, with the sides that have it."""
    n = t("nation")
    both = n.where("n_regionkey < 3").select(F.lower("n_name").alias("name"), F.lit(1).alias("s")).union(n.where("n_regionkey > 1").select(F.lower("n_name").alias("name"), F.lit(2).alias("s")))
    return both.groupBy("name").agg(F.bool_or(F.col("s") == 1).alias("left_"), F.bool_or(F.col("s") == 2).alias("right_"))


@query("""select conv_id, string_agg(said, chr(10) order by turn) said from (select conv_id, min(turn) turn, text said from conversations group by 1, 3) group by 1""")
def accumulated_texts(t):
    """Texts of one key joined by line breaks, an identical one once, zero characters scrubbed."""
    c = t("conversations").select("conv_id", "turn", F.replace(F.concat("text", F.lit("\x00")), F.lit("\x00"), F.lit("")).alias("said"))
    first = c.groupBy("conv_id", "said").agg(F.min("turn").alias("turn"))
    return first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("x")).select("conv_id", F.array_join("x.said", "\n").alias("said"))


@query("""select c_custkey, greatest(50, c_custkey % 100) as "write", c_custkey % 3 = 0 as changed from customer""".replace("c_custkey % 3 = 0 as changed", "c_custkey % 100 < 50 as changed"))
def granted_levels(t):
    """A nested setting created or raised, never lowered; granting twice changes nothing."""
    events = F.when(F.col("c_custkey") % 100 != 0, F.create_map(F.lit("write"), F.col("c_custkey") % 100))
    once = levels.granted(events, "write", 50)
    twice = levels.granted(once, "write", 50)
    level = F.element_at(twice, "write")
    return t("customer").select("c_custkey", level.alias("write"), (~F.coalesce(F.element_at(events, "write") >= 50, F.lit(False))).alias("changed"))


@query("""with m as (select *, case event_type when 'signup' then ts end armed, case when event_type = 'click' then ts end used from events),
a as (select *, max(armed) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) last_armed, max(used) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) last_used from m)
select event_id, case when last_armed is null or (last_used is not null and last_used >= last_armed) then 'none' when ts - last_armed <= interval 12 hours then 'consumed' else 'expired' end as session from a where event_type = 'click'""")
def armed_sessions(t):
    """A session that one event arms is consumed by the next picture in time, else it expires (here after twelve hours)."""
    return rollup.armed(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "click", "interval 12 hours", F.to_date("ts")).select("event_id", "session")


@query("""with d as (select doc_id, source s, lang l, n_chars % 2 = 0 as e, doc_id % 5 = 0 as unknown from documents),
x as (select doc_id, case when unknown then [] when s = l then [s] else [s, l] end as auto, [case when e then s else l end, 'no_train', 'mine', 'mine'] as creator, case when unknown then ['seed'] else ['m', 'seed'] end as meta from d)
select doc_id, array_to_string(list_filter(creator, lambda x: x <> 'no_train' and not list_contains(auto, x)), ' ') as creator, array_to_string(list_filter(auto, lambda x: not list_contains(creator, x)), ' ') as auto, array_to_string(list_filter(auto, lambda x: list_contains(creator, x)), ' ') as both, array_to_string(meta, ' ') as meta, '' as oc from x""")
def reread_partition(t):
    """Stored partitions rebuilt around a fresh read: what was automatic stays, the creator's part is new."""
    lang, source = F.col("lang"), F.col("source")
    stored = F.when(F.col("doc_id") % 5 != 0, F.create_map(F.lit("auto"), F.array(source), F.lit("both"), F.array(lang, source), F.lit("meta"), F.array(F.lit("m"))))
    creator = F.array(F.when(F.col("n_chars") % 2 == 0, source).otherwise(lang), F.lit("no_train"), F.lit("mine"), F.lit("mine"))
    p = sets.reread(creator, F.array(F.lit("seed")), F.lit(None).cast("array<string>"), stored, ["ai-generated", "no_train"])
    join = lambda c: F.array_join(f"p.{c}", " ").alias(c)
    return t("documents").select("doc_id", p.alias("p")).select("doc_id", *map(join, ("creator", "auto", "both", "meta", "oc")))


_BYTES = """(select doc_id, md5(text) as raw, case when doc_id % 3 = 0 then md5(text) else md5(lower(text) || ' ') end as stripped from documents)"""


@query(f"""with b as {_BYTES}, p as (select md5, min(post_id) as post_id from (select stripped as md5, doc_id as post_id from b where doc_id % 4 = 0 union all select raw, doc_id from b where doc_id % 7 = 1 union all select md5('old' || raw), doc_id from b where doc_id % 5 < 2) group by 1),
r as (select raw, any_value(case when lang = 'en' then stripped else md5('old' || raw) end order by doc_id) as recorded from b join documents using (doc_id) where doc_id % 2 = 1 group by 1),
j as (select b.doc_id, stripped, raw, recorded, (select post_id from p where p.md5 = b.stripped) as a, (select post_id from p where p.md5 = recorded and recorded <> b.stripped) as c, (select post_id from p where p.md5 = b.raw and b.raw <> b.stripped) as d from b left join r using (raw))
select doc_id, coalesce(a, c, d) as post_id, case when a is not null then 'stripped' when c is not null then 'raw-record' when d is not null then 'raw' end as via, case when a is not null then stripped when c is not null then recorded when d is not null then raw end as md5 from j""")
def bytes_lookup(t):
    """The post of each text's bytes by the stripped digest, the one on record for the raw bytes, or the raw one."""
    d = t("documents")
    raw, i = F.md5("text"), F.col("doc_id")
    b = d.select("doc_id", "lang", raw.alias("raw_md5"), F.when(i % 3 == 0, raw).otherwise(F.md5(F.concat(F.lower("text"), F.lit(" ")))).alias("stripped_md5"))
    old = F.md5(F.concat(F.lit("old"), F.col("raw_md5")))
    posts = b.select(F.explode(F.array_compact(F.array(F.when(i % 4 == 0, F.col("stripped_md5")), F.when(i % 7 == 1, F.col("raw_md5")), F.when(i % 5 < 2, old)))).alias("md5"), "doc_id").groupBy("md5").agg(F.min("doc_id").alias("post_id"))
    records = b.where(i % 2 == 1).groupBy("raw_md5").agg(F.min_by(F.when(F.col("lang") == "en", F.col("stripped_md5")).otherwise(old), "doc_id").alias("recorded"))
    return joins.by_digest(b.drop("lang"), posts, records).select("doc_id", "post_id", "via", "md5")


# stretches of 200 events as rooms of 20 pages
_IMAGE = "event_type <> 'signup'"
_OUTCOME = "case when value < 10 then 'failed' when value < 18 then 'tags-blocked' when value < 22 then 'strip-refused' when value < 25 then 'held-hidden' else 'posted' end"


@query(f"""with e as (select event_id, event_id // 200 as room, event_id % 200 // 10 + 1 as page, event_id % 10 as seq, {_IMAGE} as image, {_OUTCOME} as outcome, event_type, value from events),
o as (select *, count(*) filter (value >= 20) over (partition by room order by event_id rows between unbounded preceding and current row) - (value >= 20)::int as b from e where event_type = 'error' and page > 15),
o2 as (select *, case when b >= 90 then 'carried' when value < 12 then 'unreadable' when value < 20 then 'dropped' when value < 40 then 'failed' else 'done' end as became from o),
d as (select room, count(*) filter (became in ('failed', 'done')) as retried from o2 group by 1),
p as (select room, page, sum(image::int) as n, case when room % 6 = 1 and page = 7 then 'error' when room % 5 = 2 and page = 6 then 'start' when room % 7 = 3 and page = 5 then 'stalled' end as mark from e where page <= 12 group by 1, 2),
w as (select p.*, coalesce(retried, 0) + coalesce(sum(n) over (partition by room order by page rows between unbounded preceding and 1 preceding), 0) as before from p left join d using (room)),
s as (select *, case when mark = 'error' then mark when before + n > 90 then 'partial' else mark end as stops from w),
f as (select * from (select *, min(case when stops is not null then page end) over (partition by room) as stop from s) where before < 90 and (stop is null or page <= stop)),
h as (select room, became from o2 union all select room, case outcome when 'posted' then 'done' when 'tags-blocked' then 'blocked' when 'strip-refused' then 'refused' when 'held-hidden' then 'hidden' else outcome end from
(select e.room, e.outcome, f.before + row_number() over (partition by e.room, e.page order by e.seq) as k from e join f using (room, page) where e.image and f.stops is distinct from 'error') where k <= 90),
c as (select room, count(*) filter (became = 'done') as done, count(*) filter (became = 'blocked') as blocked, count(*) filter (became = 'refused') as refused, count(*) filter (became = 'hidden') as hidden, count(*) filter (became = 'failed') as failed, count(*) filter (became in ('failed', 'carried', 'unreadable')) as n_failures, count(*) filter (became = 'dropped') as n_dropped from h group by 1),
z as (select room, count(*) filter (stops is distinct from 'error') as pages, sum(n) filter (stops is distinct from 'error') as seen, arg_max(coalesce(stops, 'none'), page) as why, arg_max(case when stops is null then page + 1 else page end, page) as cur from f group by 1),
r as (select r.room, coalesce(seen, 0) as seen, coalesce(done, 0) as done, coalesce(blocked, 0) as blocked, coalesce(refused, 0) as refused, coalesce(hidden, 0) as hidden, coalesce(failed, 0) as failed, coalesce(retried, 0) as retried, coalesce(pages, 0) as pages, why, cur, n_failures, n_dropped from (select distinct room from e) r left join z using (room) left join c using (room) left join d using (room)),
q as (select *, done + blocked + refused + hidden + failed >= 90 as capped from r)
select room, case when cur = 1 or cur is null then null else 't' || cur end as cursor, coalesce(n_failures, 0) as n_failures, coalesce(n_dropped, 0) as n_dropped,
'[backfill] ' || room || ': ' || seen || ' image(s) found, ' || done || ' done' || case when retried > 0 then ', ' || retried || ' earlier failure(s) retried' else '' end || case when blocked > 0 then ', ' || blocked || ' posted but tag state blocked' else '' end
|| case when refused > 0 then ', ' || refused || ' NOT posted: generation data would not strip (see the [strip] lines)' else '' end || case when hidden > 0 then ', ' || hidden || ' NOT posted: the booru holds them under a deleted or jailed post (see the [skip] lines; not retried)' else '' end
|| case when failed > 0 then ', ' || failed || ' failed (retried on the next run)' else '' end || case when capped then ', stopped at the cap' else '' end || ' in ' || (room % 3 + 1) || 's' ||
case when room % 4 = 1 then case when why = 'start' then '; caught up to where the last walk began' else '; the gap since the last walk is NOT fully walked (!backfill restart walks it)' end when why = 'start' then '; reached the start of the room (or the furthest back the bot may read)'
else '; OLDER HISTORY NOT YET WALKED (' || case when why = 'error' then 'stopped by an error, named in the bridge log''s history page line' when why = 'stalled' then 'the homeserver''s pagination token stopped moving' when capped then 'this run''s picture cap was reached' else 'this run''s ' || pages || '-page budget was spent' end || ') -- the sweep resumes it, or !backfill' end as report from q""")
def room_runs(t):
    """One run over every room's history at once: what it reaches up to 90 pictures or 12 pages, its failures, and its report."""
    i = F.col("event_id")
    e = t("events").select("event_id", F.floor(i / 200).alias("room"), (F.floor(i % 200 / 10) + 1).alias("page"), (i % 10).alias("seq"), "event_type", "value", F.expr(_OUTCOME).alias("outcome"))
    room, page = F.col("room"), F.col("page")
    url = F.concat(F.lit("mxc://h/"), i.cast("string")).alias("url")
    why = F.when(F.col("outcome") == "failed", "no answer").alias("error")
    token = lambda n: F.concat(F.lit("t"), n.cast("string"))
    end = F.when((room % 5 == 2) & (page == 6), None).when((room % 7 == 3) & (page == 5), token(page)).otherwise(token(page + 1))
    pages = e.select("room", "page").distinct().select("room", "page", token(page).alias("first"), end.alias("end"), F.when((room % 6 == 1) & (page == 7), "no page").alias("error"))
    v = F.col("value")
    again = F.when(v < 12, "unreadable").when(v < 20, "gone").when(v < 40, "failed").otherwise("posted").alias("outcome")
    owed = e.where("event_type = 'error' and page > 15").select("room", i.alias("seq"), "event_id", url, (i % 4).alias("attempts"), again, F.lit("owed").alias("error"))
    rooms = e.select("room").distinct().withColumn("start", F.lit(None).cast("string"))
    out = backfill.run(rooms, pages, e.where(_IMAGE).select("room", "page", "seq", "event_id", url, "outcome", why), owed, "room", cap=90, most_pages=12)
    kind = F.when(room % 4 == 1, "gap").otherwise("resume")
    return out.select("room", "cursor", F.size("failures").cast("long").alias("n_failures"), F.size("dropped").cast("long").alias("n_dropped"), backfill.report(kind, room, (room % 3 + 1) * 1000).alias("report"))
