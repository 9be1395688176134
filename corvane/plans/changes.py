"""Queries of writes and of joins that decide about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import messages, names
from corvane.operators import joins, rollup, writes
from corvane.plans.registry import query


@query("""with n as (select o_custkey k, min(o_orderpriority) v from orders group by 1), s as (select c_custkey k, case when c_custkey % 3 = 0 then '1-URGENT' else '3-MEDIUM' end v from customer where c_custkey % 2 = 0)
select case when s.v is null then 'inserted' when s.v = n.v then 'same' else 'refused' end state, count(*) n from n left join s using (k) group by 1""")
def insert_if_absent(t):
    stored = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "1-URGENT").otherwise("3-MEDIUM").alias("v"))
    new = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"))
    return writes.inserts(stored, new, "k", "v").groupBy("state").agg(F.count("*").alias("n"))


@query("select doc_id, min(doc_id) over (partition by md5(text)) as \"of\", case when doc_id = min(doc_id) over (partition by md5(text)) then 'created' else 'duplicate' end state from documents")
def unique_inserts(t):
    """Texts created, or found to be the duplicate of an earlier one."""
    return writes.uniquely(t("documents").select("doc_id", F.md5("text").alias("digest")), "digest", "doc_id").select("doc_id", "of", "state")


@query("""with s as (select c_custkey md5, c_custkey * 2 raw, c_mktsegment poster from customer where c_custkey % 3 <> 0), h as (select raw, min(md5) holder from s group by 1),
i as (select c_custkey md5, case c_custkey % 5 when 0 then c_custkey * 2 + 4 when 1 then c_custkey * 2 + 1 else c_custkey * 2 end raw, case when c_custkey % 7 = 0 then null when c_custkey % 4 = 0 then 'other' else c_mktsegment end poster from customer)
select case when s.md5 is not null and i.poster is not null and i.poster is distinct from s.poster then 'poster_mismatch' when h.holder is not null and h.holder <> i.md5 then 'raw_md5_conflict' when s.md5 is not null and s.raw <> i.raw then 'raw_md5_mismatch' when s.md5 is not null then 'replaced' else 'inserted' end state, count(*) n
from i left join s using (md5) left join h on h.raw = i.raw group by 1""")
def conflict_upserts(t):
    """A record is replaced by its own poster only; each conflict has its kind."""
    k = F.col("c_custkey")
    stored = t("customer").where("c_custkey % 3 <> 0").select(k.alias("md5"), (k * 2).alias("raw_md5"), F.col("c_mktsegment").alias("poster"))
    raw = F.when(k % 5 == 0, k * 2 + 4).when(k % 5 == 1, k * 2 + 1).otherwise(k * 2)
    poster = F.when(k % 7 == 0, None).when(k % 4 == 0, "other").otherwise(F.col("c_mktsegment"))
    return writes.conditional_upserts(stored, t("customer").select(k.alias("md5"), raw.alias("raw_md5"), poster.alias("poster"))).groupBy("state").agg(F.count("*").alias("n"))


@query("""select w.k, case when s_nationkey = 7 then 70 else s_nationkey end as md5, case when s_nationkey is null then 'failed' when s_nationkey = 7 then 'done' else 'skipped' end state from (select distinct l_suppkey + l_linenumber as k from lineitem) w left join supplier on s_suppkey = k""")
def bulk_repoint(t):
    """Index rows that name one file are pointed at another one."""
    wanted = t("lineitem").select((F.col("l_suppkey") + F.col("l_linenumber")).alias("k")).distinct()
    index = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("md5"))
    return writes.repointed(index, wanted, "k", "md5", F.lit(7), F.lit(70))


@query("""with f as (select user_id, min(event_id) filter (event_type = 'error' and value < 30) first from events group by 1) select state, count(*) n, sum(event_id) ids from (select event_id, case when first is null or event_id < first then 'sent' when event_id = first then 'failed' else 'left out' end state from events join f using (user_id)) group by 1""")
def stop_after_failure(t):
    """Nothing of a partition is sent after its first failure in a pass."""
    r = writes.until_refused(t("events"), "user_id", "event_id", (F.col("event_type") == "error") & (F.col("value") < 30))
    return r.groupBy("state").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("""select coalesce(reason, 'ok') reason, ok, count(*) n from (select reason, reason is null ok from (select case when source = '' then 'source is missing' when ns = '' then 'ns is missing' when filename = '' then 'filename is missing' when not regexp_matches(ns, '^[a-z0-9]{1,10}\\z') then 'namespace'
when lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)) not in ('png', 'jpg') then 'extension' when doc_id % 11 = 3 then 'posted_at is not a date' end reason
from (select doc_id, case when doc_id % 13 = 0 then '' else source end source, case when doc_id % 17 = 0 then 'Not Legal' when doc_id % 19 = 0 then '' else lang end ns, case when doc_id % 5 = 0 then 'x' || doc_id || '.gif' when doc_id % 23 = 1 then '' else 'x' || doc_id || '.PNG' end filename from documents))) group by 1, 2""")
def sidecars(t):
    """Sidecar rows, or the first reason why there can be none."""
    i = F.col("doc_id")
    rows = t("documents").select(
        i, F.when(i % 13 == 0, "").otherwise(F.col("source")).alias("source"), F.when(i % 17 == 0, "Not Legal").when(i % 19 == 0, "").otherwise(F.col("lang")).alias("ns"),
        F.when(i % 5 == 0, F.concat(F.lit("x"), i.cast("string"), F.lit(".gif"))).when(i % 23 == 1, "").otherwise(F.concat(F.lit("x"), i.cast("string"), F.lit(".PNG"))).alias("filename"),
        F.try_to_timestamp(F.when(i % 11 == 3, "soon").otherwise("2024-05-01 10:00:00")).alias("posted"),
    )
    out = writes.sidecars(rows, ["source"], "ns", ["png", "jpg"], F.col("posted"))
    return out.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason"), "ok").agg(F.count("*").alias("n"))


@query("""with o as (select 'k' || lpad(o_orderkey::varchar, 9, '0') as key, case when o_orderkey % 10 <> 4 then o_custkey end md5, o_orderkey % 50 raw, case when o_orderstatus = 'P' then 'gone' else 'kept' end state, o_orderkey from orders where o_orderkey > 100 order by 1 limit 400)
select key, case when o_orderkey % 97 = 1 then 'STOP' when md5 is null then 'ERR' when state = 'gone' then 'DROP' when c_custkey is null and s_suppkey is null then 'KEEP' else 'ALIAS' end status,
case when o_orderkey % 97 <> 1 and md5 is not null and state <> 'gone' then coalesce(c_custkey, s_suppkey) end post, case when o_orderkey % 97 <> 1 and md5 is not null and state <> 'gone' then case when c_custkey is not null then 'stripped' when s_suppkey is not null then 'raw' end end via
from o left join (select c_custkey from customer where c_acctbal > 4000) on c_custkey = md5 left join (select s_suppkey from supplier) on s_suppkey = raw""")
def alias_report(t):
    """A resumable page of index rows with what a report would say of each."""
    k = F.col("o_orderkey")
    index = t("orders").where("o_orderkey > 100").select(F.concat(F.lit("k"), F.lpad(k.cast("string"), 9, "0")).alias("key"), F.when(k % 10 != 4, F.col("o_custkey")).alias("md5"), (k % 50).alias("raw_md5"), F.when(F.col("o_orderstatus") == "P", "gone").otherwise("kept").alias("state"))
    one = t("customer").where("c_acctbal > 4000").select(F.col("c_custkey").alias("md5"), F.col("c_custkey").alias("post"))
    two = t("supplier").select(F.col("s_suppkey").alias("raw_md5"), F.col("s_suppkey").alias("post"))
    return writes.alias_report(index, one, two, F.lit(True), F.substring("key", 2, 9).cast("long") % 97 == 1, 400)


@query("""with p as (select c_custkey md5, c_custkey * 10 post, c_custkey % 3 variants from customer where c_acctbal > 2000), i as (select o_orderkey as key, o_custkey md5 from orders),
c as (select key, j as i, (md5 + j * 7) % 400 as md5 from i, (select unnest(range(0, 3)) j)), o as (select key, min((i, post))[2] other from c join p using (md5) where variants > 0 group by 1)
select via, count(*) n, sum(post) posts from (select key, coalesce(p.post, other) post, case when p.post is not null then 'own' when other is not null then 'candidate' end via from i left join p using (md5) left join o using (key)) group by 1""")
def holding_posts(t):
    """The post that holds a row: by its digest, else by the first candidate with variants."""
    posts = t("customer").where("c_acctbal > 2000").select(F.col("c_custkey").alias("md5"), (F.col("c_custkey") * 10).alias("post"), (F.col("c_custkey") % 3).alias("variants"))
    index = t("orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("md5"))
    candidates = index.select("key", F.posexplode(F.array(*((F.col("md5") + j * 7) % 400 for j in range(3)))).alias("i", "md5"))
    return writes.held_by(index, candidates, posts).groupBy("via").agg(F.count("*").alias("n"), F.sum("post").alias("posts"))


@query("""select d.doc_id from documents d where lang = 'en' and md5(text) not in (select md5(text) from documents where lang <> 'en' or n_chars > 5000) and source in (select source from documents where n_chars > 9000)""")
def nobodys_files(t):
    """Copies that are nobody's one file: an anti join on the digest inside a scope."""
    d = t("documents").withColumn("digest", F.md5("text"))
    others = d.where("lang <> 'en' or n_chars > 5000").select("digest")
    scope = d.where("n_chars > 9000").select("source")
    return joins.in_scope(d.where("lang = 'en'"), (scope, "source")).join(others, "digest", "left_anti").select("doc_id")


@query("""select doc_id from documents where md5(text) in (select md5(text) from documents where n_chars > 2000 and not (source = 'src4')) and doc_id % 2 = 0""")
def parked_if_flagged(t):
    """Rows whose digest is flagged and not banished."""
    d = t("documents").withColumn("digest", F.md5("text"))
    flagged = d.where("n_chars > 2000 and not (source = 'src4')").select("digest")
    return d.where("doc_id % 2 = 0").join(flagged, "digest", "left_semi").select("doc_id")


@query("""select event_id, user_id from events where user_id in (select c_custkey from customer) and event_type = 'purchase' and coalesce(json_extract_string(props, '$.k'), '') <> ''""")
def own_rows(t):
    """State rows that name a post and were sent by the own account."""
    own = t("customer").select(F.col("c_custkey").alias("user_id"))
    rows = t("events").where((F.col("event_type") == "purchase") & F.get_json_object("props", "$.k").isNotNull())
    return rows.join(own, "user_id", "left_semi").select("event_id", "user_id")


@query("""select event_id, event_type, user_id from events""")
def public_projection(t):
    """What of a stored row is public: not the value, not the properties, not the time."""
    return t("events").drop("value", "props", "ts")


@query("""select kind, count(*) n, count(*) filter (n_chars > 2000) large, sum(n_chars) chars from (select n_chars, case when lang = 'en' then 'canon' when lang = 'de' then 'skipped' else 'failed' end kind from documents) group by 1""")
def tool_summary(t):
    """Counters of a batch tool by kind."""
    lang = F.col("lang")
    kind = F.when(lang == "en", "canon").when(lang == "de", "skipped").otherwise("failed")
    return t("documents").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 2000).alias("large"), F.sum("n_chars").alias("chars"))


@query("""select source, count(*) filter (first) as seen, count(*) filter (not first) repeats, string_agg(distinct case when lang in ('de', 'fr') then lang end, ',' order by lang) failed from (select source, lang, row_number() over (partition by source, md5(text) order by doc_id) = 1 as first from documents) group by 1""".replace("string_agg(distinct case when lang in ('de', 'fr') then lang end, ',' order by lang) failed", "coalesce(array_to_string(list_sort(list_distinct(list(lang) filter (lang in ('de', 'fr')))), ','), '') failed"))
def distinct_repeats(t):
    """Distinct texts of each source, repeats apart, and its failed languages, sorted."""
    d = t("documents").groupBy("source", F.md5("text").alias("digest")).agg(F.count("*").alias("k"), F.collect_set(F.when(F.col("lang").isin("de", "fr"), F.col("lang"))).alias("failed"))
    return d.groupBy("source").agg(F.count("*").alias("seen"), F.sum(F.col("k") - 1).alias("repeats"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("failed")))), ",").alias("failed"))


@query("""select why, old, new from (select old, new, case when old <= 0 or new <= 0 then 'not positive' when old = new then 'itself' when count(*) over (partition by old) > 1 then 'twice' when new in (select s_suppkey + s_suppkey % 3 - 1 from supplier) then 'chain' end as why
from (select s_suppkey + s_suppkey % 3 - 1 as old, case when s_suppkey % 5 = 0 then s_suppkey + s_suppkey % 3 - 1 when s_suppkey % 7 = 0 then -1 else s_suppkey * 40 end as new from supplier)) where why is not null""".replace("select why, old, new from", "select why as reason, old, new from"))
def faulty_pairs(t):
    """Pairs that break a rule: not positive, equal, a retired key twice, a survivor that is retired too."""
    s = F.col("s_suppkey")
    old = s + s % 3 - 1
    pairs = t("supplier").select(old.alias("old"), F.when(s % 5 == 0, old).when(s % 7 == 0, -1).otherwise(s * 40).alias("new"))
    return joins.faulty_pairs(pairs, "old", "new")




@query("""select doc_id, case when ext not in ('.png', '.jpg') then 'not an image' when n_chars > 12000 then 'too large' when kind not in (0, 5) then 'no text channel' end as refused from (select doc_id, n_chars, case doc_id % 5 when 0 then '.gif' when 1 then '' else '.png' end ext, doc_id % 3 * 5 as kind from documents)""")
def accepted_rows(t):
    """What a deliverer accepts: extension, size and channel kind, the first reason against it."""
    i = F.col("doc_id")
    name = F.concat(F.lit("f"), F.when(i % 5 == 0, ".GIF").when(i % 5 == 1, "").otherwise(".PNG"))
    ext = names.extension_of(name)
    refused = messages.first_reason((ext.isin(".png", ".jpg"), "not an image"), (F.col("n_chars") <= 12_000, "too large"), ((i % 3 * 5).isin(0, 5), "no text channel"))
    return t("documents").select("doc_id", refused.alias("refused"))


@query("""with h as (select user_id, event_type, max(event_id) as last from events group by 1, 2), r as (select *, row_number() over (order by last desc) r from h) select user_id, event_type, last from r where r <= 40""")
def held_rows(t):
    """Held writes, one for a key, the newest 40: the oldest are let go."""
    held = rollup.latest(t("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])
    return held.orderBy(F.desc("event_id")).limit(40).select("user_id", "event_type", F.col("event_id").alias("last"))


@query("""select k, max(n) as n, string_agg(distinct w, '' order by w) writers from (select user_id k, count(*) n, 'a' w from events where event_type in ('click', 'view') group by 1 union all select user_id, count(*), 'b' from events where event_type in ('view', 'error') group by 1) group by 1""")
def merged_writers(t):
    """States of two writers of one outbox: the union of their keys, the further count of each."""
    of = lambda w, *kinds: t("events").where(F.col("event_type").isin(*kinds)).groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("n")).withColumn("w", F.lit(w))
    both = of("a", "click", "view").union(of("b", "view", "error"))
    return both.groupBy("k").agg(F.max("n").alias("n"), F.array_join(F.array_sort(F.collect_set("w")), "").alias("writers"))


@query("""select doc_id, md5(text) hex, to_base64(unhex(md5(text))) coded from documents""")
def digests(t):
    """The digest of a text as hexadecimal digits and as base 64."""
    return t("documents").select("doc_id", F.md5("text").alias("hex"), F.base64(F.unhex(F.md5("text"))).alias("coded"))
