"""Queries of the rules on chat messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import levels, messages
from corvane.operators import snapshots
from corvane.plans.registry import query


@query("""select event_id, user_id from events where event_type in ('click', 'purchase') and event_id % 3 <> 0 and event_id % 5 <> 1 order by ts, event_id""")
def pictures_oldest_first(t):
    """Pictures that are no edits, every one, in the order in which they were sent."""
    i = F.col("event_id")
    kind = F.when(F.col("event_type").isin("click", "purchase"), "m.room.message").otherwise("m.room.member")
    e = t("events").select("event_id", "user_id", "ts", kind.alias("kind"), F.when(i % 3 != 0, "m.image").alias("msgtype"), F.concat(F.lit("mxc://h/"), i.cast("string")).alias("url"), F.when(i % 5 == 1, "m.replace").when(i % 5 == 2, "m.thread").alias("relation"))
    return e.where(messages.is_picture(F.col("kind"), F.col("msgtype"), F.col("url"), F.col("relation"))).orderBy("ts", "event_id").select("event_id", "user_id")


@query("""select event_id, event_id % 4 in (0, 3) and event_type <> 'signup' and event_id % 8 in (0, 3, 4, 7) and event_id % 9 <> 0 and event_id % 7 <> 0 and event_id % 11 <> 0 and event_id % 13 <> 0 and event_id % 17 <> 0 and event_id % 19 <> 0 and event_id % 23 <> 0 as withheld from events""")
def withheld_content(t):
    """Messages of which each of seven parts is empty, of the two kinds that people send."""
    i = F.col("event_id")
    some = lambda n: F.when(i % n == 0, F.array(F.lit("x"))).when(i % 2 == 0, F.array().cast("array<string>"))
    kind = F.when(i % 4 == 0, 0).when(i % 4 == 3, 19).otherwise(7)
    withheld = messages.content_withheld(kind, F.when(F.col("event_type") == "signup", F.lit(True)), F.when(i % 9 == 0, "text").when(i % 2 == 1, ""), F.when(i % 7 == 0, "poll"), *(some(n) for n in (11, 13, 17, 19, 23)))
    return t("events").select("event_id", withheld.alias("withheld"))


@query("""select event_id, case event_id % 6 when 0 then 'line ' || event_id || ': bad ' || event_type || '|no line' when 1 then event_type || '|name is taken|name too long' when 2 then 'only ' || event_type when 3 then '' when 4 then 'said' else 'one field' end as reasons from events""")
def refusals(t):
    """The reasons of a refusal out of three JSON shapes, with line numbers and field names; none out of any other."""
    i, kind = F.col("event_id"), F.col("event_type")
    fill = lambda text: F.replace(F.replace(F.lit(text), F.lit("<k>"), kind), F.lit("<i>"), i.cast("string"))
    answer = (
        F.when(i % 6 == 0, fill('{"errors": [{"line": <i>, "text": "t", "reason": "bad <k>"}, {"reason": "no line", "line": "x"}, {"reason": 5}, 7], "message": "not this"}'))
        .when(i % 6 == 1, fill('{"errors": {"name": ["is taken", 3, "too long"], "base": "<k>"}}')).when(i % 6 == 2, fill('{"message": " only <k> "}'))
        .when(i % 6 == 3, "<html>").when(i % 6 == 4, '{"errors": [], "message": "said"}').otherwise('{"errors": {"script": ["one field"]}}')
    )
    return t("events").select("event_id", F.array_join(messages.refusal_reasons(answer), "|").alias("reasons"))


_BLANK = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


@query(rf"""select doc_id, case when doc_id % 3 <> 0 then len(list_filter(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]') and not regexp_matches(x, '^[{_BLANK}]*```'))) end as n_lines,
case when doc_id % 3 = 1 then 'because ' || lang when doc_id % 3 = 2 then '' end as reason from documents""")
def scripts(t):
    """Texts as scripts under a command: its reason, and the lines that are neither blank nor a fence."""
    head = F.when(F.col("doc_id") % 3 == 0, "!burn ").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("!bur because "), F.col("lang"))).otherwise("!bur")
    body = F.concat(head, F.lit("\r\n```\n"), F.col("text"), F.lit("\n```"))
    found = t("documents").select("doc_id", messages.script(body, "!bur").alias("s"))
    return found.select("doc_id", F.size("s.lines").cast("long").alias("n_lines"), F.col("s.reason").alias("reason"))


@query("""select page_id, case when page_id % 5 < 3 then page_id end as id from pages""")
def redirected_ids(t):
    """The post that a redirect names, absolute or not, with or without a suffix; no other number."""
    i = F.col("page_id").cast("string")
    host = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    place = F.when(F.col("page_id") % 5 == 0, F.concat(host, F.lit("/posts/"), i, F.lit("?q=/posts/1"))).when(F.col("page_id") % 5 == 1, F.concat(F.lit("/posts/"), i, F.lit(".json#x"))).when(F.col("page_id") % 5 == 2, F.concat(F.lit("posts/"), i)).when(F.col("page_id") % 5 == 3, F.concat(host, F.lit("/users/"), i)).otherwise(F.concat(F.lit("/posts/"), i, F.lit("/edit")))
    return t("pages").select("page_id", messages.post_id(place).alias("id"))


@query("""select event_id, case when event_id % 3 = 0 and event_id % 5 <> 0 and event_type <> 'signup' then '$' || (event_id + 1) end as original, case when event_id % 3 = 0 and event_id % 5 <> 0 and event_type <> 'signup' and event_id % 4 <> 1 then 'm' || event_id end as media, case when event_id % 3 = 0 and event_id % 5 <> 0 and event_type <> 'signup' then case when event_type = 'click' then 'expire' else 'keep' end end as old_file from events""")
def picture_edits(t):
    """Which events replace another one by a picture, the own picture that they bring, and what becomes of the old file."""
    i, kind = F.col("event_id"), F.col("event_type")
    fill = lambda text: F.replace(F.replace(F.replace(F.lit(text), F.lit("<i>"), i.cast("string")), F.lit("<j>"), (i + 1).cast("string")), F.lit("<h>"), F.when(i % 4 == 1, "else.where").otherwise("own.host"))
    relation = F.when(i % 3 == 0, fill('"m.relates_to": {"rel_type": "m.replace", "event_id": "$<j>"}')).when(i % 3 == 1, '"m.relates_to": {"rel_type": "m.replace", "event_id": 7}').otherwise('"m.relates_to": {"rel_type": "m.thread", "event_id": "$1"}')
    new = F.when(i % 5 == 0, '"m.new_content": {"msgtype": "m.text", "url": "x"}').when(kind == "signup", '"m.new_content": {"msgtype": "m.image", "url": 5}').otherwise(fill('"m.new_content": {"msgtype": "m.image", "url": "mxc://<h>/m<i>"}'))
    choice = F.when(kind == "click", '"own.choice": {"old_file": "expire"}').when(kind == "view", '"own.choice": {"old_file": "burn"}').otherwise('"own.choice": 1')
    e = t("events").select("event_id", messages.picture_edit(F.concat(F.lit("{"), F.concat_ws(", ", relation, new, choice), F.lit("}")), "own.choice").alias("x"))
    return e.select("event_id", F.col("x.original_id").alias("original"), messages.media_id(F.col("x.url"), "own.host").alias("media"), F.col("x.old_file").alias("old_file"))


@query("""select event_id, case when user_id % 7 = 0 and event_id % 3 = 0 then -1 when event_id % 5 = 0 then 0 when event_id % 2 = 0 then user_id else case when event_id % 11 = 0 then 0 else 10 end end as level, event_id % 4 <> 0 and user_id >= case when event_id % 3 = 0 then 60 when event_id % 3 = 1 then 30 else 50 end as may from events""")
def sender_levels(t):
    """A sender's level in a room: a creator's (here -1) without bound from version 12 on, a listed one, the default, 0; and whether that is enough to write."""
    i, u = F.col("event_id"), F.col("user_id")
    me, one = F.concat(F.lit("@u"), u.cast("string")), F.array(F.lit("@x"), F.when(u % 7 == 0, F.concat(F.lit("@u"), u.cast("string"))))
    users = F.when(i % 5 == 0, F.create_map(me, F.lit(None).cast("double"))).when(i % 2 == 0, F.create_map(me, u.cast("double")))
    version = F.when(i % 3 == 0, "12").when(i % 3 == 1, "11").otherwise("org.new")
    found = levels.level(users, F.when(i % 11 != 0, 10), me, version, one)
    events = F.when(i % 3 == 0, F.create_map(F.lit("tags"), F.lit(60)))
    may = levels.may_write(F.when(i % 4 != 0, F.create_map(F.lit("@me"), u)), F.lit(None), events, F.when(i % 3 == 1, 30), "@me", "tags")
    return t("events").select("event_id", F.when(found == levels.UNBOUNDED, -1).otherwise(found).cast("long").alias("level"), may["ok"].alias("may"))


@query("""select doc_id, case when doc_id % 4 <> 0 then lang end as poster, case when doc_id % 3 = 0 then null else 'prompt=' || md5(text) || case when doc_id % 3 = 1 then ',seed=' || doc_id else '' end end as fields from documents""".replace("case when doc_id % 4 <> 0 then lang end", "case when doc_id % 4 <> 0 and doc_id % 3 <> 0 then lang end"))
def kept_records(t):
    """Records of what a strip took out, without zero characters; none where it took nothing."""
    i = F.col("doc_id")
    removed = F.when(i % 3 == 0, F.create_map().cast("map<string,string>")).when(i % 3 == 1, F.create_map(F.lit("prompt"), F.concat(F.lit("\x00"), "text"), F.lit("seed"), i.cast("string"))).otherwise(F.create_map(F.lit("prompt"), F.concat("text", F.lit("\x00"))))
    d = t("documents").select("doc_id", messages.generation_record(removed, F.md5("text"), F.md5("text"), F.when(i % 4 != 0, F.col("lang")).otherwise("")).alias("r"))
    pairs = F.transform(F.map_entries("r.fields"), lambda e: F.concat_ws("=", e["key"], F.when(e["key"] == "prompt", F.md5(e["value"])).otherwise(e["value"])))
    return d.select("doc_id", F.col("r.poster").alias("poster"), F.array_join(pairs, ",").alias("fields"))


@query("""with l as (select md5(text) as md5, doc_id, n_chars > 2000 as flagged, lang = 'de' as banished from documents where doc_id % 2 = 0)
select doc_id, (select min(l.doc_id) from l where l.md5 = md5(d.text) and flagged and not banished) as post_id from documents d where exists (select 1 from l where l.md5 = md5(d.text) and flagged and not banished)""")
def parked_posts(t):
    """Rows whose bytes a flagged post holds, and that post."""
    d = t("documents").select("doc_id", F.md5("text").alias("md5"), "n_chars", "lang")
    listed = d.where("doc_id % 2 = 0").select("md5", F.col("doc_id").alias("post_id"), F.expr("n_chars > 2000").alias("flagged"), F.expr("lang = 'de'").alias("banished"))
    return snapshots.parkable(d.select("doc_id", "md5"), listed).select("doc_id", "post_id")


@query("""select event_id, user_id % 9 as room from events where event_type = 'purchase' and user_id % 9 not in (2, 5) and event_id % 40 in (select doc_id from documents where lang = 'en')""")
def own_copies(t):
    """Stored rows of certain posts that the own account wrote, outside of denied rooms."""
    e = t("events").select("event_id", (F.col("user_id") % 9).alias("room"), (F.col("event_id") % 40).alias("post_id"), F.when(F.col("event_type") == "purchase", "@me").otherwise("@else").alias("sender"))
    denied = t("events").select((F.col("user_id") % 9).alias("room")).where("room in (2, 5)").distinct()
    posts = t("documents").where("lang = 'en'").select(F.col("doc_id").alias("post_id"))
    return snapshots.own_copies(e, posts, "@me", denied).select("event_id", "room")
