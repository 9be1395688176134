"""Queries of the text rules: prompt terms, strengths, redaction, names, claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import messages, names, prompts, redact
from corvane.functions import text as fx
from corvane.functions.prompts import WS
from corvane.plans.registry import query


def _blank(x: str) -> str:
    return f"(regexp_replace({x}, '{WS}', '', 'g') = '')"


def _spelled(x: str) -> str:
    for pattern, new in prompts.SPELLING:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new}', 'g')"
    return x


_QUALITY = ", ".join(f"'{x}'" for x in prompts.QUALITY)
_TERMS = f"""
a as (select doc_id, replace(replace(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\\bBREAK\\b', ',', 'g'), '\\(', chr(1)), '\\)', chr(2)) x from documents),
b as (select doc_id, unnest(string_split(x, ',')) t, generate_subscripts(string_split(x, ','), 1) i from a),
c as (select *, regexp_extract_all(t, '{prompts.GROUP}') g, string_split_regex(t, '{prompts.GROUP}') p from b),
d as (select doc_id, i, case when len(g) = 0 or (len(g) = 1 and {_blank('p[2]')} and ({_blank('p[1]')} or not regexp_matches(g[1], '{prompts.WEIGHTED_GROUP}'))) then [t]
 else list_concat(flatten(list_transform(range(1, len(g) + 1), lambda k: case when {_blank('p[k]')} then [g[k]] else [p[k], g[k]] end)), case when {_blank('p[len(g) + 1]')} then [] else [p[len(g) + 1]] end) end q from c),
e as (select doc_id, i, unnest(q) t, generate_subscripts(q, 1) j from d),
f as (select doc_id, i, j, regexp_replace(t, ':{WS}*[0-9.]+({WS}*[)\\]}}]|{WS}*\\z)', '\\1', 'g') t from e),
g as (select doc_id, i, j, case when regexp_matches(t, '{prompts.QUALIFIED}') and not regexp_matches(regexp_extract(t, '{prompts.QUALIFIED}', 2), '{prompts.NUMBER_IN_BRACKETS}') then regexp_replace(t, '{prompts.QUALIFIED}', '\\1 ' || chr(1) || '\\2' || chr(2)) else t end t from f),
h as (select doc_id, i, j, lower(translate(regexp_replace(regexp_replace(t, '[()\\[\\]{{}}]', ' ', 'g'), '\\\\+', ' ', 'g'), chr(1) || chr(2), '()')) t from g),
k as (select doc_id, i, j, {_spelled('t')} t from h),
l as (select doc_id, t, min((i, j)) seen from k where length(t) between 2 and 60 and not regexp_matches(t, '{prompts.NUMBER}') group by 1, 2),
m as (select *, case when regexp_matches(t, '{prompts.QUALIFIED_NAME}') then 'offered' when regexp_matches(t, '{prompts.LEGACY_NAME}') then 'declared' end kind, t in ({_QUALITY}) quality from l),
n as (select *, case when kind = 'declared' then 'name' when quality then 'meta' else 'tag' end bucket from m),
o as (select *, row_number() over (partition by doc_id, bucket order by seen) r from n)"""


@query(f"""with {_TERMS}, p as (select doc_id, count(*) filter (bucket = 'tag' and r <= 60) tags, count(*) filter (bucket = 'meta') meta, count(*) filter (bucket = 'name' or (kind = 'offered' and bucket = 'tag' and r <= 60)) names,
string_agg(t, ' ' order by seen) filter (bucket = 'tag' and r <= 60) said from o group by 1)
select d.doc_id, coalesce(tags, 0) tags, coalesce(meta, 0) meta, coalesce(names, 0) names, md5(coalesce(said, '')) digest from documents d left join p using (doc_id)""")
def prompt_terms(t):
    """Terms of whole texts, routed into at most 60 tags, quality words and names; none leaves its row."""
    # the explode of one element keeps the struct from being computed anew for each of its fields
    r = t("documents").select("doc_id", F.explode(F.array(prompts.routed(F.col("text")))).alias("r"))
    size = lambda c: F.size(f"r.{c}").cast("long")
    return r.select("doc_id", size("tags").alias("tags"), size("meta").alias("meta"), size("characters").alias("names"), F.md5(F.array_join("r.tags", " ")).alias("digest"))


_TRIM = f"^{WS}+|{WS}+\\z"
_T = f"regexp_replace(coalesce(text, ''), '{_TRIM}', '', 'g')"
_MARKED = "(" + " or ".join(f"regexp_matches(t, '{p}')" for p in prompts.MARKERS) + f" or (regexp_matches(t, '{prompts.STEPS}') and regexp_matches(t, '{prompts.SETTINGS}')))"
_STRENGTH = f"""case when {_MARKED} or regexp_matches(t, '{prompts.STRONG_WORDS[0]}') or regexp_matches(t, '{prompts.STRONG_WORDS[1]}') then 'strong'
when regexp_matches(t, '{prompts.LOOSE_WORDS[0]}') or regexp_matches(t, '{prompts.LOOSE_WORDS[1]}') or (len(parts) >= 4 and len(list_filter(parts, lambda x: length(x) > 64 or len(string_split_regex(x, '{WS}+')) > 6)) = 0) then 'loose' else 'none' end"""


# every fifth text gets settings or weights, every seventh is cut into short terms
_DRESSED = """(select doc_id, source, case when doc_id % 5 = 0 then text || chr(10) || 'Negative prompt: blurry' when doc_id % 5 = 1 then text || ' (soft light:1.2)' when doc_id % 7 = 2 then replace(text, ' ', ', ') else text end as text from documents)"""


def _dressed(t):
    text = F.col("text")
    new = F.when(F.col("doc_id") % 5 == 0, F.concat(text, F.lit("\nNegative prompt: blurry"))).when(F.col("doc_id") % 5 == 1, F.concat(text, F.lit(" (soft light:1.2)")))
    new = new.when(F.col("doc_id") % 7 == 2, F.replace(text, F.lit(" "), F.lit(", "))).otherwise(text)
    return t("documents").select("doc_id", "source", new.alias("text"))


@query(f"select strength, count(*) n from (select {_STRENGTH} strength from (select t, list_filter(list_transform(string_split(t, ','), lambda x: regexp_replace(x, '{_TRIM}', '', 'g')), lambda x: x <> '') parts from (select {_T} t from {_DRESSED}))) group by 1")
def strength_levels(t):
    return _dressed(t).groupBy(prompts.strength(F.col("text")).alias("strength")).agg(F.count("*").alias("n"))


@query(f"""select source, strength, count(*) n from (select source, case when source = 'src0' then 'strong' when source in ('src1', 'src2') then {_STRENGTH} when {_MARKED} then 'strong' else 'none' end strength
from (select source, t, list_filter(list_transform(string_split(t, ','), lambda x: regexp_replace(x, '{_TRIM}', '', 'g')), lambda x: x <> '') parts from (select source, {_T} t from {_DRESSED}))) group by 1, 2""")
def keyword_strengths(t):
    """Strength by the keyword of a chunk: here the source, one a generator's, two shared."""
    level = prompts.keyword_strength(F.col("source"), F.col("text"), ["src0"], ["src1", "src2"])
    return _dressed(t).groupBy("source", level.alias("strength")).agg(F.count("*").alias("n"))


_KEYWORDS = ("Comment", "Source", "seed", "graph", "Title", "exif:UserComment", "my_prompt", "exif:Model")


@query(f"""with d as (select doc_id, doc_id // 4 as file, doc_id % 4 as i, {list(_KEYWORDS)}[doc_id % 8 + 1] as keyword, text from {_DRESSED}),
x as (select file, bool_or(keyword = 'Source' and file % 3 = 0) as novel from d group by 1),
s as (select doc_id, file, keyword, novel, t, list_filter(list_transform(string_split(t, ','), lambda x: regexp_replace(x, '{_TRIM}', '', 'g')), lambda x: x <> '') parts from (select d.*, novel, {_T} t from d join x using (file)))
select keyword, strength, count(*) n from (select keyword, case when keyword = 'seed' and file % 5 = 1 then 'strong' when novel and keyword in ('Comment', 'Source') then 'strong' when keyword in ('Comment', 'exif:UserComment') then {_STRENGTH}
when {_MARKED} then 'strong' when keyword = 'graph' and file % 4 = 0 then 'strong' when keyword = 'my_prompt' and t <> '' then 'loose' else 'none' end strength from s) group by 1, 2""")
def chunk_strengths(t):
    """Four texts as the chunks of a file: some files are known by their software, a setting or a graph; EXIF fields come mirrored."""
    i, text = F.col("doc_id"), F.col("text")
    file, keyword = F.floor(i / 4), F.element_at(F.array(*map(F.lit, _KEYWORDS)), (i % 8 + 1).cast("int"))
    mirrored = F.concat(F.lit("UNICODE..."), F.regexp_replace(text, "(?s)(.)", "$1."))
    said = F.when(keyword.startswith("exif:"), mirrored).when((keyword == "Source") & (file % 3 == 0), F.concat(F.lit("NovelAI "), text)).when((keyword == "graph") & (file % 4 == 0), F.to_json(F.struct(text.alias("t")))).otherwise(text)
    d = _dressed(t).select(file.alias("file"), F.struct(i.alias("i"), keyword.alias("keyword"), said.alias("text")).alias("c"))
    files = d.groupBy("file").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    chunk = lambda k, v: F.struct(F.lit(-1).cast("long").alias("i"), F.lit(k).alias("keyword"), F.lit(v).cast("string").alias("text"))
    more = F.array_compact(F.array(F.when(F.col("file") % 5 == 1, chunk("clip_skip", None)), F.when(F.col("file") % 4 == 0, chunk("workflow", '{"nodes": []}'))))
    every = files.select(F.concat(more, "cs").alias("cs"))
    out = every.select(F.explode(F.arrays_zip("cs", prompts.chunk_strengths(F.col("cs")).alias("s"))).alias("x")).where("x.cs.i >= 0")
    return out.groupBy(F.col("x.cs.keyword").alias("keyword"), F.col("x.s").alias("strength")).agg(F.count("*").alias("n"))


_BLANK = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


@query(rf"""select doc_id, md5(regexp_replace(case doc_id % 5 when 2 then case when length(text) >= 12 then text else 'a plain text' end when 4 then 'plain ' || text else text end, '^{_BLANK}|{_BLANK}\z', '', 'g')) digest from documents""")
def prompt_sources(t):
    """The prompt out of settings text, a node graph, a JSON comment or a description."""
    text, kind = F.col("text"), F.col("doc_id") % 5
    graph = F.to_json(F.create_map(F.lit("3"), F.struct(F.lit("CLIPTextEncode").alias("class_type"), F.create_map(F.lit("text"), text).alias("inputs")), F.lit("7"), F.struct(F.lit("cliptextencodeXL").alias("class_type"), F.create_map(F.lit("text"), F.lit("a plain text")).alias("inputs")), F.lit("1"), F.struct(F.lit("Loader").alias("class_type"), F.create_map(F.lit("text"), F.concat(text, text)).alias("inputs"))))
    none = F.lit(None).cast("string")
    chunks = F.map_from_arrays(
        F.array(*map(F.lit, ("parameters", "prompt", "Comment", "Description"))),
        F.array(F.when(kind == 0, F.concat(text, F.lit("\nNegative prompt: x\nSteps: 3"))).when(kind == 1, F.concat(text, F.lit("\nSteps: 20, Sampler: y"))).otherwise(none), F.when(kind == 2, graph).otherwise(none), F.when(kind == 3, F.to_json(F.struct(text.alias("prompt")))).otherwise(none), F.when(kind == 4, F.concat(F.lit("plain "), text)).otherwise(none)),
    )
    return t("documents").select("doc_id", F.md5(prompts.raw_prompt(chunks)).alias("digest"))


@query("""select event_id, case when event_id % 12 in (0, 2, 5, 9) then 'parameters' when event_id % 12 in (1, 4, 6, 7) then 'prompt' when event_id % 12 in (3, 10) then 'Comment' when event_id % 12 = 8 then 'Comment,Description' else '' end as keys,
case event_id % 12 when 5 then 'a red boat' when 0 then event_type when 2 then event_type when 9 then event_type when 3 then event_type when 8 then event_type when 10 then '' when 11 then '' else 'node ' || event_type end as said from events""")
def routed_fields(t):
    """The prompt out of removed fields: keywords, then the shape of unlabelled texts (graphs bare, labelled, nested), then a labelled line, then the copy in the pixels."""
    kind, i = F.col("event_type"), F.col("event_id") % 12
    graph = F.concat(F.lit('{"1": {"class_type": "CLIPTextEncode", "inputs": {"text": "node '), kind, F.lit('", "clip": ["4", 1]}}, "2": {"class_type": "KSampler", "inputs": {"text": ["1", 0]}}}'))
    names = ("png:parameters", "png:prompt", "png:prompt", "exif:UserComment", "exif:ImageDescription", "iptc:caption", "exif:Model", "exif:UserComment", "png:stealth", "png:stealth", "png:Comment", "exif:UserComment")
    name = F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    said = F.to_json(F.struct(kind.alias("prompt")))
    value = (
        F.when(i == 1, graph).when(i == 3, said).when(i == 4, F.concat(F.lit("prompt: "), graph)).when(i == 5, F.lit("Title>Include in Image: a red boat\nmore")).when(i == 6, F.concat(F.lit("prompt:"), graph)).when(i == 7, F.concat(F.lit('{"prompt": '), graph, F.lit(', "v": 1}')))
        .when(i == 8, F.to_json(F.struct(said.alias("Comment"), F.lit("else").alias("Description"), F.lit(7).alias("Software")))).when(i == 10, F.lit('{"prompt": {"a": 1}}')).when(i == 11, F.lit('note: {"class_type": 1}')).otherwise(kind)
    )
    found = t("events").select("event_id", prompts.chunks_of(F.create_map(name, value)).alias("chunks"))
    return found.select("event_id", F.array_join(F.map_keys("chunks"), ",").alias("keys"), prompts.raw_prompt(F.col("chunks")).alias("said"))


@query("""select doc_id, md5(text) digest, md5(case when length(text) = 1 then text || '.' else text end) mirrored from documents""")
def repaired_texts(t):
    """Entities written out and read back, and a text of which every other character was zero."""
    text = F.col("text")
    written = text
    for mark, entity in (("&", "&amp;"), ("o", "&#111;"), (",", "&#x2C;"), ("<", "&lt;"), ('"', "&quot;")):
        written = F.replace(written, F.lit(mark), F.lit(entity))
    dotted = F.concat(F.lit("UNICODE..."), F.regexp_replace(text, "(?s)(.)", "$1."))
    return t("documents").select("doc_id", F.md5(prompts.xml_unescaped(written)).alias("digest"), F.md5(prompts.demirrored(dotted)).alias("mirrored"))


@query()
def redact_counts(t):
    """Addresses and agents that each text loses; look-around patterns, so no SQL."""
    return t("documents").select("doc_id", redact.scrubbed(F.col("text")).alias("x")).select("doc_id", "x.address", "x.agent", F.md5("x.text").alias("digest"))


@query()
def guarded_messages(t):
    """A secure view: denied rooms are not read, both texts of prose are redacted, all else stays as it came. Look-around patterns, so no SQL."""
    denied = t("conversations").where("conv_id % 10 = 3").select("conv_id").distinct()
    rows = t("conversations").join(denied, "conv_id", "left_anti")
    kind = F.when(F.col("role") == "system", "m.image").otherwise("m.text")
    x = messages.scrubbed_content(kind, F.col("text"), F.concat(F.lit("<p>"), "text", F.lit("</p>"))).alias("x")
    return rows.select("conv_id", "turn", x).select("conv_id", "turn", F.md5("x.body").alias("body"), F.md5("x.formatted").alias("formatted"), "x.address", "x.agent")


_FOLD = "regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(lower(name), '[^a-z0-9.-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+\\z', '', 'g'), 1, 40), '_+\\z', '')"
_LEGAL = "(length(name) between 1 and 64 and regexp_matches(name, '^[a-z0-9._-]+\\z') and not starts_with(name, '_') and not ends_with(name, '_') and not contains(name, '__'))"
_NAMED = """(select c_custkey, case c_custkey % 4 when 0 then lower(replace(c_name, '#', '.')) when 1 then c_name when 2 then '_' || lower(c_name) else 'x__' || c_mktsegment end name,
case when c_custkey % 5 = 0 then cast(c_custkey as varchar) else '1' || lpad(cast(c_custkey as varchar), 17, '0') end id from customer)"""


def _named(t):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.lower(F.replace("c_name", F.lit("#"), F.lit(".")))).when(k % 4 == 1, F.col("c_name")).when(k % 4 == 2, F.concat(F.lit("_"), F.lower("c_name"))).otherwise(F.concat(F.lit("x__"), F.col("c_mktsegment")))
    ident = F.when(k % 5 == 0, k.cast("string")).otherwise(F.concat(F.lit("1"), F.lpad(k.cast("string"), 17, "0")))
    return t("customer").select("c_custkey", name.alias("name"), ident.alias("id"))


@query(f"select c_custkey, case when {_LEGAL} then name when regexp_matches(id, '^[0-9]{{17,20}}\\z') then coalesce(nullif({_FOLD}, ''), 'user') || '_' || id end tag from {_NAMED}")
def folded_names(t):
    return _named(t).select("c_custkey", names.creator_name(F.col("name"), F.col("id")).alias("tag"))


@query(f"""select c_custkey, case when regexp_matches(prefix, '^[a-z0-9]{{1,16}}\\z') and prefix not in ('automobile') and tag is not null then prefix || '_' || tag end tag, local from
(select c_custkey, prefix, case when {_LEGAL} then name when regexp_matches(id, '^[0-9]{{17,20}}\\z') then coalesce(nullif({_FOLD}, ''), 'user') || '_' || id end tag,
case when regexp_matches(name, '^[a-z0-9._-]+\\z') and c_custkey % 3 <> 0 then name end as local from (select n.*, case when c_custkey % 6 = 0 then 'Not Legal' else (select lower(c_mktsegment) from customer c where c.c_custkey = n.c_custkey) end prefix from {_NAMED} n))""")
def creator_tags(t):
    """prefix_name tags of outside accounts, and the local part of an own account's address; reserved prefixes give none."""
    rows = _named(t).join(t("customer").select("c_custkey", F.lower("c_mktsegment").alias("segment")), "c_custkey")
    prefix = F.when(F.col("c_custkey") % 6 == 0, "Not Legal").otherwise(F.col("segment"))
    address = F.concat(F.lit("@"), F.col("name"), F.lit(":"), F.when(F.col("c_custkey") % 3 == 0, "else.where").otherwise("own.host"))
    own = names.local_part(address, "own.host")
    legal = F.when(own.rlike(r"^[a-z0-9._-]+\z"), own)
    return rows.select("c_custkey", names.creator_tag(names.creator_name(F.col("name"), F.col("id")), prefix, ["automobile"]).alias("tag"), legal.alias("local"))


@query("""select page_id, regexp_replace(url, '[?#].*$', '') plain, 'GET ' || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)?', 1), ''), '/') || ' -> ' || (400 + page_id % 100) failure,
case when contains(url, '.') and regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\.[^./]*)$', 1) <> '' then lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\.[^./]*)$', 1)) else '' end extension,
coalesce(regexp_matches(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\.[^./]*)$', 1)), '^\\.(html?|png|jpe?g)$'), false) allowed, try_cast(nullif(regexp_extract(url, '/([0-9]+)(?:[?#].*)?$', 1), '') as bigint) as id from pages""")
def url_parts(t):
    """Parts of an address: without its query, as an error text, its extension and whether that is allowed, an id at its end."""
    url = F.col("url")
    plain = fx.without_query(url)
    ext = names.extension_of(plain)
    failure = names.failure(F.lit("GET"), url, (400 + F.col("page_id") % 100).cast("string"))
    return t("pages").select("page_id", plain.alias("plain"), failure.alias("failure"), ext.alias("extension"), ext.rlike(r"^\.(html?|png|jpe?g)$").alias("allowed"), names.id_at_end(url).alias("id"))


@query("""select doc_id, substr(md5(text), 1, 2) || '/' || substr(md5(text), 3, 2) || '/' || md5(text) || '/source.bin' as key from documents""")
def sharded_keys(t):
    """The path of each text under two levels of its digest."""
    return t("documents").select("doc_id", names.sharded(F.md5("text"), "source.bin").alias("key"))


@query("""with a as (select substr(md5(text), 1, 2) || '/' || substr(md5(text), 3, 2) || '/' || md5(text) || '/source.bin' path from documents where lang = 'en' union all select 'records/' || md5(text) || '.json' from documents where n_chars > 1000 union all select 'records/README' )
select distinct regexp_extract(path, '([0-9a-f]{32})', 1) as id from a where regexp_matches(path, '[0-9a-f]{32}')""")
def listed_ids(t):
    """Ids out of two listings of sharded paths, each once."""
    d = t("documents")
    sources = d.where("lang = 'en'").select(names.sharded(F.md5("text"), "source.bin").alias("path"))
    records = d.where("n_chars > 1000").select(F.concat(F.lit("records/"), F.md5("text"), F.lit(".json")).alias("path"))
    return names.ids_of(sources.union(records))


@query("""with l as (select conv_id, turn, unnest(string_split_regex(text, '[.!?]')) x, generate_subscripts(string_split_regex(text, '[.!?]'), 1) i from conversations where role = 'user'),
w as (select conv_id, turn, i, list_filter(string_split_regex(trim(x, ' '), '\\s+'), lambda y: y <> '') ws from l)
select conv_id, turn, count(*) filter (len(ws) > 0) commands, min((i, lower(ws[1])))[2] first, count(*) filter (len(ws) > 1 and length(ws[2]) > 4) as with_argument from w where len(ws) > 0 group by 1, 2""")
def parsed_commands(t):
    """Each sentence as a command line: its verb, and whether an argument follows."""
    lines = names.commands(t("conversations").where("role = 'user'").select("conv_id", "turn", "text"), "text", "[.!?]")
    return lines.groupBy("conv_id", "turn").agg(F.count("*").alias("commands"), F.min(F.struct("i", "verb"))["verb"].alias("first"), F.count_if(F.length("argument") > 4).alias("with_argument"))


@query("""select event_id, case event_id % 3 when 0 then 'k' || coalesce(json_extract_string(props, '$.k'), '0') when 1 then event_type || '; later' else 'unknown' end reasons from events""")
def refusal_reasons(t):
    """The reasons of a refusal, whichever of three JSON shapes it came in."""
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))
    one = F.to_json(F.struct(F.concat(F.lit("k"), k).alias("message")))
    many = F.to_json(F.struct(F.struct(F.array(F.col("event_type"), F.lit("later")).alias("base")).alias("errors")))
    body = F.when(F.col("event_id") % 3 == 0, one).when(F.col("event_id") % 3 == 1, many).otherwise("not json")
    return t("events").select("event_id", names.reasons(body).alias("reasons"))


@query("""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') iso, round((select max(epoch_us(ts) // 1000) from events) / 1000.0 - epoch_us(ts) // 1000 / 1000.0)::bigint age_s, case when event_id % 4 = 1 then null else strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') end said,
cast(least(5000 * pow(2, event_id % 9), 300000) as bigint) retry, cast(least(1000 * pow(2, event_id % 9), 30000) as bigint) resume, crc32 from (select *, cast(null as bigint) crc32 from events)""".replace(", crc32 from (select *, cast(null as bigint) crc32 from events)", " from events"))
def clock_values(t):
    """Times as ISO texts, never guessed; ages in whole seconds; two capped schedules."""
    e = t("events").select("event_id", "ts", fx.epoch_ms(F.col("ts")).alias("at"))
    now = e.agg(F.max("at").alias("now"))
    iso = names.iso_time(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    said = names.iso_time(F.when(F.col("event_id") % 4 == 1, "next tuesday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    n = F.col("event_id") % 9 + 1
    return e.join(F.broadcast(now)).select("event_id", iso.alias("iso"), F.round((F.col("now") - F.col("at")) / 1000).cast("long").alias("age_s"), said.alias("said"), fx.backoff_ms(n, 5_000, 300_000).alias("retry"), fx.backoff_ms(n, 1_000, 30_000).alias("resume"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) i from documents),
p as (select *, count(*) filter (trim(x, ' ') = '') over (partition by doc_id order by i rows unbounded preceding) para from l),
q as (select *, bool_or(contains(x, 'license')) over (partition by doc_id, para) marked from p)
select doc_id, count(*) as lines, count(*) filter (regexp_matches(x, '[0-9]+ (tests|files|lines|words)|[0-9]{3}')) claims, count(*) filter (regexp_matches(x, '[0-9]+ (tests|files|lines|words)|[0-9]{3}') and not marked) flagged from q group by 1""")
def count_claims(t):
    """Lines that claim a count; a marker frees its whole paragraph."""
    return names.claims(t("documents").select("doc_id", "text"), "[0-9]+ (tests|files|lines|words)|[0-9]{3}", "license")
