"""Text rules on written cases; redaction against the same rules in Python's re."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import names, prompts, redact
from corvane.plans import registry, texts  # noqa: F401 (registers its queries)


def applied(spark, cases, rule):
    rows = spark.createDataFrame([(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cases)], "i int, x string, y string" if isinstance(cases[0], tuple) else "i int, x string")
    return [r.out for r in rows.select("i", rule.alias("out")).orderBy("i").collect()]


TERMS = {
    "Long Hair": "long_hair", "(soft light:1.25)": "soft_light", "((glow))": "glow", "[mist]": "mist", r"rin \(harbour\)": "rin_(harbour)", "rin (harbour)": "rin_(harbour)",
    "rin (0.8)": "rin_0.8", "re:start": "re:start", "moon/tide_2": "moon/tide_2", "  wide   view  ": "wide_view", "-~*@lead": "lead", "tail__": "tail", "a,b": "ab", r"(rin \(harbour\):1.1)": "rin_(harbour)", "café": "caf", "": "",
}


def test_terms(spark):
    assert dict(zip(TERMS, applied(spark, list(TERMS), prompts.normalize_term(F.col("x"))), strict=True)) == TERMS


def test_groups_stand_alone(spark):
    cases = {"(mina_oc:0) white hair": ["(mina_oc:0)", " white hair"], "rin (harbour)": ["rin (harbour)"], "(tag:1.2)": ["(tag:1.2)"], r"(rin_\(harbour\):1.1) wet hair": [r"(rin_\(harbour\):1.1)", " wet hair"], "plain": ["plain"], "one (two:1.1) three (four)": ["one ", "(two:1.1)", " three ", "(four)"]}
    assert dict(zip(cases, applied(spark, list(cases), prompts.expand_term(F.col("x"))), strict=True)) == cases


def test_routes(spark):
    text = r"masterpiece, <lora:x:1>, rin \(harbour\), tove \(mine\), oc_mina BREAK 4k, 12.5, blue sky, Blue Sky, x, " + ", ".join(f"word{i} here" for i in range(80))
    r = applied(spark, [(text, "Mine")], prompts.routed(F.col("x"), F.col("y")))[0]
    assert r.meta == ["masterpiece", "4k"]
    assert r.characters == ["rin_(harbour)", "tove_(mine)", "oc_mina"]
    assert r.tags[:2] == ["rin_(harbour)", "blue_sky"] and len(r.tags) == 60
    assert applied(spark, [(None, None), ("", None)], prompts.routed(F.col("x"), F.col("y")).getField("tags")) == [[], []]


def test_kinds(spark):
    cases = [("rin_(harbour)", "harbour", "declared"), ("rin_(harbour)", "else", "offered"), ("rin_(harbour)", None, "offered"), ("oc_rin", None, "declared"), ("rin_character_oc", None, "declared"), ("oc", None, None), ("sky", "sky", None), ("oc_rin_(a)", "b", "offered")]
    assert applied(spark, [c[:2] for c in cases], prompts.name_kind(F.col("x"), F.col("y"))) == [c[2] for c in cases]


def test_strengths(spark):
    cases = {
        "x\nNegative prompt: y": "strong", "Steps: 20, Sampler: Euler": "strong", "Steps: 20 and more": "none", '{"workflow": {}}': "strong", "a photo <lora:x:0.8> b": "strong", "(bright:1.3) room": "strong", "1girl on a hill": "strong",
        "a masterpiece of glass": "loose", "(bright:2) room": "loose", "lake, boat, summer, 2019": "loose", "lake, boat, summer": "none", "one, two, three, " + "x" * 65: "none", "one, two, three, a b c d e f g": "none", "": "none",
    }
    assert dict(zip(cases, applied(spark, list(cases), prompts.strength(F.col("x"))), strict=True)) == cases
    rule = prompts.keyword_strength(F.col("x"), F.col("y"), ["own"], ["Comment"])
    assert applied(spark, [("own", None), ("Comment", "a, b, c, d"), ("Title", "a, b, c, d"), ("Title", "(?) Negative prompt: x"), ("Title", None)], rule) == ["strong", "loose", "none", "none", "none"]


def test_repairs(spark):
    assert applied(spark, ["a &amp;lt; b &quot;c&quot; &#65;&#x42; &#x110000;"], prompts.xml_unescaped(F.col("x"))) == ['a &lt; b "c" AB &#x110000;']
    assert applied(spark, ["UNICODE..m.a.s.t.e.r", "ASCII\x00\x00plain words", "a.b.c.d.e.f", "ok\x00\x00"], prompts.demirrored(F.col("x"))) == ["master", "plain words", "abcdef", "ok"]


def test_prompt_sources(spark):
    chunks = F.create_map(F.col("x"), F.col("y"))
    graph = '{"9": {"class_type": "CLIPTextEncode", "inputs": {"text": "short"}}, "3": {"class_type": "CLIPTextEncode", "inputs": {"text": " the longer "}}, "4": {"class_type": "Load", "inputs": {"text": "xxxxxxxxxxxxxxxxxxxxxx"}}}'
    cases = [("parameters", "a\nSteps: 3"), ("parameters", "a\nSteps: 1\nNegative prompt: b"), ("prompt", graph), ("prompt", "not json"), ("Comment", '{"prompt": " c "}'), ("Comment", "text"), ("Description", " d "), ("Description", '{"prompt": "e"}')]
    assert applied(spark, cases, prompts.raw_prompt(chunks)) == ["a", "a\nSteps: 1", "the longer", "", "c", "", "d", "e"]


def test_chunk_strengths(spark):
    nodes = ("workflow", '{"nodes": []}')
    files = {
        (("own", "x"), ("parameters", None), ("Comment", "a, b, c, d"), ("Title", "a, b, c, d"), ("Title", None)): ["none", "strong", "loose", "none", "none"],
        (("Software", "NovelAI"), ("Comment", "{}"), ("Source", "v3"), ("Title", "t")): ["none", "strong", "strong", "none"],
        (("seed", "1"), ("clip_skip", None), ("width", None)): ["strong", "strong", "strong"],
        (("seed", "1"), ("Source", "camera")): ["none", "none"],
        (nodes, ("extra", " [1]"), ("extra", "[1"), ("extra", "plain")): ["strong", "strong", "none", "none"],
        (("extra", "[1]"), ("sd_prompt", "x"), ("sd_prompt", "  "), ("Workflow2", "Negative prompt: x")): ["none", "loose", "none", "strong"],
        (("exif:UserComment", "UNICODE..1.g.i.r.l."), ("exif:Model", "UNICODE..1.g.i.r.l."), ("exif:Make", "N.e.g.a.t.i.v.e. .p.r.o.m.p.t.:.")): ["strong", "none", "strong"],
        (): [],
    }
    df = spark.createDataFrame([(list(f),) for f in files], "c array<struct<keyword:string,text:string>>")
    assert [r.s for r in df.select(prompts.chunk_strengths(F.col("c")).alias("s")).collect()] == list(files.values())
    assert df.select(prompts.chunk_strengths(F.lit(None).cast(df.schema["c"].dataType)).alias("s")).first().s is None


def test_long_mirrored_texts(spark):
    n = 300_000
    got = spark.range(1).select(F.repeat(F.lit("a."), n).alias("x"), F.repeat(F.lit("ab"), n).alias("y")).select(F.length(prompts.demirrored(F.col("x"))).alias("x"), F.length(prompts.demirrored(F.col("y"))).alias("y")).first()
    assert tuple(got) == (n, 2 * n)


def test_guarded_query(spark, sf="/root/testdata/sf0.001"):
    """The secure view on the whole table, by the same rules in another engine."""
    import hashlib

    rules = [(k, re.compile(p.replace(r"\z", r"\Z"), re.A)) for k, p in redact.RULES]
    said = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf}/conversations.parquet").where("conv_id % 10 <> 3").collect()}
    rows = registry.QUERIES["guarded_messages"](spark, sf).collect()
    assert {(r.conv_id, r.turn) for r in rows} == set(said)
    for r in rows:
        texts_, n = [said[r.conv_id, r.turn].text, f"<p>{said[r.conv_id, r.turn].text}</p>"], {"address": 0, "agent": 0}
        if said[r.conv_id, r.turn].role != "system":
            for i in range(2):
                for kind, rule in rules:
                    texts_[i], k = rule.subn(redact.ADDRESS if kind == "address" else redact.AGENT, texts_[i])
                    n[kind] += k
        assert (r.address, r.agent, r.body, r.formatted) == (n["address"], n["agent"], *(hashlib.md5(x.encode()).hexdigest() for x in texts_))


SCRUBBED = {
    "see https://a.example/x?y=1 now": (1, 0, "see [address removed] now"), "mxc://own.host/abc stays": (0, 0, "mxc://own.host/abc stays"), "from 10.0.0.7:8080, twice 10.0.0.8": (2, 0, "from [address removed], twice [address removed]"),
    "at 01:54:30 it was 12:30": (0, 0, "at 01:54:30 it was 12:30"), "v6 fe80::1 and [2001:db8::2]:443": (2, 0, "v6 [address removed] and [address removed]"), "box db-web-1:3000 and localhost:99 and a.example.org:8008": (3, 0, "box [address removed] and [address removed] and [address removed]"),
    "@ann:host.org and !room:host.org": (0, 0, "@ann:host.org and !room:host.org"), "Mozilla/5.0 (X11; Linux) Gecko/20100101 Firefox/99.0 asked": (0, 1, "[user agent removed] asked"), "odd/1.2 (thing; other) end": (0, 1, "[user agent removed] end"),
    'User-Agent: "abc http://x.y"\nnext': (0, 1, "[user agent removed]\nnext"), "curl/8.1 got it": (0, 1, "[user agent removed] got it"), "plain 3.5/4 words": (0, 0, "plain 3.5/4 words"), "": (0, 0, ""),
}


def test_redaction(spark):
    out = applied(spark, list(SCRUBBED), redact.scrubbed(F.col("x")))
    assert {k: (r.address, r.agent, r.text) for k, r in zip(SCRUBBED, out, strict=True)} == SCRUBBED


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_redact_query(spark, sf):
    """The query on all texts, one after the other, by the same rules in another engine."""
    import hashlib

    rules = [(k, re.compile(p.replace(r"\z", r"\Z"), re.A)) for k, p in redact.RULES]
    texts_ = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.QUERIES["redact_counts"](spark, sf).collect()
    assert len(rows) == len(texts_) and sum(r.address for r in rows) > 10
    for r in rows:
        t, n = texts_[r.doc_id], {"address": 0, "agent": 0}
        for kind, rule in rules:
            t, k = rule.subn(redact.ADDRESS if kind == "address" else redact.AGENT, t)
            n[kind] += k
        assert (r.address, r.agent, r.digest) == (n["address"], n["agent"], hashlib.md5(t.encode()).hexdigest())


def test_names(spark):
    ident = "123456789012345678"
    cases = [("a.b-c_d", None, "a.b-c_d"), ("Deleted User", ident, f"deleted_user_{ident}"), ("_x_", ident, f"x_{ident}"), ("x__y", ident, f"x_y_{ident}"), ("日本", ident, f"user_{ident}"), ("Big", "12", None), (None, ident, f"user_{ident}"), ("a" * 65, ident, f"{'a' * 40}_{ident}"), ("a" * 64, None, "a" * 64)]
    assert applied(spark, [c[:2] for c in cases], names.creator_name(F.col("x"), F.col("y"))) == [c[2] for c in cases]
    tags = [("name", "harbour", "harbour_name"), ("name", "own", None), ("name", "Bad!", None), ("_n", "harbour", None)]
    assert applied(spark, [c[:2] for c in tags], names.creator_tag(F.col("x"), F.col("y"), ["own"])) == [c[2] for c in tags]
    assert applied(spark, ["@ann:own.host", "@ann:else", "ann", "@:own.host"], names.local_part(F.col("x"), "own.host")) == ["ann", None, None, None]
    assert applied(spark, ["2024-02-30", "2024-02-29 10:00:00", "soon", None], names.iso_time(F.col("x"))) == [None, "2024-02-29T10:00:00.000Z", None, None]
    assert applied(spark, ["https://h/posts/17", "/posts/18?x=1", "/posts/new"], names.id_at_end(F.col("x"))) == [17, 18, None]
    assert applied(spark, ['{"message": "no"}', '{"errors": {"base": ["a", "b"]}}', "<html>"], names.reasons(F.col("x"))) == ["no", "a; b", "unknown"]


def test_prompt_sources_tell_texts_from_objects_and_order_nodes_by_number(spark):
    node = lambda text, kind="CLIPTextEncode": {"class_type": kind, "inputs": {"text": text}}
    graphs = [
        ({"10": node("bb"), "9": node("aa")}, "aa"), ({"x": node("bb"), "10": node("cc")}, "cc"), ({"1": node(["2", 0]), "2": node("from two"), "3": node(7)}, "from two"),
        ({"1": node("\U0001f600\U0001f600"), "2": node("abc")}, "\U0001f600\U0001f600"), ({"1": node("a"), "2": "text", "3": None, "4": []}, "a"), ([node("one"), node("three")], "three"),
    ]
    cases = [({"prompt": json.dumps(g)}, want) for g, want in graphs]
    cases += [({"Comment": '{"prompt": {"a": 1}}', "Description": " plain "}, "plain"), ({"Description": '{"prompt": {"a": 1}}'}, ""), ({"Description": "12"}, ""), ({"prompt": "{}", "Comment": '{"prompt": " c "}'}, "c"), ({"parameters": "", "Comment": '{"prompt": "c"}'}, "")]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c map<string,string>")
    got = [r.p for r in df.select("i", prompts.raw_prompt(F.col("c")).alias("p")).orderBy("i").collect()]
    assert got == [w for _, w in cases]


def test_fields_are_routed(spark):
    graph = json.dumps({"1": {"class_type": "CLIPTextEncode", "inputs": {"text": "a node"}}})
    cases = [
        ({"exif:UserComment": f'{{"prompt": {graph}, "v": 2}}'}, {"prompt"}, "a node"), ({"exif:UserComment": f"  {graph}\n"}, {"prompt"}, "a node"), ({"exif:Model": f"prompt:{graph} "}, {"prompt"}, "a node"), ({"exif:Model": "prompt:none", "png:prompt": " bare"}, {"parameters"}, "bare"),
        ({"exif:UserComment": f"prompt: {graph}", "exif:ImageDescription": "settings\nSteps: 3"}, {"prompt", "parameters"}, "settings"), ({"exif:UserComment": f"workflow:{graph}"}, set(), ""), ({"exif:UserComment": '{"other": 1}'}, {"parameters"}, '{"other": 1}'),
        ({"png:stealth": '{"Comment": "{\\"prompt\\": \\"from pixels\\"}", "Description": 5}'}, {"Comment"}, "from pixels"), ({"png:stealth": "settings\nSteps: 2"}, {"parameters"}, "settings"), ({"png:stealth": "[undecodable 9]"}, set(), ""), ({"png:stealth": "x", "png:Description": "d"}, {"Description"}, "d"),
        ({"xmp:a": "Include in Image:  ", "xmp:b": "x&#xA; Include in image: a boat<br>"}, {"parameters"}, "a boat"), ({}, set(), ""),
    ]
    df = spark.createDataFrame([(i, f) for i, (f, _, _) in enumerate(cases)], "i int, f map<string,string>")
    for r in df.select("i", prompts.chunks_of(F.col("f")).alias("c")).select("i", "c", prompts.raw_prompt(F.col("c")).alias("p")).collect():
        assert (set(r.c), r.p) == cases[r.i][1:], cases[r.i]


def test_terms_of_long_pieces(spark):
    """A piece with more letters than a term may have is never one; one that only its other characters make long may be."""
    some = ["x" * 60, "x" * 61, "y" + " " * 90 + "z", "Ä" * 70 + "b" * 60, "(" + "c" * 59 + ":1.25)", "d" * 61 + " (e:1.2) f", "g" * 30 + "..." * 11, "\u212a" * 3, "h" * 59 + "ß" * 9 + "\\(i\\)", "<" + "j" * 80 + "> k9", "l" * 60 + "BREAK" + "m m BREAK n n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", prompts.terms(F.col("t")).alias("x")).collect()}
    assert got == {0: ["x" * 60], 1: [], 2: ["y_z"], 3: ["b" * 60], 4: ["c" * 59], 5: [], 6: [], 7: ["kkk"], 8: [], 9: ["k9"], 10: ["n_n"]}


def test_terms_do_not_work_on_pieces_that_cannot_be_any(spark):
    """Six million letters without a comma are passed over, not rewritten a dozen times."""
    assert "{61}" in str(prompts.terms(F.col("t")))
    df = spark.range(4).select(F.concat(F.repeat(F.lit("ab c"), 500_000), F.lit(", short one")).alias("t"))
    assert [r.x for r in df.select(prompts.terms(F.col("t")).alias("x")).collect()] == [["short_one"]] * 4
