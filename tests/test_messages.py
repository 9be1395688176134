"""Rules on messages, on written cases and on whole tables."""

from __future__ import annotations

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.functions import messages, redact
from corvane.functions.text import entry_id
from corvane.plans import registry, rules

NAMES = sorted(n for n, f in vars(rules).items() if n in registry.ORACLE_SQL)


@pytest.mark.parametrize("name", NAMES)
def test_queries_and_their_sql(spark, name, sf="/root/testdata/sf0.01"):
    db = duckdb.connect()
    for t in ("events", "documents", "pages"):
        db.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    found, want = registry.QUERIES[name](spark, sf), db.sql(registry.ORACLE_SQL[name])
    assert sorted(map(str, map(tuple, found.select(want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_scrubbed_messages_like_another_engine(spark, sf="/root/testdata/sf0.01"):
    patterns = [(k, re.compile(p.replace(r"\z", r"\Z"), re.A)) for k, p in redact.RULES]

    def scrub(text):
        n = {"address": 0, "agent": 0}
        for kind, p in patterns:
            text, k = p.subn(redact.ADDRESS if kind == "address" else redact.AGENT, text)
            n[kind] += k
        return text, n

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    kind = F.when(F.col("role") == "user", "m.text").when(F.col("role") == "assistant", "m.notice").otherwise("m.image")
    found = table.select("conv_id", "turn", messages.scrubbed_content(kind, F.col("text"), F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>"))).alias("x"))
    rows = {(r.conv_id, r.turn): r for r in found.select("conv_id", "turn", "x.address", "x.agent", F.md5("x.body").alias("body"), F.md5("x.formatted").alias("formatted")).collect()}
    said = table.collect()
    assert len(rows) == len(said)
    for r in said:
        (a, n), (b, m) = scrub(r.text), scrub(f"<p>{r.text}</p>")
        if r.role not in ("user", "assistant"):
            a, b, n, m = r.text, f"<p>{r.text}</p>", {"address": 0, "agent": 0}, {"address": 0, "agent": 0}
        got = rows[r.conv_id, r.turn]
        assert (got.address, got.agent, got.body, got.formatted) == (n["address"] + m["address"], n["agent"] + m["agent"], md5(a), md5(b))


def test_scripts_places_and_ids(spark):
    cases = ["!bur why not\nalias a -> b\n\n```\n  imply c  \n```x", "!bur", " !bur  spaced ", "!burn x", "say !bur", "", None, "!bur\r\na\rb"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    got = [r.s and (r.s.reason, r.s.lines) for r in df.select("i", messages.script(F.col("x"), "!bur").alias("s")).orderBy("i").collect()]
    assert got == [("why not", ["alias a -> b", "imply c"]), ("", []), ("spaced", []), None, None, None, None, ("", ["a", "b"])]
    places = {"https://h.x/posts/12": 12, "/posts/3.json?x": 3, "//h/posts/4#a": 4, "posts/5": 5, "/posts/6/": None, "/a/posts/7": None, "/posts/x": None, None: None}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(places)], "i int, x string")
    assert [r.p for r in df.select("i", messages.post_id(F.col("x")).alias("p")).orderBy("i").collect()] == list(places.values())
    assert spark.range(1).select(entry_id(F.lit("a.b-c"), F.lit("d/e_f")).alias("x")).first().x == "a_b-c-d_e_f"


def test_redacted_reasons_and_prose(spark):
    one = spark.range(1)
    answer = F.lit('{"errors": {"b": "from 10.0.0.7:8080", "a": ["x", null]}}')
    clean = lambda r: redact.scrubbed(r)["text"]
    assert one.select(messages.refusal_reasons(answer, clean).alias("r")).first().r == ["a x", "b from [address removed]"]
    got = one.select(messages.scrubbed_content(F.lit("m.text"), F.lit("10.0.0.7:1"), F.lit(None).cast("string")).alias("x")).first().x
    assert tuple(got) == ("[address removed]", None, 1, 0)
    assert tuple(one.select(messages.scrubbed_content(F.lit("m.image"), F.lit("10.0.0.7:1"), F.lit(None).cast("string")).alias("x")).first().x) == ("10.0.0.7:1", None, 0, 0)
