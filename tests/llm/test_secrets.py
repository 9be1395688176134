import hashlib
import random
import re
import string
import time

from odd import documents, empty

from corvane.llm import queries, secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


HEX = hashlib.sha256(b"x").hexdigest()
TEXTS = [
    f"Token = '{HEX}' und {HEX}",
    "secret: token: abcdefghij password=short7 API_KEY: longenough8 apikey='x.y/z+w=-_' passwd = 'tail123456",
    "AKIAABCDEFGHIJKL AKIAABCDEFGHIJK AKIAAKIAAKIAAKIA1 xAKIA0123456789ABCDE",
    "\U0001f600 é token=12345678 " + HEX[:32] + " " + HEX[:31],
    HEX + "token=" + HEX,
    "key q7Zt0vXk29LmWp4RbN8sYdEu1 and background_processing_queue_2 or internationalisation4all",
]


def test_query_base(spark, sf="/root/testdata/sf0.01"):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op10_secrets(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k + ":") for s in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r.spans.split(","))
    assert sum(r.n_assign for r in rows) > 0


def test_odd_texts_models_and_redaction(spark, sf):
    docs = documents(spark, [(100 + i, t) for i, t in enumerate(TEXTS)])
    ratios = secrets.model(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    found = secrets.secret_spans(docs, ratios, base="own_base", spans="own_spans")
    found = found.withColumn("said", secrets.described("own_spans")).withColumn("base_said", secrets.described("own_base")).withColumn("clean", secrets.redacted("text", "own_spans"))
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.base_said.split(",") == (brute(r.text or "") or [""])
        assert r.spans == "x"
        if r.text is not None and not r.own_spans:
            assert r.clean == r.text
    last = {r.doc_id: r for r in rows}
    random = [s for s in last[105].said.split(",") if s]
    assert random == ["random:4:29"]
    assert "q7Zt0" not in last[105].clean and "background_processing_queue_2" in last[105].clean
    assert last[104].clean == "[secret]"  # a random span reaches over both base spans


ALPHABETS = {
    "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "hex": "0123456789abcdef", "base36": string.ascii_lowercase + string.digits,
    "base32": string.ascii_uppercase + "234567", "letters": string.ascii_letters,
}


def drawn(seed, lengths=(16, 20, 24, 31, 48), each=40):
    r = random.Random(seed)
    return [(f"{a} {n}", "".join(r.choice(c) for _ in range(n))) for a, c in ALPHABETS.items() for n in lengths for _ in range(each)]


def identifiers(words, seed, each=150):
    r, out = random.Random(seed), []
    for _ in range(each):
        w = [r.choice(words) for _ in range(3)]
        out += ["_".join(w) + f"_{r.randrange(100)}", w[0] + w[1].title() + w[2].title() + str(r.randrange(9)), "-".join(w) + f"-{2000 + r.randrange(30)}", "".join(x.title() for x in w), "_".join(w).upper(), "/".join(w) + f"/v{r.randrange(9)}"]
    return out


def found_in(spark, model, tokens):
    df = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(tokens)], "i long, text string")
    return {r.i for r in secrets.secret_spans(df, model).collect() if any(x["kind"] == 3 or x["kind"] == 2 for x in r.spans)}


def test_random_tokens_are_found_and_identifiers_left(spark, sf="/root/testdata/sf0.01"):
    """The model sees texts with even ids only; words of the others make identifiers that it has not seen."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = secrets.model(spark, docs.where("doc_id % 2 = 0"))
    samples = drawn(1)
    found = found_in(spark, model, [t for _, t in samples])
    for kind in {k for k, _ in samples}:
        at = [i for i, (k, _) in enumerate(samples) if k == kind]
        assert len(found.intersection(at)) >= 0.9 * len(at), kind
    words = sorted({w for r in docs.where("doc_id % 2 = 1").limit(200).collect() for w in re.findall("(?<![A-Za-z])[a-z]{4,10}(?![A-Za-z])", r.text)})
    ordinary = identifiers(words, 2)
    assert len(found_in(spark, model, ordinary)) <= 0.01 * len(ordinary)


def test_query_lists_planted_tokens(spark, tmp_path, sf="/root/testdata/sf0.001"):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    planted = {100_000 + i: f"the key {t} and token={t} end" for i, (k, t) in enumerate(drawn(3, (24,), 20)) if k != "hex 24" and "/" not in t and "+" not in t}
    docs.union(spark.createDataFrame(list(planted.items()), "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op10_secrets(spark, str(tmp_path)).collect()}
    hit = [i for i in planted if "random:8:32" in rows[i].spans.split(",")]
    assert len(hit) >= 0.95 * len(planted) and all("assign:37:67" in rows[i].spans for i in planted)
    for i, t in planted.items():
        assert rows[i].base_sha256 == hashlib.sha256(",".join(brute(t)).encode()).hexdigest()
    alarms = sum("random" in r.spans for i, r in rows.items() if i < 100_000)
    assert alarms <= 2


def test_choice_of_words_does_not_follow_their_order(spark, sf="/root/testdata/sf0.1"):
    """With few hash values the chosen words' first letters are still spread like all words'."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = secrets.labelled_samples(docs, ordinary=200, drawn=0).where("token rlike '^[A-Za-z]+$'").collect()
    first = [r.token[0].lower() for r in words]
    assert len(set(first)) >= 10 and max(first.count(x) for x in set(first)) < 0.4 * len(first)


def test_long_tokens_and_many_matches_take_seconds(spark, sf):
    """A token of a million characters, and a hundred thousand matches in one text."""
    r, letters = random.Random(5), string.ascii_letters + string.digits
    long = "data " + "".join(r.choice(letters) for _ in range(1_000_000)) + " end"
    many = " ".join(f"token=abcdefgh{i:06}" for i in range(100_000))
    apart = " ".join("".join(r.choice(letters) for _ in range(24)) for _ in range(20_000))
    mixed = "\U0001f600é" * 3000 + f" key {HEX} " + "ä" * 5000 + " token=12345678 " + "x" * 9000
    docs = spark.createDataFrame(list(enumerate([long, many, apart, mixed])), "doc_id long, text string").repartition(4, "doc_id").persist()
    ratios = secrets.model(spark, docs.union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")))
    start = time.monotonic()
    rows = secrets.secret_spans(docs, ratios).withColumn("said", secrets.described("base")).withColumn("clean", secrets.redacted("text", "spans")).orderBy("doc_id").collect()
    assert time.monotonic() - start < 60
    for row in rows:
        assert row.said.split(",") == (brute(row.text) or [""])
        at, want = 0, []
        for x in sorted((x["from"], x["to"]) for x in row.spans):
            if x[0] >= at:
                want += [row.text[at : x[0]], "[secret]"]
            at = max(at, x[1])
        assert row.clean == "".join([*want, row.text[at:]])
    assert (3, 5, 1_000_005) in [tuple(x) for x in rows[0].spans] and len(rows[1].spans) >= 100_000 and len(rows[2].spans) > 19_000


def test_empty_table(spark):
    ratios = secrets.model(spark, empty(spark))
    assert secrets.secret_spans(empty(spark), ratios, base="b", spans="s").count() == 0
