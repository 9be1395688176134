"""Secret scans with DataFrame functions only.

Base kinds are regular expressions. Beside them, two first-order character Markov
models, of random strings and of ordinary identifiers, are compared by their
log-likelihood ratio on every long token; a token that looks random and does not lie
within a base span is added as kind ``random``. Both models are trained from labelled
samples: digests in several alphabets, and long words of all documents, alone and put
together as identifiers are. Words are chosen by hashes, so the choice is even over
the words at any size of the corpus.

Defined results: null texts count as empty; empty texts have no spans; texts are
scanned whole; rows are judged one by one, so repeated rows repeat their spans; an
empty table gives an empty one. Positions are code points, end exclusive. The columns
``base`` and ``spans`` replace ones of these names; give others to keep those.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import OWN, cut

# Fixed patterns of the base kinds, in the order in which kinds are listed.
_KEY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_VALUE = r"[A-Za-z0-9+/_.=-]+"
BASE = {
    "assign": _KEY + _VALUE,
    # a run of 16 characters at least is a whole match that passes the length test
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
#: Tokens that the models judge: long, with a letter and a digit or with letters of both cases inside, not cut from a longer run.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])(?:(?=[A-Za-z+/_=-]*[0-9])|(?=[A-Za-z+/_=-]*?[a-z][A-Z]))[A-Za-z0-9+/_=-]{16,}+"
#: Words that may serve as samples: long, in small letters but for the first, so that no random string of several kinds is among them.
WORD = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z][a-z]{11,}+(?![A-Za-z0-9+/_=-])"
KINDS = (*BASE, "random")
CODES = 128


#: Elements that a running total goes over before it is joined to what stands before them.
_RUN = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """At each place of an array of numbers, which isn't empty, what ``combine`` makes of them so far, from 0.

    An array that grows by one is copied each time, so it grows within short runs only.
    """

    def grown(some: Column) -> Column:
        from_0 = F.aggregate(some, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))
        return F.slice(from_0, 2, F.size(some))

    def joined(runs: Column) -> Column:
        ends = F.transform(runs, lambda r: F.element_at(r, -1))
        before = F.concat(F.array(F.lit(0)), F.slice(grown(ends), F.lit(1), F.size(runs) - 1))
        return F.flatten(F.zip_with(runs, before, lambda r, at: F.transform(r, lambda x: combine(at, x))))

    def of(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / _RUN).cast("int"))
        return _let(F.transform(starts, lambda i: grown(F.slice(own, i * _RUN + 1, _RUN))), joined)

    return _let(values, of)


def _found(text: Column, pattern: str, kind: str, passes=None) -> Column:
    """Spans of the matches, leftmost and not overlapping: what lies between them gives the places."""
    none = F.array().cast("array<struct<kind:int,from:int,to:int>>")

    def placed(matches: Column) -> Column:
        steps = F.zip_with(matches, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), lambda m, b: F.length(b) + F.length(m))
        pairs = F.zip_with(matches, _running(steps, lambda at, x: at + x), lambda m, end: F.struct(m.alias("match"), end.alias("end")))
        kept = pairs if passes is None else F.filter(pairs, lambda x: passes(x["match"]))
        return F.transform(kept, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), (x["end"] - F.length(x["match"])).alias("from"), x["end"].alias("to")))

    return F.when(F.regexp_like(text, F.lit(pattern)), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def _long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, f"^{_KEY}({_VALUE})", 1)) >= 8


def base_spans(text: Column) -> Column:
    """The base kinds' spans, by start, then kind."""
    found = [_found(text, pattern, kind, _long_value if kind == "assign" else None) for kind, pattern in BASE.items()]
    return _ordered(F.concat(*found))


def _ordered(spans: Column) -> Column:
    key = F.transform(spans, lambda s: F.struct(s["from"].alias("from"), s["kind"].alias("kind"), s["to"].alias("to")))
    return F.transform(F.array_sort(key), lambda s: F.struct(s["kind"].alias("kind"), s["from"].alias("from"), s["to"].alias("to")))


def _transitions(token: Column) -> Column:
    """Number of each pair of neighbouring characters."""

    def pairs(codes: Column) -> Column:
        n = F.greatest(F.size(codes) - 1, F.lit(0))
        return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * CODES + b)

    return _let(F.transform(F.split(token, ""), F.ascii), pairs)


def train(samples: DataFrame, weight: float = 5.0, symbols: int = 66) -> list[float]:
    """Log-likelihood ratio of each transition, from ``samples(token, random)``.

    A transition's probability backs off with ``weight`` to that of its second
    character, and that with one count to even chances. At most 2 * 128 * 128 counts
    come to the driver. Samples with characters beyond ASCII are skipped.
    """
    pairs = samples.where((F.length("token") > 1) & ~F.col("token").rlike(r"[^\x00-\x7F]")).select("random", F.explode(_transitions(F.col("token"))).alias("pair"))
    counts = {c: np.zeros((CODES, CODES)) for c in (False, True)}
    for r in pairs.groupBy("random", "pair").count().collect():
        counts[r["random"]][divmod(r["pair"], CODES)] = r["count"]
    logs = {}
    for c, n in counts.items():
        one = (n.sum(0) + 1 / symbols) / (n.sum() + 1)
        logs[c] = np.log((n + weight * one) / (n.sum(1, keepdims=True) + weight))
    return (logs[True] - logs[False]).ravel().tolist()


def labelled_samples(docs: DataFrame, text: str = "text", ordinary: int = 20_000, drawn: int = 4_000) -> DataFrame:
    """Samples (token, random).

    Ordinary ones are at most ``ordinary`` long words of the documents that no base kind
    matches, of each value of a hash the one with the least second hash, and as many
    identifiers of seven styles, put together from neighbours among them. Random ones are
    ``drawn`` digests, each in four alphabets.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("token"))
    bucket = F.pmod(F.xxhash64("token"), F.lit(ordinary)).alias("bucket")
    words = words.where(~F.col("token").rlike("|".join(BASE.values()))).groupBy(bucket).agg(F.min(F.struct(F.xxhash64(F.lit(1), "token").alias("hash"), "token"))["token"].alias("token"))
    words = cut(words)  # at most ``ordinary`` rows; read three times
    # each with the one of the next bucket
    other = words.select(F.pmod(F.col("bucket") - 1, F.lit(ordinary)).alias("bucket"), F.regexp_replace("token", "[^A-Za-z]", "").alias("p"))
    both = words.select("bucket", F.regexp_replace("token", "[^A-Za-z]", "").alias("w")).join(other, "bucket")
    w, p, n = F.substring("w", 1, 7), F.substring("p", 1, 8), F.col("bucket")
    number, third = F.when(n % 3 == 0, "").otherwise((n % 37).cast("string")), F.initcap(F.substring("w", 8, 7))
    styles = F.array(
        F.concat_ws("_", F.lower(w), F.lower(p), (n % 100).cast("string")), F.concat(F.initcap(w), F.initcap(p), third, number), F.concat(F.lower(w), F.initcap(p), third, number),
        F.concat_ws("-", F.lower(w), F.lower(p), (2000 + n % 40).cast("string")), F.concat_ws("_", F.upper(w), F.upper(p), (n % 9).cast("string")), F.concat_ws("/", F.lower(w), F.lower(p), F.lower(third), F.concat(F.lit("v"), (n % 9).cast("string"))), F.concat_ws("=", F.lower(w), F.concat(F.lower(p), number)),
    )
    made = both.select(F.get(styles, (n % 7).cast("int")).alias("token"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    coded = F.regexp_replace(F.base64(F.unhex(digest)), r"\s|=", "")
    plain = F.regexp_replace(coded, "[+/]", "")
    strings = docs.sparkSession.range(drawn).select(F.explode(F.array(coded, F.substring(digest, 1, 40), F.lower(plain), F.upper(plain))).alias("token"), F.lit(True).alias("random"))
    return words.select("token").union(made).select("token", F.lit(False).alias("random")).union(strings)


def secret_spans(docs: DataFrame, ratios: list[float], text: str = "text", least: float = 0.8, base: str = "base", spans: str = "spans") -> DataFrame:
    """Add ``base`` and ``spans``, arrays of struct(kind, from, to) by start, then kind.

    ``spans`` has the base spans and each token beyond them whose log-likelihood ratio is
    over ``least`` for each transition. ``kind`` counts in ``KINDS``.
    """
    llr = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")

    def looks_random(token: Column) -> Column:
        total = F.aggregate(_transitions(token), F.lit(0.0), lambda a, pair: a + F.get(llr, pair))
        return total > least * (F.length(token) - 1)

    def beyond(every: Column) -> Column:
        """Of spans in order, the base ones and those of which no base span holds the whole."""
        reach = _running(F.transform(every, lambda s: F.when(s["kind"] < len(BASE), s["to"]).otherwise(0)), F.greatest)
        marked = F.zip_with(every, reach, lambda s, to: F.struct(s.alias("span"), ((s["kind"] < len(BASE)) | (to < s["to"])).alias("keep")))
        return F.transform(F.filter(marked, lambda x: x["keep"]), lambda x: x["span"])

    t, more = F.coalesce(F.col(text), F.lit("")), f"{OWN}random"
    out = docs.withColumn(base, base_spans(t)).withColumn(more, _found(t, TOKEN, "random", looks_random))
    return out.withColumn(spans, F.when(F.size(more) > 0, _let(_ordered(F.concat(base, more)), beyond)).otherwise(F.col(base))).drop(more)


def described(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["from"].cast("string"), s["to"].cast("string"))), ",")


#: Characters of a text that are cut out of it together.
_CHUNK = 4096


def redacted(text: str, spans: str, mark: str = "[secret]") -> Column:
    """The text with each span (overlapping ones as one) replaced by ``mark``.

    The text is cut in chunks first, so that each piece between spans is looked up in its own.
    """

    def pieces(chunks: Column) -> Column:
        def piece(begin: Column, end: Column) -> Column:
            parts = F.transform(F.sequence(F.floor(begin / _CHUNK).cast("int"), F.floor((end - 1) / _CHUNK).cast("int")), lambda c: F.substr(F.get(chunks, c), F.greatest(begin - c * _CHUNK, F.lit(0)) + 1, end - F.greatest(begin, c * _CHUNK)))
            return F.when(begin < end, F.array_join(parts, "")).otherwise("")

        def between(reach: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), reach)
            own = F.zip_with(spans, F.slice(before, F.lit(1), F.size(spans)), lambda s, at: F.when(s["from"] >= at, F.concat(piece(at, s["from"]), F.lit(mark))).otherwise(""))
            return F.array_join(F.concat(own, F.array(piece(F.element_at(reach, -1), F.length(text)))), "")

        return _let(_running(F.transform(spans, lambda s: s["to"]), F.greatest), between)

    whole = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(whole, pieces)).otherwise(F.col(text))


def model(spark: SparkSession, docs: DataFrame, text: str = "text") -> list[float]:
    """Ratios trained on ``labelled_samples`` of the documents."""
    return train(labelled_samples(docs, text))
