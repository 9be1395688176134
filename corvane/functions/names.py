"""Names, addresses, keys and small parsers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a name, an account id and a prefix may hold.
SAFE, ACCOUNT, PREFIX = r"^[a-z0-9._-]+\z", r"^[0-9]{17,20}\z", r"^[a-z0-9]{1,16}\z"


def is_taggable(name: Column) -> Column:
    """Up to 64 of a-z 0-9 . _ -, no underscore at either end, no two in a row."""
    return F.coalesce(F.length(name).between(1, 64) & name.rlike(SAFE) & ~name.startswith("_") & ~name.endswith("_") & ~name.contains("__"), F.lit(False))


def creator_name(name: Column, account: Column) -> Column:
    """The name if it is taggable, else folded with the account's id behind it, null without a usable id."""
    t = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9.-]+", "_")
    t = F.regexp_replace(F.regexp_replace(t, "_+", "_"), r"^_+|_+\z", "")
    folded = F.regexp_replace(F.substring(t, 1, 40), r"_+\z", "")
    return F.when(is_taggable(name), name).when(account.rlike(ACCOUNT), F.concat_ws("_", F.when(folded == "", "user").otherwise(folded), account))


def legal_prefix(prefix: Column, reserved: list[str]) -> Column:
    return F.coalesce(prefix.rlike(PREFIX) & ~prefix.isin(reserved), F.lit(False))


def creator_tag(name: Column, prefix: Column, reserved: list[str]) -> Column:
    """prefix_name, or null if either is not legal."""
    return F.when(legal_prefix(prefix, reserved) & is_taggable(name), F.concat_ws("_", prefix, name))


def local_part(address: Column, domain: str) -> Column:
    """``name`` of @name:domain for exactly this domain, else null; never folded."""
    return F.when(F.regexp_extract(address, r"^@([^:]+):(.+)\z", 2) == domain, F.regexp_extract(address, r"^@([^:]+):(.+)\z", 1))


def failure(method: Column, url: Column, status: Column) -> Column:
    """What failed, without host and query: METHOD path -> status."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+(/[^?#]*)?", 1)
    return F.concat(method, F.lit(" "), F.when(path == "", "/").otherwise(path), F.lit(" -> "), status)


def extension_of(name: Column) -> Column:
    """From the last dot of the last part on, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def id_at_end(location: Column) -> Column:
    """The number that ends a path, null if none does."""
    return F.regexp_extract(location, r"/([0-9]+)(?:[?#].*)?$", 1).try_cast("long")


def sharded(ident: Column, leaf: str) -> Column:
    return F.concat_ws("/", F.substring(ident, 1, 2), F.substring(ident, 3, 2), ident, F.lit(leaf))


def ids_of(paths: DataFrame, path: str = "path", pattern: str = "([0-9a-f]{32})") -> DataFrame:
    """``id``: the ids in the paths of one or more listings, each once; paths without one go."""
    return paths.select(F.regexp_extract(path, pattern, 1).alias("id")).where("id <> ''").distinct()


def commands(df: DataFrame, text: str, end: str = "\n") -> DataFrame:
    """Each non-empty line as a command: its number ``i``, its ``verb`` in lower case, its first ``argument``."""
    rest = [c for c in df.columns if c != text]
    lines = df.select(*rest, F.posexplode(F.split(text, end, -1)).alias("i", "x"))
    words = F.filter(F.split(F.trim("x"), r"\s+", -1), lambda y: y != "")
    return lines.select(*rest, "i", words.alias("w")).where(F.size("w") > 0).select(*rest, "i", F.lower(F.get("w", F.lit(0))).alias("verb"), F.get("w", F.lit(1)).alias("argument"))


def reasons(body: Column, unknown: str = "unknown") -> Column:
    """Why a request was refused: ``message``, the lists under ``errors``, or unknown."""
    lists = F.from_json(F.get_json_object(body, "$.errors"), "map<string,array<string>>")
    return F.coalesce(F.get_json_object(body, "$.message"), F.array_join(F.flatten(F.map_values(lists)), "; "), F.lit(unknown))


def iso_time(text: Column) -> Column:
    """A date's ISO form, null for what is none: it is never guessed."""
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def claims(df: DataFrame, pattern: str, marker: str) -> DataFrame:
    """Per ``doc_id`` the lines, those with a claim, and those flagged: a claim in a
    paragraph (between blank lines) without the marker.

    Folded inside each row, so no line is exchanged.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct((F.trim(x) == "").alias("blank"), x.rlike(pattern).alias("claim"), x.contains(marker).alias("mark")))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("n"), zero.alias("claims"), zero.alias("flagged"), zero.alias("open"), F.lit(False).alias("mark"))
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")

    def step(acc: Column, x: Column) -> Column:
        closed = F.when(acc["mark"], 0).otherwise(acc["open"]).cast("long")
        return F.struct(
            (acc["n"] + 1).alias("n"), (acc["claims"] + one(x["claim"])).alias("claims"), (acc["flagged"] + F.when(x["blank"], closed).otherwise(zero)).alias("flagged"),
            F.when(x["blank"], one(x["claim"])).otherwise(acc["open"] + one(x["claim"])).alias("open"), F.when(x["blank"], x["mark"]).otherwise(acc["mark"] | x["mark"]).alias("mark"),
        )

    done = F.aggregate(lines, start, step)
    out = df.select("doc_id", done.alias("d"))
    return out.select("doc_id", F.col("d.n").alias("lines"), "d.claims", (F.col("d.flagged") + F.when(F.col("d.mark"), 0).otherwise(F.col("d.open"))).alias("flagged"))
