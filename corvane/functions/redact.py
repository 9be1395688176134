"""Redaction of addresses and user agents from prose: ordered rules, each on what the one before left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.prompts import _let

ADDRESS, AGENT = "[address removed]", "[user agent removed]"

# Products whose name and version are a user agent wherever they stand.
PRODUCTS = (
    "Mozilla Opera Dalvik AppleWebKit Chrome CriOS Safari Firefox FxiOS Edg Gecko curl Wget python-requests python-urllib "
    "aiohttp httpx okhttp Go-http-client axios node-fetch undici libwww-perl Java Apache-HttpClient Ruby Faraday Googlebot "
    "bingbot Discordbot Twitterbot facebookexternalhit Slackbot TelegramBot Element Riot Technetium SchildiChat FluffyChat "
    "Cinny Nheko Fractal Hydrogen matrix-nio matrix-js-sdk matrix-rust-sdk Synapse"
).split()

# The patterns, with word edges that know ASCII only.
_W = "[A-Za-z0-9_]"
_IN = f"(?<!{_W})(?={_W})"
_OUT = f"(?<={_W})(?!{_W})"
_TAIL = r"(?:\s*\([^)\n]*\)|\s+[A-Za-z][A-Za-z0-9_.+-]*/[A-Za-z0-9_.+-]+)*"
_H = "[0-9A-Fa-f]{1,4}"
RULES = [
    ("agent", rf"(?i){_IN}user[-_ ]?agent{_OUT}[\"']?\s*[:=]\s*(?:\"[^\"\n]*\"|'[^'\n]*'|[^\n}}]*)"),
    ("agent", rf"(?i){_IN}(?:{'|'.join(PRODUCTS)})/[0-9][A-Za-z0-9_.+-]*{_TAIL}"),
    ("agent", rf"{_IN}[A-Za-z][A-Za-z0-9_.+-]*/[0-9][A-Za-z0-9_.+-]*\s*\([^)\n]*;[^)\n]*\){_TAIL}"),
    ("address", rf"(?i){_IN}(?!mxc://)[a-z][a-z0-9+.-]*://\S+"),
    ("address", rf"{_IN}[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?::[0-9]+)?{_OUT}"),
    ("address", rf"\[?(?:{_IN}(?:(?:{_H}:){{1,7}}:(?:{_H}(?::{_H})*)?|(?:{_H}:){{4,7}}{_H})|(?<![A-Za-z0-9_:])::(?:{_H}:){{0,6}}{_H})(?![0-9A-Za-z])\]?(?::[0-9]{{2,5}})?"),
    ("address", rf"(?i){_IN}(?=[a-z0-9-]*[a-z])[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{{2,5}}{_OUT}"),
    ("address", rf"(?i){_IN}(?:localhost|[a-z][a-z0-9-]*-[0-9]+):[0-9]{{2,5}}{_OUT}"),
]


#: What a text must have for each rule to match at all, in their order: most prose has none of it.
_MAY = [
    lambda t: F.lower(t).contains("agent"),
    lambda t: t.contains("/"),
    lambda t: t.contains("/") & t.contains(";"),
    lambda t: t.contains("://"),
    lambda t: t.rlike(r"[0-9]\.[0-9]"),
    lambda t: t.contains("::") | t.rlike(f"{_H}:{_H}:{_H}:"),
    lambda t: t.rlike(r"[A-Za-z0-9-]:[0-9]{2}"),
    lambda t: t.rlike(r"[A-Za-z0-9-]:[0-9]{2}"),
]


def scrubbed(text: Column) -> Column:
    """struct(text, address, agent): the redacted text and how many of each kind went.

    Each rule acts on what the one before left; a text that it cannot match is passed on as it is.
    """
    zero = F.lit(0).cast("long")
    state = F.struct(F.coalesce(text, F.lit("")).alias("text"), zero.alias("address"), zero.alias("agent"))
    for (kind, pattern), may in zip(RULES, _MAY, strict=True):
        state = _let(state, _step(kind, pattern, may))
    return state


def _step(kind: str, pattern: str, may: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """One rule on the state so far."""
    mark = ADDRESS if kind == "address" else AGENT

    def step(s: Column) -> Column:
        counts = [(s[k] + F.regexp_count(s["text"], F.lit(pattern)) if k == kind else s[k]).alias(k) for k in ("address", "agent")]
        return F.when(may(s["text"]), F.struct(F.regexp_replace(s["text"], pattern, mark).alias("text"), *counts)).otherwise(s)

    return step


def scrubbed_prose(kind: Column, text: Column, prose: list[str]) -> Column:
    """``scrubbed`` for messages of these kinds; others stay as they are, with no counts."""
    none = F.lit(0).cast("long")
    return F.when(kind.isin(prose), scrubbed(text)).otherwise(F.struct(text.alias("text"), none.alias("address"), none.alias("agent")))
