"""Rules on chat messages: pictures, withheld content, prose, scripts and the answers to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import redact
from corvane.functions.prompts import _kind, _let, _member, _text_at, _trimmed

# The kinds of messages that are a person's own words, and those that people send.
PROSE = ("m.text", "m.notice", "m.emote")
SENT = (0, 19)


def is_picture(kind: Column, msgtype: Column, url: Column, relation: Column) -> Column:
    """A message with a picture of the own media store, and no edit of another one."""
    return F.coalesce((kind == "m.room.message") & (msgtype == "m.image") & url.startswith("mxc://"), F.lit(False)) & ~F.coalesce(relation == "m.replace", F.lit(False))


def content_withheld(kind: Column, bot: Column, content: Column, poll: Column, *lists: Column) -> Column:
    """A message that a person sent with nothing in it at all: no text, no poll, and every list (attachments, embeds,
    stickers, components, snapshots) empty or missing."""
    out = kind.isin(*SENT) & ~F.coalesce(bot, F.lit(False)) & (F.coalesce(content, F.lit("")) == "") & poll.isNull()
    for x in lists:
        out = out & (F.coalesce(F.size(x), F.lit(0)) <= 0)
    return F.coalesce(out, F.lit(False))


def scrubbed_content(msgtype: Column, body: Column, formatted: Column) -> Column:
    """struct(body, formatted, address, agent): both texts of prose redacted, with what was taken from both; other
    messages as they are, as a picture's body is its file's name."""
    prose = F.coalesce(msgtype.isin(*PROSE), F.lit(False))

    def put(a: Column, b: Column) -> Column:
        count = lambda k: F.coalesce(a[k], F.lit(0)) + F.coalesce(b[k], F.lit(0))
        return F.struct(F.when(body.isNotNull(), a["text"]).alias("body"), F.when(formatted.isNotNull(), b["text"]).alias("formatted"), count("address").cast("long").alias("address"), count("agent").cast("long").alias("agent"))

    zero = F.lit(0).cast("long")
    left = F.struct(body.alias("body"), formatted.alias("formatted"), zero.alias("address"), zero.alias("agent"))
    return F.when(prose, _let(redact.scrubbed(F.coalesce(body, F.lit(""))), lambda a: _let(redact.scrubbed(F.coalesce(formatted, F.lit(""))), lambda b: put(a, b)))).otherwise(left)


def picture_edit(content: Column, choice_key: str) -> Column:
    """struct(original_id, url, old_file) of an event's content (JSON) that replaces another one by a picture; null for other edits and events.

    ``old_file`` is what the sender chose under ``choice_key``: expire, or else keep.
    """

    def asked(c: Column) -> Column:
        relation, new = _member(c, '["m.relates_to"]'), _member(c, '["m.new_content"]')
        original, url = _text_at(relation, "event_id"), _text_at(new, "url")
        edit = (_text_at(relation, "rel_type") == "m.replace") & original.isNotNull() & (_text_at(new, "msgtype") == "m.image") & url.isNotNull()
        choice = F.when(_text_at(_member(c, f'["{choice_key}"]'), "old_file") == "expire", "expire").otherwise("keep")
        return F.when(edit, F.struct(original.alias("original_id"), url.alias("url"), choice.alias("old_file")))

    return _let(F.try_parse_json(content), asked)


def media_id(url: Column, domain: str) -> Column:
    """The id of a picture of the own media store, else null."""
    found = F.regexp_extract(url, r"^mxc://([^/]+)/([^/?#]+)\z", 2)
    return F.when((F.regexp_extract(url, r"^mxc://([^/]+)/([^/?#]+)\z", 1) == domain) & (found != ""), found)


def generation_record(removed: Column, md5: Column, raw_md5: Column, poster: Column, source: str = "matrix") -> Column:
    """struct(md5, raw_md5, source, poster, fields) of the fields that a strip took out (a map), without
    zero characters; null if it took none. An empty poster is none."""
    fields = F.transform_values(removed, lambda _, v: F.replace(v, F.lit("\x00"), F.lit("")))
    record = F.struct(md5.alias("md5"), raw_md5.alias("raw_md5"), F.lit(source).alias("source"), F.when(poster != "", poster).alias("poster"), fields.alias("fields"))
    return F.when(F.size(removed) > 0, record)


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that does not hold or is not known; null if all hold."""
    out = F.lit(None).cast("string")
    for holds, name in reversed(checks):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def script(body: Column, command: str) -> Column:
    """struct(reason, lines) of a message whose first line is a command: what follows it there, and the further lines
    that are neither blank nor a code fence; null for other messages."""

    def told(all_: Column) -> Column:
        head = _trimmed(F.get(all_, F.lit(0)))
        lines = F.filter(F.transform(F.slice(all_, F.lit(2), F.size(all_)), _trimmed), lambda x: (x != "") & ~x.startswith("```"))
        found = F.struct(_trimmed(F.substring(head, len(command) + 1, 1 << 30)).alias("reason"), lines.alias("lines"))
        return F.when((head == command) | head.startswith(f"{command} "), found)

    return _let(F.split(F.regexp_replace(body, r"\r\n?", "\n"), "\n", -1), told)


def refusal_reasons(answer: Column, clean: Callable[[Column], Column] | None = None) -> Column:
    """Why a script was refused, one text a reason: a list of errors with line numbers, or texts by field, or one message.

    Fields come in order of their names; ``clean`` is applied to each reason. An answer of
    another shape gives no reason.
    """
    none = F.array().cast("array<string>")

    def listed(errors: Column) -> Column:
        some = F.filter(F.try_variant_get(errors, "$", "array<variant>"), lambda e: _text_at(e, "reason").isNotNull())
        line = lambda e: F.when(_kind(_member(e, "line")) == "BIGINT", F.concat(F.lit("line "), F.try_variant_get(e, "$.line", "string"), F.lit(": ")))
        return F.transform(some, lambda e: F.concat(F.coalesce(line(e), F.lit("")), _text_at(e, "reason")))

    def by_field(errors: Column) -> Column:
        texts = lambda v: F.filter(F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v)), lambda m: _kind(m) == "STRING")
        name = lambda k: F.when(k.isin("base", "script"), "").otherwise(F.concat(k, F.lit(" ")))
        fields = F.array_sort(F.map_keys(F.try_variant_get(errors, "$", "map<string,variant>")))
        return F.flatten(F.transform(fields, lambda k: F.transform(texts(F.element_at(F.try_variant_get(errors, "$", "map<string,variant>"), k)), lambda m: F.concat(name(k), F.try_variant_get(m, "$", "string")))))

    def told(value: Column) -> Column:
        errors = _member(value, "errors")
        kind = _kind(errors)
        found = F.when(kind.startswith("ARRAY"), listed(errors)).when(kind.startswith("OBJECT"), by_field(errors))
        message = _trimmed(_text_at(value, "message"))
        one = F.when(message != "", F.array(message))
        return _let(F.coalesce(found, none), lambda f: F.when(F.size(f) > 0, f).otherwise(F.coalesce(one, none)))

    out = _let(F.try_parse_json(answer), lambda v: F.when(_kind(v).startswith("OBJECT"), told(v)).otherwise(none))
    return F.transform(F.coalesce(out, none), clean) if clean else F.coalesce(out, none)


def post_id(location: Column) -> Column:
    """The id in a redirect to ``/posts/<id>``, absolute or not, with or without ``.json``; null for any other place."""
    path = F.regexp_replace(F.regexp_replace(location, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), r"(?s)[?#].*\z", "")
    return F.regexp_extract(path, r"^/?posts/([0-9]+)(?:\.json)?\z", 1).try_cast("long")
