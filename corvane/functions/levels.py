"""Levels that accounts have in a room, and what those let them do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A creator's level, the version from which creators are above all levels, and the level that state asks for by default.
UNBOUNDED, CREATORS_FROM, STATE_DEFAULT = float("inf"), 12, 50


def level(users: Column, default: Column, sender: Column, version: Column, creators: Column) -> Column:
    """The sender's level as a double: without bound for one of the room's ``creators`` from
    version 12 on, else the one that ``users`` (a map) lists, else the default, else 0. A level
    that is listed without a value is 0, and a version that is no number is none."""
    number = F.regexp_extract(F.coalesce(version, F.lit("1")), r"^\s*([+-]?[0-9]{1,9})", 1).try_cast("int")
    created = F.coalesce((number >= CREATORS_FROM) & F.array_contains(creators, sender), F.lit(False))
    listed = F.coalesce(F.map_contains_key(users, F.coalesce(sender, F.lit(""))), F.lit(False))
    own = F.when(listed, F.element_at(users, sender)).otherwise(default)
    return F.when(created, F.lit(UNBOUNDED)).otherwise(F.coalesce(own.cast("double"), F.lit(0.0)))


def may_write(users: Column, users_default: Column, events: Column, state_default: Column, sender: str, kind: str) -> Column:
    """struct(ok, have, need): whether the sender may write state of this kind; the kind's own level counts before the default for state."""
    need = F.coalesce(F.element_at(events, kind), state_default, F.lit(STATE_DEFAULT)).cast("long")
    have = F.coalesce(F.element_at(users, sender), users_default, F.lit(0)).cast("long")
    return F.struct((have >= need).alias("ok"), have.alias("have"), need.alias("need"))


def granted(levels: Column, name: str, least: int) -> Column:
    """The map with ``name`` at ``least`` or what it was above that."""
    levels = F.coalesce(levels, F.create_map().cast("map<string,bigint>"))
    new = F.greatest(F.coalesce(F.element_at(levels, name), F.lit(0)), F.lit(least)).cast("long")
    return F.map_concat(F.map_filter(levels, lambda k, v: k != name), F.create_map(F.lit(name), new))
