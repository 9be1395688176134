"""A paged history as a table and as a stream, read through a client.

``spark.read.format("paged")`` with the options ``client``, ``module:function`` of a
function that makes the client, and ``at``, what that function is given; the schema is
the reader's. A client has

- ``head(token)``: (generation, next token or None, first id, last id) of a page, cheap;
- ``page(token)``: (generation, rows as dictionaries).

Planning walks the heads from the first token, None, and pins their generation: if it
moves, the walk begins anew, three times at most; a page that does not begin after the
one before stops it. Tasks then read the pages, each on its own, and refuse one of another
generation, so a result is never of two. Comparisons with ``id`` are pushed down (with
``spark.sql.python.filterPushdown.enabled``): pages that lie outside them are not read.

``spark.readStream.format("paged")`` follows the pages: an offset is how many were read
and the token of the next.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

RESTARTS = 3


class Moved(RuntimeError):
    """The generation moved while it was read."""


class Backward(RuntimeError):
    """A page began at or before the end of the one before."""


def _client(options: dict) -> Any:
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)(options["at"])


@dataclass
class Page(InputPartition):
    token: Any
    generation: str
    first: int
    last: int


def walk(client: Any, restarts: int = RESTARTS) -> list[Page]:
    """All pages of one generation, by their heads."""
    for _ in range(restarts + 1):
        pages: list[Page] = []
        token, pinned = None, None
        while True:
            generation, following, first, last = client.head(token)
            if pinned not in (None, generation):
                break
            pinned = generation
            if first is not None:
                if pages and first <= pages[-1].last:
                    raise Backward(f"the page at {token!r} begins at {first}, not after {pages[-1].last}")
                pages.append(Page(token, generation, first, last))
            if following is None:
                return pages
            token = following
    raise Moved(f"the generation moved {restarts + 1} times")


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = dict(options), schema.names
        self.low, self.high = None, None

    def pushFilters(self, filters: list) -> Iterator:
        """Bounds of ``id`` leave out pages, and rows of those that are read; other filters are Spark's."""
        for f in filters:
            if getattr(f, "attribute", None) == ("id",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = f.value + isinstance(f, GreaterThan)
                    self.low = low if self.low is None else max(self.low, low)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = f.value - isinstance(f, LessThan)
                    self.high = high if self.high is None else min(self.high, high)
            else:
                yield f

    def _within(self, ident: int | None) -> bool:
        if self.low is None and self.high is None:
            return True
        return ident is not None and (self.low is None or ident >= self.low) and (self.high is None or ident <= self.high)

    def partitions(self) -> list[Page]:
        pages = walk(_client(self.options))
        kept = [p for p in pages if (self.low is None or p.last >= self.low) and (self.high is None or p.first <= self.high)]
        return kept or [Page(None, "", 0, -1)]

    def read(self, page: Page) -> Iterator[tuple]:
        if page.last < page.first:
            return
        generation, rows = _client(self.options).page(page.token)
        if generation != page.generation:
            raise Moved(f"the page at {page.token!r} is of generation {generation}, the read of {page.generation}")
        for r in rows:
            if self._within(r.get("id")):
                yield tuple(r.get(n) for n in self.names)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = dict(options), schema.names

    def initialOffset(self) -> dict:
        return {"pages": 0, "token": None, "last": None}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """The next page that is full, if there is one: a page with none to follow may still grow."""
        client = _client(self.options)
        _, following, first, last = client.head(start["token"])
        if following is None or first is None:
            return iter([]), start
        if start["last"] is not None and first <= start["last"]:
            raise Backward(f"the page at {start['token']!r} begins at {first}, not after {start['last']}")
        _, rows = client.page(start["token"])
        return iter([tuple(r.get(n) for n in self.names) for r in rows]), {"pages": start["pages"] + 1, "token": following, "last": last}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start["pages"] < end["pages"]:
            rows, start = self.read(start)
            yield from rows


class Paged(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Stream(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Paged)
