"""A paged source as a Python data source: batch by page, stream by cursor.

Pages are JSON files of a folder, named by number, each an array of objects with an ``id``. A network client would differ in
``fetch`` alone; retries and the pace of requests are here.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Back-off of a source that asks for patience: 8 attempts, 5 s doubling, at most 120 s.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 8, 5.0, 120.0
GONE = (404, 410)


class Refused(Exception):
    """A request that was refused, with its status and what the source said about waiting."""

    def __init__(self, status: int, retry_after: float | None = None) -> None:
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def patiently(request: Callable[[], object], sleep: Callable[[float], None] = time.sleep, attempts: int = ATTEMPTS):
    """The request's answer; None if the row is gone. Refusals for lack of patience and broken connections are tried again, all else is raised."""
    for k in range(attempts):
        try:
            return request()
        except Refused as e:
            if e.status in GONE:
                return None
            if e.status != 429 or k == attempts - 1:
                raise
            sleep(e.retry_after if e.retry_after is not None else min(LONGEST_WAIT, FIRST_WAIT * 2**k))
        except (ConnectionError, TimeoutError):
            if k == attempts - 1:
                raise
            sleep(min(LONGEST_WAIT, FIRST_WAIT * 2**k))
    return None


class Pace:
    """At most ``rate`` requests a second: each waits until its turn."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep, self.next = 1 / rate, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        at = max(now, self.next)
        self.next = at + self.gap
        if at > now:
            self.sleep(at - now)


class Page(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


def _pages(folder: str) -> list[str]:
    names = [n for n in os.listdir(folder) if n.endswith(".json")]
    return [os.path.join(folder, n) for n in sorted(names, key=lambda n: int(n.split(".")[0]))]


def _rows(path: str, fields: list[str]) -> list[tuple]:
    with open(path, encoding="utf-8") as f:
        return [tuple(x.get(c) for c in fields) for x in json.load(f)]


class PagedReader(DataSourceReader):
    def __init__(self, fields: list[str], options: dict) -> None:
        self.fields, self.folder = fields, options["path"]

    def partitions(self) -> list[InputPartition]:
        """Pages up to the first empty one."""
        out = []
        for p in _pages(self.folder):
            if not _rows(p, self.fields):
                break
            out.append(Page(p))
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from _rows(partition.path, self.fields)


class CursorReader(SimpleDataSourceStreamReader):
    """A page of a walk by rising id at a time; the offset is the last id given."""

    def __init__(self, fields: list[str], options: dict) -> None:
        self.fields, self.folder, self.size = fields, options["path"], int(options.get("pageSize", 200))

    def initialOffset(self) -> dict:
        return {"after": -1}

    def _walk(self, after: int, until: int | None = None) -> list[tuple]:
        key = self.fields.index("id")
        rows = sorted(r for p in _pages(self.folder) for r in _rows(p, self.fields) if r[key] is not None and r[key] > after)
        return [r for r in rows if r[key] <= until] if until is not None else rows[: self.size]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._walk(start["after"])
        return iter(rows), {"after": rows[-1][self.fields.index("id")] if rows else start["after"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._walk(start["after"], end["after"]))


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_pages"

    def schema(self) -> str:
        return self.options.get("schema", "id long, name string")

    def _fields(self, schema) -> list[str]:
        return [f.name for f in schema.fields]

    def reader(self, schema) -> PagedReader:
        return PagedReader(self._fields(schema), self.options)

    def simpleStreamReader(self, schema) -> CursorReader:
        return CursorReader(self._fields(schema), self.options)
