"""A paged search as a data source: windows of time read in parallel, each by following a cursor.

    spark.dataSource.register(Search)
    spark.read.format("search").schema(S).options(fetch="package.module:function", after=t, before=t, windows=8).load()

``fetch(params)`` answers one request (``pacing.Answer`` with a list of records as body); a client of the network, or of
recorded pages, is given by name, so that tasks can import it. ``after`` and ``before`` are exclusive bounds in seconds;
``link_id`` asks for one thread; further options starting with ``q_`` are passed on.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidewake.sources.pacing import Asker, MissingCredentials

PAGE = 100
Ask = Callable[[dict[str, Any]], list[dict[str, Any]]]


def second_from_both_ends(ask: Ask, params: dict[str, Any], second: int, met: set[str], page: int = PAGE) -> tuple[list[dict[str, Any]], bool]:
    """Records of one crowded second that the ascending read did not reach, and whether some may still be out of reach."""
    back = ask({**params, "after": second - 1, "before": second + 1, "sort": "desc", "limit": page})
    fresh = [r for r in back if r["id"] not in met]
    return fresh, len(back) >= page and len(fresh) == len(back)


def walk(ask: Ask, params: dict[str, Any], after: int, before: int, limit: int | None = None, page: int = PAGE, lost: Callable[[int], None] = lambda second: None) -> Iterator[dict[str, Any]]:
    """Every record in (after, before), each id once, in ascending pages.

    Pages overlap by a second, as a page may end inside one. A page that lies in one second throughout can't move the
    cursor: that second is read from its other end too, and ``lost`` is told if both reads may have missed some.
    """
    met: set[str] = set()
    cursor = after
    while limit is None or len(met) < limit:
        got = ask({**params, "after": cursor, "before": before, "sort": "asc", "limit": page})
        new = [r for r in got if r["id"] not in met]
        full, last = len(got) >= page, got[-1]["created_utc"] if got else cursor
        if full and got[0]["created_utc"] == last:
            fresh, missed = second_from_both_ends(ask, params, last, met | {r["id"] for r in new}, page)
            if missed:
                lost(last)
            new, cursor = new + fresh, last
        else:
            cursor = last - 1
        for r in new:
            if r["id"] in met:
                continue
            if limit is not None and len(met) >= limit:
                return
            met.add(r["id"])
            yield r
        if not full:
            return


class Search(DataSource):
    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return "id string, created_utc long, author string, body string, score long, link_id string, parent_id string, subreddit string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Windows(schema, dict(self.options))


class _Window(InputPartition):
    def __init__(self, after: int, before: int) -> None:
        self.after, self.before = after, before


class _Windows(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names, self.options = [f.name for f in schema.fields], options
        # option names come in lower case
        self.params = {k[2:]: v for k, v in options.items() if k.startswith("q_")} | ({"link_id": options["link_id"]} if "link_id" in options else {})

    def partitions(self) -> list[InputPartition]:
        lo, hi, n = int(self.options["after"]), int(self.options["before"]), int(self.options.get("windows", 1))
        if "limit" in self.options:  # the earliest so many are those of one read in order
            n = 1
        cuts = sorted({lo + (hi - lo) * k // n for k in range(n + 1)})
        # a record on a cut belongs to the window that ends there
        return [_Window(a, b if b == hi else b + 1) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: _Window) -> Iterator[tuple]:
        module, _, name = self.options["fetch"].partition(":")
        asker = Asker(getattr(importlib.import_module(module), name))
        limit = self.options.get("limit")
        for r in walk(asker.ask, self.params, partition.after, partition.before, None if limit is None else int(limit)):
            yield tuple(r.get(n) for n in self.names)


def credentials(*names: str) -> dict[str, str]:
    """What the environment holds under these names; raises, before any job starts, if one is missing."""
    if lacking := [n for n in names if not os.environ.get(n)]:
        raise MissingCredentials(f"not set: {', '.join(lacking)}")
    return {n: os.environ[n] for n in names}


def cached(path: str, fetch: Callable[[], str], refresh: bool = False) -> str:
    """Small text fetched once: from ``path`` if it is there, else fetched and kept. For files of the driver only."""
    at = Path(path)
    if refresh or not at.exists():
        at.parent.mkdir(parents=True, exist_ok=True)
        part = at.with_suffix(at.suffix + ".part")
        part.write_text(fetch(), encoding="utf-8")
        part.replace(at)
    return at.read_text(encoding="utf-8")
