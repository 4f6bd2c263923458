"""Paged search results: a data source over recorded pages, and what paging means once pages are landed.

No network is used here: ``recorded_pages`` reads JSON-lines files of pages as a fetcher left them, one task a file,
and its options are those of the search.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidewake.functions.text import is_withdrawn

PAGE = 100


class RecordedPages(DataSource):
    """``spark.read.format("recorded_pages").option("path", folder).option("after", t).option("before", t)``."""

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return "id string, created_utc long, author string, body string, score long, link_id string, parent_id string, subreddit string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names = [f.name for f in schema.fields]
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.options["path"]).glob("*.jsonl"))] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        lo, hi = int(self.options.get("after", -(1 << 62))), int(self.options.get("before", 1 << 62))
        link = self.options.get("link_id")
        if not partition.value:
            return
        with open(partition.value, encoding="utf-8", errors="replace") as f:
            for line in f:
                if line.strip():
                    r = json.loads(line)
                    if lo < (r.get("created_utc") or 0) < hi and (link is None or r.get("link_id") == link):
                        yield tuple(r.get(n) for n in self.names)


def paginate(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Overlapping pages as one list: each id once, by time, the earliest ``limit`` of them."""
    one = pages.groupBy("id").agg(F.min(F.struct("created_utc", *[c for c in pages.columns if c not in ("id", "created_utc")])).alias("r")).select("id", "r.*")
    out = one.orderBy("created_utc", "id")
    return out if limit is None else out.limit(limit)


def crowded_seconds(records: DataFrame, page: int = PAGE) -> DataFrame:
    """``created_utc, n, recovered, lost`` of seconds with more records than a page: read from both ends, at most two pages come back."""
    n = records.groupBy("created_utc").agg(F.count_distinct("id").alias("n")).where(F.col("n") > page)
    got = F.least("n", F.lit(2 * page))
    return n.select("created_utc", "n", got.alias("recovered"), (F.col("n") - got).alias("lost"))


def recovered(records: DataFrame, page: int = PAGE) -> DataFrame:
    """What paging with recovery brings of each second: its first page in ascending order and its first in descending order."""
    w = Window.partitionBy("created_utc")
    ranked = records.dropDuplicates(["id"]).withColumns({"_up": F.row_number().over(w.orderBy("id")), "_down": F.row_number().over(w.orderBy(F.desc("id")))})
    return ranked.where((F.col("_up") <= page) | (F.col("_down") <= page)).drop("_up", "_down")


def api_records(raw: DataFrame, thread_id: str, thread_type: str, subreddit: str) -> DataFrame:
    """Official-API comments in the shape of archive records, withdrawn ones left out."""
    out = raw.withColumns({"author": F.coalesce("author", F.lit("[deleted]")), "link_id": F.lit(f"t3_{thread_id}"), "_thread_id": F.lit(thread_id), "_thread_type": F.lit(thread_type), "_subreddit": F.lit(subreddit), "_source": F.lit("api")})
    return out.where(~is_withdrawn(F.col("body")))


def collect_ranked(raw: DataFrame, thread_id: str, thread_type: str, subreddit: str, max_comments: int | None = None, rank: str = "rank") -> DataFrame:
    """A thread's comments as the official source ranks them: the first ``max_comments``, then withdrawn ones left out."""
    top = raw if max_comments is None else raw.orderBy(rank).limit(max_comments)
    return api_records(top, thread_id, thread_type, subreddit)


def collection_stats(raw: DataFrame) -> DataFrame:
    """``comments`` kept, ``deleted`` left out, and deleted per comment kept."""
    out = raw.agg(F.count_if(~is_withdrawn(F.col("body"))).alias("comments"), F.count_if(is_withdrawn(F.col("body"))).alias("deleted"))
    return out.withColumn("deleted_share", F.coalesce(F.try_divide(F.col("deleted"), F.col("comments")), F.lit(0.0)))
