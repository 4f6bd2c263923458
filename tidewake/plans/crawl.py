"""Crawls as dataflows over landed pages: units of work, what is pending, what is stored.

    python -m tidewake.plans.crawl {discover,comments,posts,threads,load} --data-dir DIR ...
"""

from __future__ import annotations

import argparse
import sys
import time
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.calendars import day_range, month_windows
from tidewake.functions.keys import day_of, key_kind, norm_key
from tidewake.operators import retention, threads
from tidewake.schemas import COMMENT, POST, THREAD
from tidewake.session import build_session, materialise
from tidewake.sources import archive, bulk
from tidewake.sources.manifest import Manifest, pending
from tidewake.sources.pages import paginate


def post_units(spark: SparkSession, subreddits: list[str], start: date, end: date) -> DataFrame:
    """``unit_key, subreddit, day``: one unit per subreddit and day in [start, end)."""
    names = F.explode(F.array(*[F.lit(s) for s in subreddits]).cast("array<string>"))
    return day_range(spark, start, end).select("day", names.alias("subreddit")).select(F.concat_ws(":", F.lit("posts"), "subreddit", "day").alias("unit_key"), "subreddit", "day")


def discovery_units(spark: SparkSession, authors: list[str], start: date, end: date, months: int = 12) -> DataFrame:
    """``author, window_start, window_end`` to search for threads."""
    return month_windows(spark, start, end, months).withColumn("author", F.explode(F.array(*[F.lit(a) for a in authors]).cast("array<string>")))


def store_posts(pages: DataFrame, book: Manifest, root: str, units: DataFrame) -> int:
    """The pages of all pending units (by subreddit and day) into the archive in one pass, and the units marked done.

    Units done before are left alone, so that a second run stores nothing twice; a unit without posts is done with 0.
    """
    todo = materialise(pending(units, book.completed()))
    day = day_of(F.col("created_utc"))
    found = paginate(pages).withColumn("day", day).join(todo, ["subreddit", "day"])
    kept = materialise(retention.live(retention.project(found.withColumn("_unit", F.col("unit_key")), "post")))
    n = 0
    for subreddit in [r["subreddit"] for r in todo.select("subreddit").distinct().collect()]:
        n += archive.append(kept.where(F.col("subreddit") == subreddit).drop("_unit").withColumn("_subreddit", F.lit(subreddit)), root, f"posts/{subreddit}")
    count = kept.groupBy(F.col("_unit").alias("unit_key")).agg(F.count(F.lit(1)).alias("n"))
    book.mark_all(todo.join(count, "unit_key", "left").select("unit_key", F.coalesce("n", F.lit(0)).alias("record_count")), "posts")
    return n


def store_comments(comments: DataFrame, which: DataFrame, book: Manifest, root: str, cap: int | None = None) -> int:
    """The comments of all pending threads into the archive in one pass; threads marked done, capped ones noted as truncated."""
    units = which.withColumn("unit_key", F.concat(F.lit("thread:"), "id"))
    todo = materialise(pending(units, book.completed()))
    kept = materialise(comments_of_threads(retention.project(comments.withColumn("_n", F.monotonically_increasing_id())), todo, cap, ("created_utc", "_n")).drop("_n"))
    n = archive.append(kept, root, "comments")
    count = kept.groupBy(F.col("_thread_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    done = materialise(todo.join(count, "id", "left").select("unit_key", F.coalesce("n", F.lit(0)).alias("record_count")))
    if cap is not None:
        book.note_all(done.where(F.col("record_count") >= cap).select("unit_key", F.lit("truncated").alias("kind"), F.concat(F.lit("capped at "), F.lit(cap)).alias("detail")))
    book.mark_all(done, "comments")
    return n


def discover_threads(pages: DataFrame, titles: tuple[tuple[str, str], ...] = threads.TITLES) -> DataFrame:
    """Threads among pages found by author, verified by title, each id once."""
    found = pages.withColumn("thread_type", threads.classify_thread(F.col("title"), titles)).where("thread_type is not null")
    return threads.ranked_first(found, ["id"], F.desc("created_utc")).select(*[c for c in THREAD.fieldNames() if c in found.columns]).orderBy("created_utc", "id")


def add_threads(spark: SparkSession, found: DataFrame, path: str) -> DataFrame:
    """Merge threads into the stored list (what is found replaces what has the same id), one per day and type."""
    try:
        found = threads.merge_last(spark.read.schema(THREAD).json(path), found)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):  # else there is no list yet
            raise
    kept = materialise(threads.dedupe_threads(found))  # the list can't be read and replaced at once
    kept.write.mode("overwrite").json(path)
    return kept


def comments_of_threads(comments: DataFrame, which: DataFrame, cap: int | None = None, order: tuple[str, ...] = ("created_utc", "row_id")) -> DataFrame:
    """All threads' comments in one pass: their thread's tags, the earliest ``cap`` of each, withdrawn ones left out.

    Keys meet however they are spelled; a thread is no comment, so that a key of kind t1 names none.
    """
    tags = which.select(norm_key(F.col("id")).alias("_key"), F.col("id").alias("_thread_id"), F.col("thread_type").alias("_thread_type"), F.col("subreddit").alias("_subreddit"))
    slim = comments.drop("_thread_id", "_thread_type", "_subreddit")
    link = F.when(F.coalesce(key_kind(F.col("link_id")), F.lit("t3")) == "t3", norm_key(F.col("link_id")))
    out = slim.withColumn("_key", link).join(tags, "_key")
    return retention.live(out if cap is None else threads.cap_per_thread(out, cap, "_key", order)).drop("_key")


def crawl_stats(units: DataFrame) -> DataFrame:
    """``units_done, units_failed, units_truncated, records`` of units with ``status`` and ``record_count``."""
    return units.agg(*[F.count_if(F.col("status") == s).alias(f"units_{s}") for s in ("done", "failed", "truncated")], F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=["discover", "comments", "posts", "threads", "load"])
    p.add_argument("--data-dir", required=True)
    p.add_argument("--pages", help="folder of recorded pages, or the CSV file to load")
    p.add_argument("--source", default="bulk")
    p.add_argument("--start", type=date.fromisoformat, default=date(2023, 1, 1))
    p.add_argument("--end", type=date.fromisoformat, default=date(2024, 1, 1), help="exclusive")
    p.add_argument("--subreddits", nargs="*", default=[])
    p.add_argument("--thread-types", nargs="*")
    p.add_argument("--max-comments", type=int)
    p.add_argument("--limit-units", type=int)
    a = p.parse_args(argv)
    spark = build_session("tidewake-crawl")
    book, root = Manifest(spark, f"{a.data_dir}/manifest"), f"{a.data_dir}/raw"
    if a.stage == "posts":
        units = pending(post_units(spark, a.subreddits, a.start, a.end), book.completed()).orderBy("unit_key")
        units = units.limit(a.limit_units) if a.limit_units else units
        if a.pages is None:
            units.show(truncate=False)
        else:
            print(f"{store_posts(spark.read.schema(POST).json(a.pages), book, root, units)} posts stored")
    elif a.stage == "discover":
        found = add_threads(spark, discover_threads(spark.read.schema(THREAD).json(a.pages)), f"{a.data_dir}/threads")
        threads.coverage_report(found).show(truncate=False)
    elif a.stage == "threads":
        threads.count_by_type(threads.from_posts(archive.read(spark, root, "posts/*", POST))).show(truncate=False)
    elif a.stage == "comments":
        try:
            which = spark.read.schema(THREAD).json(f"{a.data_dir}/threads")
        except Exception:
            print("no threads yet: run discover first", file=sys.stderr)
            return 2
        which = which if not a.thread_types else which.where(F.col("thread_type").isin(*a.thread_types))
        began = time.monotonic()
        n = store_comments(spark.read.schema(COMMENT).json(a.pages), which, book, root, a.max_comments)
        print(f"{n} comments stored in {time.monotonic() - began:.1f} s")
    else:
        found, others = bulk.files_to_load(spark, a.pages)
        for name in others:
            print(f"no CSV file, left alone: {name}", file=sys.stderr)
        if not found:
            print(f"no CSV file in {a.pages}", file=sys.stderr)
            return 1
        for path in found:
            try:
                report = materialise(bulk.ingest_csv(spark, path, root, a.source).withColumn("source", F.lit(a.source)))
            except bulk.SchemaError as e:
                print(f"{path}: {e}", file=sys.stderr)
                continue
            report.coalesce(1).write.mode("append").json(f"{a.data_dir}/reports")
            report.show(truncate=False)
    book.issues(10).show(truncate=False)
    book.summary().show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
