"""Recurring discussion threads: recognised by title, deduplicated, checked for coverage, their comments capped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.calendars import month_of
from tidewake.functions.keys import day_of
from tidewake.operators.mentions import ranked_first

# How the titles of each type read, in order.
TITLES = (
    ("moves_tomorrow", "what are your moves tomorrow"),
    ("daily_discussion", "daily discussion thread"),
    ("weekend_discussion", "weekend discussion thread"),
    ("weekly_tendies", "weekly tendies thread"),
)
DAILY = ("moves_tomorrow", "daily_discussion")
# Daily threads to expect in a month, and the share below which a month is suspicious.
EXPECTED, ALERT = 21, 0.5


def classify_thread(title: Column, titles: tuple[tuple[str, str], ...] = TITLES) -> Column:
    """The type of the first pattern found in a title, in any case; null if none is."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, text in titles:
        out = out.when(F.lower(title).contains(text), kind)
    return out


def from_posts(posts: DataFrame, titles: tuple[tuple[str, str], ...] = TITLES) -> DataFrame:
    """Threads among stored posts, with their type, by time."""
    return posts.withColumn("thread_type", classify_thread(F.col("title"), titles)).where("thread_type is not null").select("id", "title", "created_utc", "thread_type", "subreddit", "author").orderBy("created_utc", "id")


def dedupe_threads(threads: DataFrame) -> DataFrame:
    """The best thread per UTC day and type: stickied, then distinguished, then score; ties go to the smaller id."""
    day = day_of(F.col("created_utc"))
    keyed = threads.withColumn("_day", day)
    best = ranked_first(keyed, ["_day", "thread_type"], F.desc(F.coalesce("stickied", F.lit(False))), F.desc(F.coalesce(F.col("distinguished") != "", F.lit(False))), F.desc(F.coalesce("score", F.lit(0))), F.asc("id"))
    return best.drop("_day")


def merge_last(threads: DataFrame, fresh: DataFrame) -> DataFrame:
    """Both lists, what is fresh replacing what has the same id."""
    both = threads.withColumn("_at", F.lit(0)).unionByName(fresh.withColumn("_at", F.lit(1)), allowMissingColumns=True)
    return ranked_first(both, ["id"], F.desc("_at")).drop("_at")


def count_by_type(threads: DataFrame) -> DataFrame:
    return threads.groupBy("thread_type").agg(F.count(F.lit(1)).alias("n"))


def coverage(threads: DataFrame, daily: tuple[str, ...] = DAILY) -> DataFrame:
    """``month, n, status`` from the first to the last month with a daily thread: ``ok``, ``suspicious`` or ``missing``."""
    per = threads.where(F.col("thread_type").isin(*daily)).groupBy(month_of(F.col("created_utc")).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    first = F.to_date(F.concat(F.min("month"), F.lit("-01")))
    last = F.to_date(F.concat(F.max("month"), F.lit("-01")))
    spine = per.agg(first.alias("a"), last.alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))
    n = F.coalesce("n", F.lit(0))
    return spine.join(per, "month", "left").select("month", n.alias("n"), F.when(n == 0, "missing").when(n < EXPECTED * ALERT, "suspicious").otherwise("ok").alias("status"))


def coverage_report(threads: DataFrame, daily: tuple[str, ...] = DAILY) -> DataFrame:
    """One row: months covered, upper median of threads a month, suspicious and missing months, threads of all types."""
    c = coverage(threads, daily)
    have = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.col("n"))))
    # the count of all threads goes along as one more row
    total = threads.agg(F.count(F.lit(1)).alias("total"))
    both = c.unionByName(total, allowMissingColumns=True)
    one = both.agg(
        F.count_if(F.col("n") > 0).alias("months"), have.alias("h"), F.array_sort(F.collect_list(F.when(F.col("status") == "suspicious", F.col("month")))).alias("suspicious"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "missing", F.col("month")))).alias("missing"), F.max("total").alias("total_threads"),
    )
    return one.select("months", F.get("h", F.floor(F.size("h") / 2).cast("int")).alias("median_per_month"), F.array_join("suspicious", ",").alias("suspicious"), F.array_join("missing", ",").alias("missing"), "total_threads")


def cap_per_thread(comments: DataFrame, cap: int, by: str = "link_id", order: tuple[str, ...] = ("created_utc", "row_id")) -> DataFrame:
    """The earliest ``cap`` comments of each thread. Rank and limit are pushed below the shuffle (window group limit)."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return comments.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")


def truncated(comments: DataFrame, cap: int, by: str = "link_id") -> DataFrame:
    """Threads with at least ``cap`` comments, and how many they have."""
    return comments.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cap)
