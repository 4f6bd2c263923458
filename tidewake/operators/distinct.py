"""Distinct counts over huge identifier sets (problem 4), exact by hash-range decomposition.

Identifiers fall into disjoint hash ranges. Within a range, identifier-group pairs are deduplicated and counted
exactly, for every combination of the grouping columns; as ranges are disjoint, the counts of a group's ranges add
up. The error bound is therefore 0. Counts per range are partial results of disjoint ranges, merged by a sum; the
pairs themselves are those of other days, files or machines, merged by a union of distinct pairs (``merge_groups``).

Rows are deduplicated on the map side before the first shuffle, so an identifier with a third of all rows weighs no
more than its distinct groups. No set of identifiers is ever held in one place.

Cases: null, empty and ``[deleted]`` authors are no identity; a row lacking a grouping value (null time, blank
symbol) does not enter the combinations with that column; groups asked for without any identifier count 0.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.functions.keys import day_of, norm_symbol, strip

RANGES = 4096
#: Authors that stand for nobody.
NOBODY = ("", "[deleted]")


def sightings(df: DataFrame, source: str) -> DataFrame:
    """``source, author, day, symbol, subreddit``; symbol is null where the table has none."""
    symbol = norm_symbol(F.col("symbol")) if "symbol" in df.columns else F.lit(None).cast("string")
    return df.where(F.col("author").isNotNull() & ~strip("author").isin(*NOBODY)).select(
        F.lit(source).alias("source"), "author", day_of(F.col("created_utc")).alias("day"), symbol.alias("symbol"), F.nullif(strip("subreddit"), F.lit("")).alias("subreddit")
    )


def identifier_groups(pairs: DataFrame, by: list[str], ident: str = "author", fixed: tuple[str, ...] = ("source",), ranges: int = RANGES) -> DataFrame:
    """Each identifier once per group, with its hash range, for every non-empty combination of ``by``.

    ``level`` names the combination; columns outside it are null.
    """
    fine = pairs.distinct().withColumn("range", F.pmod(F.xxhash64(ident), F.lit(ranges)).cast("int"))
    levels = [c for n in range(1, len(by) + 1) for c in combinations(by, n)]
    null = {c: F.lit(None).cast(dict(pairs.dtypes)[c]) for c in by}
    cells = F.array(
        *[
            F.when(
                F.expr(" and ".join(f"`{c}` is not null" for c in lv)),
                F.struct(F.lit("+".join(lv)).alias("level"), *[(F.col(c) if c in lv else null[c]).alias(c) for c in by]),
            )
            for lv in levels
        ]
    )
    # one shuffle on the range: every later deduplication of its identifiers is local to the task that holds it
    spread = fine.select(*fixed, "range", ident, *by).repartition("range")
    cell = spread.select(*fixed, "range", ident, F.explode(cells).alias("cell")).where("cell is not null").select(*fixed, "range", ident, "cell.*")
    return cell.distinct()


def count_groups(groups: DataFrame, by: list[str], fixed: tuple[str, ...] = ("source",)) -> DataFrame:
    """Distinct identifiers per hash range and group of identifier-group pairs that are there once."""
    return groups.groupBy(*fixed, "level", *by, "range").agg(F.count(F.lit(1)).alias("n"))


def partial_counts(pairs: DataFrame, by: list[str], ident: str = "author", fixed: tuple[str, ...] = ("source",), ranges: int = RANGES) -> DataFrame:
    """Exact distinct counts per hash range and group, for every non-empty combination of ``by``."""
    return count_groups(identifier_groups(pairs, by, ident, fixed, ranges), by, fixed)


def merge_groups(groups: DataFrame, *others: DataFrame) -> DataFrame:
    """Identifier-group pairs of several days, files or machines, cut by the same ranges: each once, whoever else holds it."""
    for o in others:
        groups = groups.unionByName(o)
    return groups.distinct()


def merge_partials(partials: DataFrame, by: list[str], fixed: tuple[str, ...] = ("source",)) -> DataFrame:
    """Counts of disjoint ranges of one batch (batches: ``merge_groups``) added up: ``n_distinct`` with its relative ``error_bound`` (0: exact)."""
    return partials.groupBy(*fixed, "level", *by).agg(F.sum("n").alias("n_distinct")).withColumn("error_bound", F.lit(0.0))


def distinct_authors(mentions: DataFrame, comments: DataFrame, attention: DataFrame) -> DataFrame:
    """Distinct authors per day, symbol, subreddit and each combination, of mentions and of comments.

    Symbols of ``attention`` that nobody mentioned come out with 0.
    """
    by = ["day", "symbol", "subreddit"]
    groups = identifier_groups(sightings(mentions, "mentions").unionByName(sightings(comments, "comments")), by)
    # a task holds whole ranges, so that what it counts before the shuffle are counts of its ranges; the shuffle adds them up
    counted = groups.groupBy("source", "level", *by).agg(F.count(F.lit(1)).alias("n_distinct")).withColumn("error_bound", F.lit(0.0))
    asked = attention.select(norm_symbol(F.col("symbol")).alias("symbol")).where("symbol is not null").distinct()
    zero = asked.select(
        F.lit("mentions").alias("source"), F.lit("symbol").alias("level"), F.lit(None).cast("date").alias("day"), "symbol", F.lit(None).cast("string").alias("subreddit"), F.lit(0).cast("long").alias("n_distinct"), F.lit(0.0).alias("error_bound")
    )
    return counted.unionByName(zero).groupBy("source", "level", *by).agg(F.max("n_distinct").alias("n_distinct"), F.max("error_bound").alias("error_bound"))
