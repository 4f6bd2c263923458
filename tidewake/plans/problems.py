"""Queries of the general data problems, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import badrows, distinct, drift, orphans, pointintime, redelivery, timestamps
from tidewake.session import table as t


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return drift.changes(t(s, d, "archive_lines")).select("file_name", "change", "old_field", "new_field")


def p1_log(s: SparkSession, d: str) -> DataFrame:
    """The change log in order of feed and file."""
    return drift.changes(t(s, d, "archive_lines")).orderBy("feed", "file_seq", "change", "old_field", "new_field")


def p1_schema(s: SparkSession, d: str) -> DataFrame:
    return drift.union_schema(t(s, d, "archive_lines"))


def p1_records(s: SparkSession, d: str) -> DataFrame:
    return drift.records(t(s, d, "archive_lines"))


def _orphans(s: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(t(s, d, "comments"), t(s, d, "posts"), t(s, d, "threads"), t(s, d, "removals"))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return _orphans(s, d).select("row_id", "ref_field", "state")


def p2_report(s: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(s, d))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return timestamps.readable(t(s, d, "bulk_comments"), t(s, d, "feeds"))


def p4_distinct(s: SparkSession, d: str) -> DataFrame:
    return distinct.distinct_authors(t(s, d, "mentions"), t(s, d, "comments"), t(s, d, "attention_events"))


def _sightings(s: SparkSession, d: str) -> DataFrame:
    return distinct.sightings(t(s, d, "mentions"), "mentions").unionByName(distinct.sightings(t(s, d, "comments"), "comments"))


def p4_partials(s: SparkSession, d: str) -> DataFrame:
    """Partial counts per hash range, ready to be added up."""
    return distinct.partial_counts(_sightings(s, d), ["day", "symbol", "subreddit"])


def p4_pairs(s: SparkSession, d: str) -> DataFrame:
    """Identifier-group pairs, ready to be merged with those of other batches."""
    return distinct.identifier_groups(_sightings(s, d), ["day", "symbol", "subreddit"])


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return badrows.bad_rows(t(s, d, "csv_lines"))


def p5_valid(s: SparkSession, d: str) -> DataFrame:
    return badrows.valid_rows(t(s, d, "csv_lines"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return redelivery.repeats(t(s, d, "comments"))


def p6_unique(s: SparkSession, d: str) -> DataFrame:
    """All columns; the time of receipt as microseconds."""
    return redelivery.unique_messages(t(s, d, "comments")).withColumn("received_at", F.unix_micros("received_at"))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return pointintime.as_known(t(s, d, "mentions"), t(s, d, "price_series"))


def p7_attributes(s: SparkSession, d: str) -> DataFrame:
    return pointintime.with_attributes(t(s, d, "mentions"), t(s, d, "price_series"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_log, p1_schema, p1_records, p2_found, p2_report, p3_found, p4_distinct, p4_partials, p4_pairs, p5_found, p5_valid, p6_found, p6_unique, p7_found, p7_attributes)
}
