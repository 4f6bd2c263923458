"""Bulk CSV corpora: header resolved by alias, rows normalised, first copies kept, withdrawn rows left out, all counted."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.calendars import parse_timestamp
from tidewake.functions.keys import strip
from tidewake.functions.text import is_withdrawn
from tidewake.sources import archive

# Names under which corpora publish each field, most specific first.
ALIASES = {
    "id": ("id", "comment_id", "post_id", "name", "fullname"),
    "created_utc": ("created_utc", "created", "timestamp", "date", "datetime", "time"),
    "body": ("body", "comment", "text", "comment_body", "selftext", "title"),
    "author": ("author", "user", "username", "author_name"),
    "score": ("score", "ups", "upvotes", "num_upvotes"),
    "subreddit": ("subreddit", "sub", "subreddit_name"),
    "link_id": ("link_id", "parent_post_id", "submission_id", "post_id"),
}
REQUIRED = ("created_utc", "body")
REASONS = ("bad_timestamp", "missing_body", "duplicate", "withdrawn", "written")


class SchemaError(ValueError):
    """A file lacks a required field."""


def resolve_columns(header: Iterable[str]) -> dict[str, str]:
    """Canonical field -> the file's column; raises, naming the header, if a required one is missing."""
    have = {h.strip().lower(): h for h in header}
    out = {field: have[name] for field, names in ALIASES.items() for name in [next((n for n in names if n in have), None)] if name}
    if lacking := [f for f in REQUIRED if f not in out]:
        raise SchemaError(f"no column for {', '.join(lacking)} among {sorted(have.values())}")
    return out


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder, all text, undecodable bytes replaced; ``_row`` numbers the rows of each ``_file`` from 0.

    Quoted line breaks need whole-file reading, so a file is one task; split corpora into files to read in parallel.
    """
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(path)
    # a task reads its files one after the other, so that a file's rows have numbers in a row; the number of the first is
    # one entry per file
    met = df.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    first = met.groupBy("_file").agg(F.min("_at").alias("_first"))
    return met.join(first, "_file").withColumn("_row", F.col("_at") - F.col("_first")).drop("_at", "_first")


def normalise(rows: DataFrame, source: str, row: str = "_row") -> DataFrame:
    """Canonical records with ``reason`` null, or the first of ``bad_timestamp`` and ``missing_body`` where unusable."""
    m = resolve_columns([c for c in rows.columns if c not in (row, "_file")])

    def get(f: str) -> Column:
        return F.nullif(F.col(f"`{m[f]}`").cast("string"), F.lit("")) if f in m else F.lit(None).cast("string")

    at, body = parse_timestamp(F.col(f"`{m['created_utc']}`")), F.nullif(strip(F.col(f"`{m['body']}`")), F.lit(""))
    score = get("score").try_cast("double")
    return rows.select(
        F.coalesce(get("id"), F.concat(F.lit(f"{source}:"), F.col(row).cast("string"))).alias("id"), at.alias("created_utc"), body.alias("body"), get("author").alias("author"),
        F.when(F.abs(score) < 9e18, score.cast("long")).alias("score"), get("subreddit").alias("subreddit"), get("link_id").alias("link_id"), F.lit(source).alias("_source"), F.col(row).alias("_row"), (F.col("_file") if "_file" in rows.columns else F.lit(source)).alias("_file"),
        F.when(at.isNull(), "bad_timestamp").when(body.isNull(), "missing_body").alias("reason"),
    )


def classify(records: DataFrame) -> DataFrame:
    """``reason`` completed: ``duplicate`` for all but the first usable row of an id in its file, then ``withdrawn``, else ``written``.

    First copies are found by an aggregation that combines on the map side, so a hot id isn't gathered. Every file is a
    load of its own, as is the number of a row without an id.
    """
    first = records.where("reason is null").groupBy("_file", "id").agg(F.min("_row").alias("_first"))
    j = records.join(first, ["_file", "id"], "left")
    return j.withColumn("reason", F.coalesce("reason", F.when(F.col("_row") > F.col("_first"), "duplicate").when(is_withdrawn(F.col("body")), "withdrawn").otherwise("written"))).drop("_first")


def ingest_report(classified: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows read, by reason, and the share kept: one row, or one for each ``by`` (``_file``)."""
    out = classified.groupBy(*by).agg(F.count(F.lit(1)).alias("read"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    return out.withColumn("kept_share", F.coalesce(F.try_divide(F.col("written"), F.col("read")), F.lit(0.0)))


def files_to_load(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The CSV files of a folder (or the file), and the names of files there that are none and are left alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return [], []
    names = sorted(x.getPath().toString() for x in fs.listStatus(at) if x.isFile())
    return [n for n in names if n.lower().endswith(".csv")], [n for n in names if not n.lower().endswith(".csv")]


def ingest_csv(spark: SparkSession, path: str, root: str, source: str, prefix: str = "bulk", fmt: str = "json") -> DataFrame:
    """Load a corpus (files of one header) into the archive under ``prefix/source``; returns its report, a row per file."""
    done = classify(normalise(scan(spark, path), source))
    archive.append(done.where("reason = 'written'").drop("reason", "_row", "_file"), root, f"{prefix}/{source}", fmt)
    return ingest_report(done, ("_file",))
