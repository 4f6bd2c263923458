"""Days, months and windows over them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.instants import HIGHEST, LOWEST
from tidewake.functions.keys import strip


def month_of(epoch: Column) -> Column:
    """The UTC month ``yyyy-MM`` of epoch seconds, whatever the session's zone."""
    d = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / F.lit(86_400)).cast("int"))
    return F.date_format(d, "yyyy-MM")


def day_range(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row per ``day`` in [start, end); none if the range is empty."""
    return spark.range((end - start).days if end > start else 0).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))


def month_windows(spark: SparkSession, start: date, end: date, months: int = 1) -> DataFrame:
    """Contiguous windows [window_start, window_end) of ``months`` months that cover [start, end), cut at both ends."""
    n = max(0, -(-((end.year - start.year) * 12 + end.month - start.month + (end.day > 1)) // months)) if end > start else 0
    first = F.trunc(F.lit(start), "MM")
    step = F.col("id").cast("int") * months
    return spark.range(n).select(F.greatest(F.add_months(first, step), F.lit(start)).alias("window_start"), F.least(F.add_months(first, step + months), F.lit(end)).alias("window_end")).where("window_start < window_end")


def _offset_in_full(t: Column) -> Column:
    """ISO text with seconds and with minutes of its offset, as the JVM's parser wants it."""
    t = F.regexp_replace(F.regexp_replace(t, "[Zz]$", "+00:00"), r"^(.{10}[T ]\d\d:\d\d)([+-])", "$1:00$2")
    return F.regexp_replace(t, r"(:\d\d[+-]\d\d)$", "$1:00")


def parse_timestamp(raw: Column) -> Column:
    """Epoch seconds of epoch seconds, epoch milliseconds or ISO-like text, null if unusable or before 2005 or after 2100.

    Only the first 19 characters of a date and time are read, so a zone after them is not.
    """
    t = strip(raw.cast("string"))
    n = t.try_cast("double")
    seconds = F.when(F.isnan(n) | (F.abs(n) > 1e17), F.lit(None)).otherwise(F.when(n > HIGHEST, F.floor(n / 1000)).otherwise(F.floor(n)))
    head = F.substr(t, F.lit(1), F.lit(19))
    text = F.coalesce(
        F.when(head.rlike(r"^\d{4}-\d\d?-\d\d?[ T]\d\d?:\d\d?:\d\d?$"), F.try_to_timestamp(F.regexp_replace(head, "T", " "), F.lit("yyyy-M-d H:m:s"))),
        F.when(head.rlike(r"^\d{4}-\d\d?-\d\d?$"), F.try_to_timestamp(head, F.lit("yyyy-M-d"))),
        F.when(t.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(_offset_in_full(t))),
    )
    out = F.when(n.isNotNull(), seconds).otherwise(F.unix_seconds(text))
    return F.when(out.between(LOWEST, HIGHEST), out.cast("long"))
