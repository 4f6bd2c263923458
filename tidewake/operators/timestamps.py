"""Mixed time stamp formats and zones (problem 3): one instant for every readable row.

Cases: null, blank and unreadable text give no instant; a row whose feed is not in ``feeds`` is readable only if its
text says its zone (or is a plain number) and its date's order is not the feed's to decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.functions import instants
from tidewake.session import join_small


def with_instant(bulk: DataFrame, feeds: DataFrame, column: str = "created_utc") -> DataFrame:
    """``row_id, created_us`` (null where unreadable) of every row. Scans just the three columns it needs."""
    rows = bulk.select("row_id", "feed", F.col(column).alias("text"))
    dim = feeds.select("feed", "zone", "day_first").dropDuplicates(["feed"])
    at = instants.with_instant(join_small(rows, dim, ["feed"]), F.col("text"), F.col("zone"), F.col("day_first"), "created_us")
    return at.select("row_id", "created_us")


def readable(bulk: DataFrame, feeds: DataFrame, column: str = "created_utc") -> DataFrame:
    """``row_id, created_us`` of the rows whose text names an existing instant in range."""
    return with_instant(bulk, feeds, column).where("created_us is not null")
