"""Bookkeeping of a resumable crawl: units done (latest entry wins) and issues met, as append-only tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.schemas import DONE, ISSUE
from tidewake.session import materialise


class Manifest:
    """Two small Parquet tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _read(self, name: str, schema) -> DataFrame:  # noqa: ANN001
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def mark_all(self, units: DataFrame, track: str) -> None:
        """Units done (``unit_key, record_count``), however many, as one file."""
        done = units.select("unit_key", F.lit(track).alias("track"), F.col("record_count").cast("long").alias("record_count"), F.lit(datetime.now(UTC).isoformat()).alias("completed_at"))
        done.coalesce(1).write.mode("append").parquet(f"{self.root}/completed_units")

    def mark_done(self, unit_key: str, track: str, record_count: int) -> None:
        self.mark_all(self.spark.createDataFrame([(unit_key, record_count)], "unit_key string, record_count long"), track)

    def note_all(self, issues: DataFrame) -> None:
        """Issues met (``unit_key, kind, detail``), in that order within the batch, as one file."""
        now = datetime.now(UTC)
        rank = F.row_number().over(Window.orderBy("unit_key", "kind", "detail")) - 1
        issues.select((F.lit(int(now.timestamp() * 1e6)) + rank).cast("long").alias("id"), "unit_key", "kind", "detail", F.lit(now.isoformat()).alias("noted_at")).coalesce(1).write.mode("append").parquet(f"{self.root}/crawl_issues")

    def note_issue(self, unit_key: str, kind: str, detail: str = "") -> None:
        self.note_all(self.spark.createDataFrame([(unit_key, kind, detail)], "unit_key string, kind string, detail string"))

    def compact(self) -> None:
        """Rewrite the units as one entry each in one file, so that what is read stays in proportion to the units."""
        kept = materialise(self.completed())
        kept.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/completed_units")

    def completed(self) -> DataFrame:
        return latest(self._read("completed_units", DONE))

    def is_done(self, unit_key: str) -> bool:
        return bool(self.completed().where(F.col("unit_key") == unit_key).head(1))

    def done_keys(self, track: str) -> DataFrame:
        return self.completed().where(F.col("track") == track).select("unit_key")

    def issues(self, last: int | None = None) -> DataFrame:
        """All issues in order, or the last few, latest first."""
        df = self._read("crawl_issues", ISSUE)
        return df.orderBy("id") if last is None else df.orderBy(F.desc("id")).limit(last)

    def summary(self) -> DataFrame:
        return summary(self.completed())


def latest(units: DataFrame) -> DataFrame:
    """One entry per unit: the last one completed."""
    return units.groupBy("unit_key").agg(F.max_by(F.struct("track", "record_count", "completed_at"), "completed_at").alias("u")).select("unit_key", "u.*")


def pending(units: DataFrame, done: DataFrame) -> DataFrame:
    """Units that aren't done."""
    return units.join(done.select("unit_key"), "unit_key", "left_anti")


def summary(units: DataFrame) -> DataFrame:
    """``track, units, records``."""
    return units.groupBy("track").agg(F.count(F.lit(1)).alias("units"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"))
