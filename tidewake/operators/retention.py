"""Withdrawn content left out and counted; live records kept; two sources compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.functions.text import is_withdrawn
from tidewake.schemas import COMMENT, POST, TAG


def project(df: DataFrame, kind: str = "comment") -> DataFrame:
    """The columns a stored record keeps, and every tag; columns that are absent stay absent."""
    keep = {f.name for f in (POST if kind == "post" else COMMENT).fields}
    return df.select(*[c for c in df.columns if c in keep or c.startswith(TAG)])


def _withdrawn(df: DataFrame):  # noqa: ANN202
    return is_withdrawn(*[F.col(c) for c in ("body", "selftext") if c in df.columns])


def live(df: DataFrame) -> DataFrame:
    """Without withdrawn records; a deleted author alone withdraws nothing."""
    return df.where(~_withdrawn(df))


def retention_report(df: DataFrame) -> DataFrame:
    """``scanned, dropped, dropped_share``."""
    out = df.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(_withdrawn(df)).alias("dropped"))
    return out.withColumn("dropped_share", F.coalesce(F.try_divide(F.col("dropped"), F.col("scanned")), F.lit(0.0)))


def only_live_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Records whose id is still live."""
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def compare_sources(archive: DataFrame, api: DataFrame) -> DataFrame:
    """``in_both, archive_only, api_only, text_lost_to_deletion, overlap_share``: ids of two sources, and archive rows whose text the other lost."""
    a = archive.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~is_withdrawn(F.col("body"))).alias("texts"))
    b = api.where("id is not null").groupBy("id").agg(F.max_by(is_withdrawn(F.col("body")), "row_id").alias("gone"))
    j = a.join(b, "id", "full")
    both = F.col("rows").isNotNull() & F.col("gone").isNotNull()
    return j.agg(F.count_if(both).alias("in_both"), F.count_if(F.col("gone").isNull()).alias("archive_only"), F.count_if(F.col("rows").isNull()).alias("api_only"), F.coalesce(F.sum(F.when(both & F.col("gone"), F.col("texts"))), F.lit(0)).alias("text_lost_to_deletion"), F.coalesce(F.try_divide(F.count_if(both), F.count(F.lit(1))), F.lit(0.0)).alias("overlap_share"))
