"""Attention from a stream of mentions or comments: late and repeated records handled by watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewake.functions.keys import day_of, norm_key, norm_symbol


def files(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files (or a single file) as a stream, so many files a trigger."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))
    return reader.parquet(path)


def once_each(stream: DataFrame, key: str = "id", late: str = "7 days") -> DataFrame:
    """Each message once within the watermark; state is dropped with it, so it stays bounded."""
    timed = stream.withColumns({"ts": F.timestamp_seconds("created_utc"), "_key": norm_key(F.col(key))}).where(F.col("_key").isNotNull())
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def daily_authors(mentions: DataFrame, late: str = "2 days") -> DataFrame:
    """``symbol, day, authors`` (approximate, relative error 2 %) of a stream of mentions, by UTC day."""
    timed = mentions.select(norm_symbol(F.col("symbol")).alias("symbol"), "author", F.timestamp_seconds("created_utc").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("symbol", F.window("ts", "1 day").alias("w")).agg(F.approx_count_distinct("author", 0.02).alias("authors"), F.count(F.lit(1)).alias("mentions")).select("symbol", F.to_date("w.start").alias("day"), "authors", "mentions")


def store_pairs(stream: DataFrame, root: str, checkpoint: str):  # noqa: ANN201
    """Exact daily attention without state: each batch leaves its (symbol, day, author) pairs under its own number.

    A batch that is run again replaces what it left, so nothing counts twice; records may come in any order, however
    late. ``stored_daily_authors`` adds the batches up.
    """
    seen = stream.select(norm_symbol(F.col("symbol")).alias("symbol"), day_of(F.col("created_utc")).alias("day"), "author")
    return to_sink(seen, lambda b, i: b.groupBy("symbol", "day", "author").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{root}/batch={i}"), checkpoint)


def stored_daily_authors(spark: SparkSession, root: str) -> DataFrame:
    """``symbol, day, authors, mentions`` of all batches stored: an author counts once, whichever batches it is in."""
    pairs = spark.read.schema("symbol string, day date, author string, n long, batch long").parquet(root)
    once = pairs.groupBy("symbol", "day", "author").agg(F.sum("n").alias("n"))
    return once.groupBy("symbol", "day").agg(F.count("author").alias("authors"), F.sum("n").alias("mentions"))


def to_sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):  # noqa: ANN201
    """Run over what is there, each batch handed to ``write`` once; resumes from the checkpoint."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
