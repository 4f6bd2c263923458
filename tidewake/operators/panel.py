"""Attention: distinct participants per entity and day, scored against the entity's own past."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attention_panel(mentions: DataFrame, entity: str = "symbol", day: str = "day", author: str = "author") -> DataFrame:
    """``symbol, day, authors``: distinct authors. Duplicates are dropped on the map side before the count shuffles."""
    seen = mentions.select(F.col(entity).alias("symbol"), F.col(day).alias("day"), F.col(author).alias("author"))
    return seen.groupBy("symbol", "day").agg(F.count_distinct("author").alias("authors"))


def densify(panel: DataFrame) -> DataFrame:
    """The panel with a row of 0 authors for every day between an entity's first and last."""
    span = panel.groupBy("symbol").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("symbol", F.explode(F.sequence("a", "b")).alias("day"))
    return span.join(panel, ["symbol", "day"], "left").fillna(0, ["authors"])


def rolling_zscores(panel: DataFrame, baseline: int = 30, least: int = 10) -> DataFrame:
    """``symbol, day, authors, zscore`` against the previous ``baseline`` observed days, today excluded.

    Needs ``least`` of them. Whole-number counts are scored in integers, so that no rounding decides a threshold; with
    no spread the score is 0 up to the mean and infinite above. The window runs per entity over one row a day.
    """
    past = Window.partitionBy("symbol").orderBy("day").rowsBetween(-baseline, -1)
    whole = dict(panel.dtypes)["authors"] in ("bigint", "int", "smallint", "tinyint")
    inf = F.lit(float("inf"))
    a = F.col("authors").cast("long") if whole else F.col("authors")
    w = panel.select("symbol", "day", "authors", F.count("authors").over(past).alias("n"), F.sum(a).over(past).alias("s1"), F.sum(a * a).over(past).alias("s2"), F.max("authors").over(past).alias("top"), F.min("authors").over(past).alias("low"), F.avg("authors").over(past).alias("mean"), F.stddev_pop("authors").over(past).alias("sd"))
    w = w.where(F.col("n") >= least)
    if whole:
        spread = F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")
        above = F.col("n") * a - F.col("s1")
        z = F.when(spread <= 0, F.when(above <= 0, F.lit(0.0)).otherwise(inf)).otherwise(above.cast("double") / F.sqrt(spread.cast("double")))
    else:
        z = F.when(F.col("top") == F.col("low"), F.when(F.col("authors") <= F.col("top"), F.lit(0.0)).otherwise(inf)).otherwise((F.col("authors") - F.col("mean")) / F.col("sd"))
    return w.select("symbol", "day", "authors", z.alias("zscore"))


def attention_events(panel: DataFrame, threshold: float = 2.0, min_authors: float = 5, baseline: int = 30) -> DataFrame:
    """``symbol, day, zscore, authors`` of the days whose score and number of authors reach their floors."""
    hot = (F.col("zscore") >= threshold) & (F.col("authors") >= min_authors)
    return rolling_zscores(panel, baseline).where(hot).select("symbol", "day", "zscore", F.col("authors").cast("long").alias("authors"))
