"""Event study: return paths around events, averaged by event date and then across dates.

Bars are reached by their place in the series (an exploded offset and an equi-join), never by a range join. An event
expands to a fixed number of offsets; everything after the per-date mean is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators.bars import indexed, was_listed


def window_returns(at: DataFrame, bars: DataFrame, before: int = 20, after: int = 20) -> DataFrame:
    """``symbol, day, offset, ret`` around the bar of each (symbol, day): all offsets, null where there is no bar."""
    series = indexed(bars).select("symbol", "day", "bar_idx", "ret")
    spine = at.select("symbol", "day").distinct().join(series.select("symbol", "day", "bar_idx"), ["symbol", "day"], "left")
    wide = spine.select("symbol", "day", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"), (F.col("bar_idx") + F.col("offset")).alias("bar_idx"))
    return wide.join(series.select("symbol", "bar_idx", "ret"), ["symbol", "bar_idx"], "left").select("symbol", "day", "offset", "ret")


def event_paths(events: DataFrame, bars: DataFrame, market: DataFrame, before: int = 20, after: int = 20) -> DataFrame:
    """``symbol, day, offset, ret``: an event's return less the market's, offset by offset.

    Events of entities without bars, or before the entity's first trading day, have no path; a day without a bar has a
    path of nulls. The market is a series of its own (``day, adj_close``), met by offset, not by date.
    """
    listing = bars.groupBy("symbol").agg(F.min("first_trade_date").alias("first"))
    kept = events.select("symbol", "day").distinct().join(listing, "symbol").where(was_listed(F.col("day"), F.col("first"))).select("symbol", "day")
    own = window_returns(kept, bars, before, after)
    one = market.select(F.lit("market").alias("symbol"), "day", "adj_close")
    index = window_returns(kept.select(F.lit("market").alias("symbol"), "day"), one, before, after).select("day", "offset", F.col("ret").alias("m"))
    return own.join(index, ["day", "offset"], "left").select("symbol", "day", "offset", (F.col("ret") - F.col("m")).alias("ret"))


def stack_events(paths: DataFrame, before: int = 20, after: int = 20, min_dates: int = 5) -> DataFrame:
    """``offset, mean_return, stderr, coverage, cumulative``: means of the event dates' means, with errors across dates.

    Two steps on purpose: events of one date are one observation. Offsets met by fewer than ``min_dates`` dates come
    out as 0 without error; all offsets come out, also without any event.
    """
    spark = paths.sparkSession
    dates = paths.groupBy("day", "offset").agg(F.avg("ret").alias("m"))
    across = dates.groupBy("offset").agg(F.count("m").alias("coverage"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))
    spine = spark.range(-before, after + 1).select(F.col("id").cast("int").alias("offset"))
    nan, n = F.lit(float("nan")), F.coalesce("coverage", F.lit(0))
    out = spine.join(across, "offset", "left").select(
        "offset",
        F.when(n >= min_dates, F.col("mean")).otherwise(0.0).alias("mean_return"),
        F.when((n >= min_dates) & (n >= 2), F.col("sd") / F.sqrt(n)).otherwise(nan).alias("stderr"),
        n.alias("coverage"),
    )
    return out.withColumn("cumulative", F.sum("mean_return").over(Window.orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)))


def stack_size(paths: DataFrame) -> DataFrame:
    """``n_events, n_dates``: events with a path (of nulls too), and their dates."""
    e = paths.select("symbol", "day").distinct()
    return e.agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("day").alias("n_dates"))


def drift_verdict(stack: DataFrame, pre: tuple[int, int] = (-5, -1), post: tuple[int, int] = (1, 5)) -> DataFrame:
    """``pre_drift, post_drift, verdict`` over two inclusive ranges of offsets."""

    def drift(r: tuple[int, int]):  # noqa: ANN202
        return F.coalesce(F.sum(F.when(F.col("offset").between(*r), F.col("mean_return"))), F.lit(0.0))

    a, b = F.col("pre_drift"), F.col("post_drift")
    # The texts of the verdicts
    verdict = (
        F.when((F.abs(a) < 1e-9) & (F.abs(b) < 1e-9), "no movement either side")
        .when(b > F.abs(a), "chatter leads price")
        .when(a > F.abs(b), "chatter follows price")
        .otherwise("mixed")
    )
    return stack.agg(drift(pre).alias("pre_drift"), drift(post).alias("post_drift")).withColumn("verdict", verdict)
