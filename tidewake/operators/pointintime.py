"""Attributes as known at event time (problem 7).

What is known of a symbol is a step function of time: at every change time (a version becomes known, or its day
begins) the best version so far may change. Its steps become half-open validity intervals, cut at time buckets, and
an event meets exactly the intervals of its symbol and bucket by an equi-join plus containment.

No window runs over a whole symbol's rows: versions are first reduced to the best per symbol and bucket, the running
best is carried over those few, and the steps inside a bucket are found per (symbol, bucket).

Cases: events without symbol or time match nothing and are no cases; versions without symbol, known_at, day or
first_trade_date are never valid; ties fall to the greater day, known_at, bar_id; a version with null volume is a
version like any other; events after the last change are clamped to its bucket, whose last interval is open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.keys import norm_symbol
from tidewake.session import materialise

#: Seconds of a time bucket.
BUCKET = 86_400
OPEN = 1 << 62


def change_points(prices: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Usable versions: ``sym, since (seconds), tb, v(day, known_at, bar_id)``; ``since`` is when it may first be used."""
    known = F.ceil(F.unix_micros("known_at") / F.lit(1_000_000)).cast("long")
    since = F.greatest(known, F.unix_date("day").cast("long") * 86_400)
    return (
        prices.where("first_trade_date is not null and first_trade_date <= day and known_at is not null")
        .select(norm_symbol(F.col("symbol")).alias("sym"), since.alias("since"), F.struct("day", "known_at", "bar_id").alias("v"))
        .where("sym is not null")
        .withColumn("tb", F.floor(F.col("since") / bucket))
    )


def validity(points: DataFrame, last: int, bucket: int = BUCKET) -> DataFrame:
    """Half-open intervals ``sym, tb, valid_from, valid_to, bar_id``, cut at bucket bounds up to bucket ``last``."""
    best = points.groupBy("sym", "tb").agg(F.max("v").alias("v"))
    order = Window.partitionBy("sym").orderBy("tb")
    carried = (
        best.select("sym", "tb", F.max("v").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("v"), F.lead("tb").over(order).alias("next"))
        # the best so far holds at the start of every later bucket up to and including that of the next change
        .select("sym", F.explode(F.sequence(F.col("tb") + 1, F.greatest(F.coalesce("next", F.lit(last)), F.col("tb") + 1))).alias("tb"), "v")
        .where(F.col("tb") <= last)
        .select("sym", "tb", (F.col("tb") * bucket).alias("since"), "v")
    )
    steps = carried.unionByName(points.select("sym", "tb", "since", "v")).groupBy("sym", "tb", "since").agg(F.max("v").alias("v"))
    inside = Window.partitionBy("sym", "tb").orderBy("since")
    return (
        steps.select("sym", "tb", "since", F.max("v").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("v"), F.lead("since").over(inside).alias("until"))
        .select("sym", "tb", F.col("since").alias("valid_from"), F.coalesce("until", F.when(F.col("tb") == last, F.lit(OPEN)).otherwise((F.col("tb") + 1) * bucket)).alias("valid_to"), F.col("v.bar_id").alias("bar_id"))
    )


def as_known(mentions: DataFrame, prices: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``mention_id, bar_id``: the version of the symbol's bars that was known when the mention was made."""
    points = change_points(prices, bucket)
    last = points.agg(F.max("tb")).head()[0]
    if last is None:
        return mentions.select("mention_id", F.lit(None).cast("long").alias("bar_id")).where("false")
    events = (
        mentions.select("mention_id", norm_symbol(F.col("symbol")).alias("sym"), F.col("created_utc").cast("long").alias("t"))
        .where("sym is not null and t is not null")
        .withColumn("tb", F.least(F.floor(F.col("t") / bucket), F.lit(last)))
    )
    # written once, so that the join has an exchange of its own on either side and a hot symbol's bucket can be split
    return events.join(materialise(validity(points, last, bucket)), ["sym", "tb"]).where("t >= valid_from and t < valid_to").select("mention_id", "bar_id")


def with_attributes(mentions: DataFrame, prices: DataFrame) -> DataFrame:
    """Every mention with ``volume`` and ``first_trade_date`` as then known (null where nothing was)."""
    got = as_known(mentions, prices).join(prices.select("bar_id", "volume", "first_trade_date"), "bar_id")
    return mentions.select("mention_id", "symbol", "created_utc").join(got, "mention_id", "left")
