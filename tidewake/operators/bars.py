"""Price bars of an entity: returns by bar, trailing value traded, listing gates, provider payloads.

Windows run per entity over one row a trading day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.schemas import CHART

# Lower bounds of average value traded a day.
SIZES = (("mega", 1_000_000_000), ("large", 200_000_000), ("mid", 50_000_000), ("small", 5_000_000), ("micro", 0))
NEW_DAYS, PENNY = 365, 5.0


def latest_bars(series: DataFrame) -> DataFrame:
    """One bar per symbol and day: its last published version."""
    last = F.max_by(F.struct("adj_close", "volume", "first_trade_date"), F.struct("known_at", "bar_id"))
    return series.groupBy("symbol", "day").agg(last.alias("b")).select("symbol", "day", "b.*")


def chart_bars(payloads: DataFrame) -> DataFrame:
    """``symbol, day, adj_close, volume, first_trade_date`` from ``symbol, payload`` (JSON charts of a provider).

    Adjusted closes if there are any, else raw ones; bars without price are skipped; no volume is 0.
    """
    c = payloads.select("symbol", F.from_json("payload", CHART).alias("c"))
    adjusted, raw, volume = F.col("c.indicators.adjclose")[0]["adjclose"], F.col("c.indicators.quote")[0]["close"], F.col("c.indicators.quote")[0]["volume"]
    prices = F.when(F.size(adjusted) > 0, adjusted).otherwise(raw)
    first = F.nullif(F.col("c.meta.firstTradeDate"), F.lit(0))
    at = c.select("symbol", prices.alias("prices"), volume.alias("volumes"), F.to_date(F.timestamp_seconds(first)).alias("first_trade_date"), F.posexplode("c.timestamp").alias("i", "ts"))
    return at.select("symbol", F.to_date(F.timestamp_seconds("ts")).alias("day"), F.get("prices", "i").alias("adj_close"), F.coalesce(F.get("volumes", "i"), F.lit(0)).cast("double").alias("volume"), "first_trade_date").where("adj_close is not null")


def price_status(requested: DataFrame, bars: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """``symbol, status``: ``ok`` if it has bars, ``error`` if its fetch failed, else ``no_data`` (unpriceable)."""
    out = requested.select("symbol").distinct().join(bars.select("symbol").distinct().withColumn("ok", F.lit(True)), "symbol", "left")
    failed = errors.select("symbol").distinct().withColumn("err", F.lit(True)) if errors is not None else None
    out = out.join(failed, "symbol", "left") if failed is not None else out.withColumn("err", F.lit(None).cast("boolean"))
    return out.select("symbol", F.when(F.col("ok"), "ok").when(F.col("err"), "error").otherwise("no_data").alias("status"))


def status_lists(status: DataFrame) -> DataFrame:
    """``status, symbols``: the symbols of each outcome, sorted (the universe of symbols bounds a list)."""
    return status.groupBy("status").agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"))


def fetch_outcomes(requested: DataFrame, cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """``symbol, payload, status`` of every symbol asked for, from what is cached and what was fetched now.

    ``cache`` and ``fetched`` hold ``symbol, payload, error``; a payload counts before its lack, what is fetched before
    what is cached. A fetch without payload and without error is ``no_data`` and may be cached (``cacheable``); errors
    never are, so that they are tried again.
    """
    both = cache.select("symbol", "payload", F.lit(None).cast("string").alias("error"), F.lit(0).alias("now")).unionByName(fetched.select("symbol", "payload", "error", F.lit(1).alias("now")))
    best = both.groupBy("symbol").agg(F.max_by(F.struct("payload", "error"), F.struct(F.col("payload").isNotNull(), F.col("error").isNull(), "now")).alias("r"))
    known = requested.select("symbol").distinct().join(best, "symbol", "left")
    return known.select("symbol", "r.payload", F.when(F.col("r.payload").isNotNull(), "ok").when(F.col("r").isNull() | F.col("r.error").isNotNull(), "error").otherwise("no_data").alias("status"))


def cacheable(outcomes: DataFrame) -> DataFrame:
    """What to keep for the next run: ``symbol, payload``, null where there is known to be nothing."""
    return outcomes.where("status <> 'error'").select("symbol", "payload")


def price_report(status: DataFrame) -> DataFrame:
    """Counts by status; failed fetches are not held against the share that can't be priced."""
    n = {s: F.count_if(F.col("status") == s) for s in ("ok", "no_data", "error")}
    return status.agg(n["ok"].alias("fetched"), n["no_data"].alias("unpriceable"), n["error"].alias("fetch_failed")).withColumn("unpriceable_share", F.coalesce(F.try_divide(F.col("unpriceable"), F.col("fetched") + F.col("unpriceable")), F.lit(0.0)))


def indexed(bars: DataFrame) -> DataFrame:
    """Bars with their place ``bar_idx`` in the entity's series and the return from the bar before (null where undefined)."""
    w = Window.partitionBy("symbol").orderBy("day")
    before = F.lag("adj_close").over(w)
    return bars.withColumns({"bar_idx": F.row_number().over(w) - 1, "ret": F.when(before > 0, F.col("adj_close") / before - 1)})


def forward_return(bars: DataFrame, horizon: int) -> DataFrame:
    """``symbol, day, forward``: the return over the next ``horizon`` bars, null past the end or from a price of 0 or less."""
    ahead = F.lead("adj_close", horizon).over(Window.partitionBy("symbol").orderBy("day"))
    return bars.select("symbol", "day", F.when(F.col("adj_close") > 0, ahead / F.col("adj_close") - 1).alias("forward"))


def dollar_volume(bars: DataFrame, lookback: int = 21, sizes: tuple[tuple[str, float], ...] = SIZES) -> DataFrame:
    """``symbol, day, dollar_volume, size_bucket``: average value traded over the last bars, today included."""
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(1 - lookback, 0)
    traded = F.when((F.col("adj_close") != 0) & (F.col("volume") != 0), F.col("adj_close") * F.col("volume"))
    return bars.select("symbol", "day", F.avg(traded).over(w).alias("dollar_volume")).withColumn("size_bucket", size_bucket(F.col("dollar_volume"), sizes))


def size_bucket(v: Column, sizes: tuple[tuple[str, float], ...] = SIZES) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, least in sizes[:-1]:
        out = out.when(v >= least, name)
    return F.when(v.isNotNull(), out.otherwise(sizes[-1][0]))


def was_listed(day: Column, first: Column) -> Column:
    """False where the first trading day is unknown or later."""
    return F.coalesce(day >= first, F.lit(False))


def newly_listed(day: Column, first: Column, days: int = NEW_DAYS) -> Column:
    return F.coalesce(F.datediff(day, first).between(0, days), F.lit(False))


def cache_key(symbol: Column) -> Column:
    """A symbol as a file name."""
    return F.replace(symbol, F.lit("/"), F.lit("_"))


def is_penny(price: Column, below: float = PENNY) -> Column:
    """Null where there is no bar."""
    return price < below
