"""Queries of the engine's own operators, over whole tables.

Two families of inputs stand in for a research archive: the star schema (a brand is an entity, an order line a mention,
its price the bar) and the discussion tables (comments, posts, threads, mentions, price_series ...).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import calendars
from tidewake.functions.keys import day_of, norm_key, norm_symbol
from tidewake.functions.text import clean_company_name
from tidewake.operators import bars, mentions, panel, retention, stack, threads
from tidewake.plans import crawl
from tidewake.schemas import COMMENT_TAGGED
from tidewake.session import scratch
from tidewake.session import table as t
from tidewake.sources import archive, bulk, listings, manifest, pages
from tidewake.streaming import attention

MIN_AUTHORS = 3
#: How recurring titles read in the discussion tables.
TITLES = (("moves_tomorrow", "what moves you next"), ("weekend_discussion", "weekend bench talk"), ("daily_discussion", "bench talk"), ("weekly_tendies", "endless tape"))


def r8(c: Column | str) -> Column:
    """Rounded, as sums of doubles depend on their order."""
    return F.round(c, 8)


# --- star schema ---------------------------------------------------------------------------------------------------


def star_lines(s: SparkSession, d: str) -> DataFrame:
    line = t(s, d, "lineitem").select("l_orderkey", "l_partkey", F.to_date("l_shipdate").alias("day"), "l_quantity", "l_extendedprice")
    return line.join(t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol")), "l_partkey")


def star_panel(s: SparkSession, d: str) -> DataFrame:
    orders = t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("author"))
    return panel.attention_panel(star_lines(s, d).select("l_orderkey", "symbol", "day").join(orders, "l_orderkey"))


def star_bars(s: SparkSession, d: str) -> DataFrame:
    b = star_lines(s, d).groupBy("symbol", "day").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("adj_close"), F.sum("l_quantity").alias("volume"))
    return b.withColumn("first_trade_date", F.lit("1992-06-01").cast("date"))


def star_market(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("adj_close"))


def attention_panel(s: SparkSession, d: str) -> DataFrame:
    return star_panel(s, d)


def rolling_zscore(s: SparkSession, d: str) -> DataFrame:
    return panel.rolling_zscores(star_panel(s, d)).withColumn("zscore", r8("zscore"))


def star_events(s: SparkSession, d: str) -> DataFrame:
    return panel.attention_events(star_panel(s, d), min_authors=MIN_AUTHORS)


def attention_events(s: SparkSession, d: str) -> DataFrame:
    return star_events(s, d).withColumn("zscore", r8("zscore")).orderBy("day", "symbol")


def star_paths(s: SparkSession, d: str) -> DataFrame:
    return stack.event_paths(star_events(s, d), star_bars(s, d), star_market(s, d))


def event_paths(s: SparkSession, d: str) -> DataFrame:
    return star_paths(s, d).withColumn("ret", r8("ret"))


def event_stack(s: SparkSession, d: str) -> DataFrame:
    """The flagship: 41 offsets around attention spikes; an undefined error comes out as null."""
    out = stack.stack_events(star_paths(s, d))
    return out.select("offset", r8("mean_return").alias("mean_return"), r8(F.nanvl("stderr", F.lit(None).cast("double"))).alias("stderr"), "coverage", r8("cumulative").alias("cumulative"))


def event_stack_size(s: SparkSession, d: str) -> DataFrame:
    return stack.stack_size(star_paths(s, d))


def event_drift_verdict(s: SparkSession, d: str) -> DataFrame:
    out = stack.drift_verdict(stack.stack_events(star_paths(s, d)), (-20, -1), (1, 20))
    return out.select(r8("pre_drift").alias("pre_drift"), r8("post_drift").alias("post_drift"), "verdict")


# --- price bars ----------------------------------------------------------------------------------------------------


def _bars(s: SparkSession, d: str) -> DataFrame:
    return bars.latest_bars(t(s, d, "price_series"))


def latest_bars(s: SparkSession, d: str) -> DataFrame:
    return _bars(s, d)


def bar_returns(s: SparkSession, d: str) -> DataFrame:
    return bars.indexed(_bars(s, d)).select("symbol", "day", "bar_idx", r8("ret").alias("ret"))


def window_returns(s: SparkSession, d: str) -> DataFrame:
    at = t(s, d, "attention_events").select("symbol", "day")
    return stack.window_returns(at, _bars(s, d), 5, 5).withColumn("ret", r8("ret"))


def forward_return(s: SparkSession, d: str) -> DataFrame:
    return bars.forward_return(_bars(s, d), 5).withColumn("forward", r8("forward"))


def dollar_volume_bucket(s: SparkSession, d: str) -> DataFrame:
    """In thousands."""
    return bars.dollar_volume(_bars(s, d)).withColumn("dollar_volume", F.round(F.col("dollar_volume") / 1000))


def listing_flags(s: SparkSession, d: str) -> DataFrame:
    day, first = F.col("day"), F.col("first_trade_date")
    return t(s, d, "attention_events").select("symbol", "day").join(_bars(s, d), ["symbol", "day"], "left").select("symbol", "day", bars.was_listed(day, first).alias("listed"), bars.newly_listed(day, first).alias("new"), bars.is_penny(F.col("adj_close")).alias("penny"))


def _status(s: SparkSession, d: str) -> DataFrame:
    asked = t(s, d, "mentions").select(norm_symbol(F.col("symbol")).alias("symbol")).where("symbol is not null")
    return bars.price_status(asked, t(s, d, "price_series").select(norm_symbol(F.col("symbol")).alias("symbol")))


def price_status(s: SparkSession, d: str) -> DataFrame:
    return _status(s, d)


def price_status_report(s: SparkSession, d: str) -> DataFrame:
    return bars.price_report(_status(s, d)).withColumn("unpriceable_share", r8("unpriceable_share"))


def price_status_lists(s: SparkSession, d: str) -> DataFrame:
    return bars.status_lists(_status(s, d))


def price_outcomes(s: SparkSession, d: str) -> DataFrame:
    """Mentioned symbols against a cache (symbols with prices) and a fetch that failed for those with a dot."""
    asked = t(s, d, "mentions").select(norm_symbol(F.col("symbol")).alias("symbol")).where("symbol is not null")
    cache = t(s, d, "price_series").select(norm_symbol(F.col("symbol")).alias("symbol")).where("symbol is not null").distinct().select("symbol", F.lit("bars").alias("payload"), F.lit(None).cast("string").alias("error"))
    fetched = asked.distinct().select("symbol", F.lit(None).cast("string").alias("payload"), F.when(F.contains("symbol", F.lit(".")), "timeout").alias("error"))
    return bars.fetch_outcomes(asked, cache, fetched)


def cache_keys(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "mentions").select("mention_id", bars.cache_key(F.col("symbol")).alias("cache_key"))


def chart_bars(s: SparkSession, d: str) -> DataFrame:
    """Charts written as a provider writes them, parsed again: one payload per symbol and month."""
    b = _bars(s, d).where("symbol is not null and day is not null").groupBy("symbol", F.trunc("day", "MM").alias("m")).agg(F.array_sort(F.collect_list(F.struct("day", "adj_close", "volume", "first_trade_date"))).alias("b"))
    ts = F.transform("b", lambda x: F.unix_date(x["day"]).cast("long") * 86_400 + 50_000)
    payload = F.to_json(
        F.struct(
            F.struct((F.unix_date(F.col("b")[0]["first_trade_date"]).cast("long") * 86_400).alias("firstTradeDate")).alias("meta"), ts.alias("timestamp"),
            F.struct(F.array(F.struct(F.transform("b", lambda x: x["adj_close"] + 1).alias("close"), F.transform("b", lambda x: x["volume"].cast("long")).alias("volume"))).alias("quote"), F.array(F.struct(F.transform("b", lambda x: x["adj_close"]).alias("adjclose"))).alias("adjclose")).alias("indicators"),
        ),
        {"ignoreNullFields": "false"},
    )
    return bars.chart_bars(b.select("symbol", payload.alias("payload"))).select("symbol", "day", "adj_close", "volume")


def symbol_event_stack(s: SparkSession, d: str) -> DataFrame:
    """The event study on the discussion tables: given attention events, the mean price of all symbols as the market."""
    b = _bars(s, d)
    market = b.groupBy("day").agg(F.avg("adj_close").alias("adj_close"))
    out = stack.stack_events(stack.event_paths(t(s, d, "attention_events"), b, market, 10, 10), 10, 10)
    return out.select("offset", r8("mean_return").alias("mean_return"), r8(F.nanvl("stderr", F.lit(None).cast("double"))).alias("stderr"), "coverage", r8("cumulative").alias("cumulative"))


def mention_zscores(s: SparkSession, d: str) -> DataFrame:
    seen = t(s, d, "mentions").where("author <> '[deleted]' and created_utc is not null").select(norm_symbol(F.col("symbol")).alias("symbol"), day_of(F.col("created_utc")).alias("day"), "author").where("symbol is not null")
    return panel.rolling_zscores(panel.attention_panel(seen)).withColumn("zscore", r8("zscore"))


# --- mentions ------------------------------------------------------------------------------------------------------


def universe(s: SparkSession, d: str) -> DataFrame:
    """The priced symbols, named by their lower-case form; tiers by first letter, as no word frequencies are supplied."""
    sym = t(s, d, "price_series").select("symbol").where("symbol is not null").distinct()
    tier = F.when(F.col("symbol").startswith("X"), "context_required").when(F.col("symbol").startswith("Y"), "cashtag_only").otherwise("safe")
    return sym.select("symbol", F.lower("symbol").alias("name"), F.lit(0).alias("name_rank"), F.col("symbol").startswith("V").alias("is_etf"), tier.alias("tier"), (tier != "cashtag_only").alias("name_matchable"), (tier == "context_required").alias("name_needs_context"))


def cashtag_mentions(s: SparkSession, d: str) -> DataFrame:
    return mentions.cashtag_mentions(t(s, d, "documents"))


def unknown_cashtags(s: SparkSession, d: str) -> DataFrame:
    return mentions.unknown_cashtags(t(s, d, "documents"), universe(s, d))


def mentions_best_route(s: SparkSession, d: str) -> DataFrame:
    return mentions.extract_mentions(t(s, d, "documents"), universe(s, d))


def high_confidence_mentions(s: SparkSession, d: str) -> DataFrame:
    return mentions.high_confidence(t(s, d, "mentions")).select("mention_id", "symbol", "method", "confidence")


def corpus_stopwords(s: SparkSession, d: str) -> DataFrame:
    return mentions.corpus_stopwords(t(s, d, "documents"))


def symbol_tiers(s: SparkSession, d: str) -> DataFrame:
    """Tiers of the words of all titles, read as symbols."""
    w = t(s, d, "posts").select(F.explode(F.split(F.upper("title"), "[^A-Z]+")).alias("symbol")).where("symbol <> ''").distinct()
    return w.select("symbol", mentions.symbol_tier(F.col("symbol"), F.lit(0.0)).alias("tier"))


NAME_FORMS = (" Inc. Common Stock", " Holdings, Inc.", " PLC - American Depositary Shares", " Trust ETF", " Corp. Class A", "")


def listed_universe(s: SparkSession, d: str) -> DataFrame:
    """The universe of the symbols of prices and mentions, named by their letters; word frequencies are those of the titles."""
    own = t(s, d, "price_series").select(F.lit(0).alias("priority"), "symbol", F.concat(F.lower("symbol"), F.lit(" Corp. Class A")).alias("name"), F.lit("N").alias("etf"))
    other = t(s, d, "mentions").select(F.lit(1).alias("priority"), norm_symbol(F.col("symbol")).alias("symbol"), F.lower(norm_symbol(F.col("symbol"))).alias("name"), F.when(norm_symbol(F.col("symbol")).startswith("V"), "Y").alias("etf"))
    words = t(s, d, "posts").select(F.explode(F.split(F.lower("title"), "[^a-z]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    sources = listings.listings(own, other).where("symbol is not null").distinct().withColumn("test", F.lit(None).cast("string"))
    return mentions.build_universe(sources, listings.zipf_of(words))


def mentions_in_order(s: SparkSession, d: str) -> DataFrame:
    """Each text's mentions in one list, by symbol."""
    return mentions.mentions_sorted(mentions_best_route(s, d)).select("doc_id", F.array_join(F.transform("mentions", lambda x: F.concat_ws(":", x["symbol"], x["method"])), ",").alias("mentions"))


def clean_names(s: SparkSession, d: str) -> DataFrame:
    """Company names cleaned: part names dressed in the forms of listings."""
    forms = F.array(*[F.lit(x) for x in NAME_FORMS])
    return t(s, d, "part").select("p_partkey", clean_company_name(F.concat("p_name", F.get(forms, (F.col("p_partkey") % len(NAME_FORMS)).cast("int")))).alias("name"))


# --- records -------------------------------------------------------------------------------------------------------


def project_comments(s: SparkSession, d: str) -> DataFrame:
    return retention.project(t(s, d, "comments"))


def withdrawn_filter(s: SparkSession, d: str) -> DataFrame:
    return retention.live(t(s, d, "comments")).select("row_id", "id", "body")


def retention_report(s: SparkSession, d: str) -> DataFrame:
    return retention.retention_report(t(s, d, "comments")).withColumn("dropped_share", r8("dropped_share"))


def live_only(s: SparkSession, d: str) -> DataFrame:
    """Comments whose thread is among the stored threads."""
    c = t(s, d, "comments").select("row_id", norm_key(F.col("link_id")).alias("id"))
    return retention.only_live_ids(c, t(s, d, "threads"))


def compare_sources(s: SparkSession, d: str) -> DataFrame:
    c = t(s, d, "comments").select("row_id", norm_key(F.col("id")).alias("id"), "body", "_source")
    return retention.compare_sources(c.where("_source = 'archive'"), c.where("_source = 'api'")).withColumn("overlap_share", r8("overlap_share"))


def collection_stats(s: SparkSession, d: str) -> DataFrame:
    return pages.collection_stats(t(s, d, "comments").where("_source = 'api'")).withColumn("deleted_share", r8("deleted_share"))


def archive_months(s: SparkSession, d: str) -> DataFrame:
    c = t(s, d, "comments").where("created_utc is not null")
    return c.groupBy(calendars.month_of(F.col("created_utc")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def archive_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Comments stored as compressed JSON by month and read back."""
    root = scratch(s, "archive")
    archive.append(retention.project(t(s, d, "comments").where("created_utc is not null")), root, "comments")
    return archive.read(s, root, "comments", COMMENT_TAGGED).select("month", *COMMENT_TAGGED.fieldNames())


def _done(s: SparkSession, d: str) -> DataFrame:
    c = t(s, d, "comments").where("_thread_id is not null")
    return c.groupBy("_thread_id", F.col("_source")).agg(F.count(F.lit(1)).alias("record_count"), F.max("received_at").alias("at")).select(F.col("_thread_id").alias("unit_key"), F.col("_source").alias("track"), "record_count", F.concat_ws("|", F.col("at").cast("string"), "_source").alias("completed_at"))


def manifest_latest(s: SparkSession, d: str) -> DataFrame:
    return manifest.latest(_done(s, d)).select("unit_key", "track", "record_count")


def manifest_summary(s: SparkSession, d: str) -> DataFrame:
    return manifest.summary(manifest.latest(_done(s, d)))


def pending_units(s: SparkSession, d: str) -> DataFrame:
    return manifest.pending(t(s, d, "threads").select(F.col("id").alias("unit_key"), "thread_type"), _done(s, d))


# --- threads -------------------------------------------------------------------------------------------------------


def _book(s: SparkSession, d: str) -> manifest.Manifest:
    """A manifest that holds an issue for each thread with 20 comments and more."""
    book = manifest.Manifest(s, scratch(s, "manifest"))
    book.note_all(truncated_threads(s, d).select(F.col("thread").alias("unit_key"), F.lit("truncated").alias("kind"), F.col("n").cast("string").alias("detail")))
    return book


def crawl_issues(s: SparkSession, d: str) -> DataFrame:
    return _book(s, d).issues().select("unit_key", "kind", "detail")


def last_issues(s: SparkSession, d: str) -> DataFrame:
    return _book(s, d).issues(10).select("unit_key", "kind", "detail")


def _archived(s: SparkSession, d: str) -> str:
    root = scratch(s, "archive")
    archive.append(retention.project(t(s, d, "comments").where("created_utc is not null")), root, "comments", "parquet")
    return root


def archive_month_list(s: SparkSession, d: str) -> DataFrame:
    return archive.months(archive.read(s, _archived(s, d), "comments", COMMENT_TAGGED, fmt="parquet"))


def archive_purged(s: SparkSession, d: str) -> DataFrame:
    """The stored comments once the withdrawn ones are purged."""
    root = _archived(s, d)
    archive.purge(s, root, "comments", COMMENT_TAGGED, fmt="parquet")
    return archive.read(s, root, "comments", COMMENT_TAGGED, fmt="parquet").select("month", "id", "created_utc", "body")


def api_records(s: SparkSession, d: str) -> DataFrame:
    raw = t(s, d, "comments").where("_source = 'api'").select("row_id", "id", "author", "body", "created_utc", "score")
    return pages.api_records(raw, "th", "daily", "s")


def thread_classify(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "threads").select("id", threads.classify_thread(F.col("title"), TITLES).alias("kind"))


def thread_types(s: SparkSession, d: str) -> DataFrame:
    return threads.count_by_type(t(s, d, "threads"))


def thread_dedupe(s: SparkSession, d: str) -> DataFrame:
    return threads.dedupe_threads(t(s, d, "threads").where("created_utc is not null")).select("id", "thread_type", "created_utc")


def thread_merge(s: SparkSession, d: str) -> DataFrame:
    th = t(s, d, "threads")
    return threads.merge_last(th, th.where("stickied").withColumn("score", F.lit(-1).cast("long"))).select("id", "score")


def threads_from_posts(s: SparkSession, d: str) -> DataFrame:
    both = t(s, d, "posts").select("id", "title", "created_utc", "subreddit", "author").unionByName(t(s, d, "threads").select("id", "title", "created_utc", "subreddit", "author"))
    return threads.from_posts(both, TITLES)


def thread_coverage(s: SparkSession, d: str) -> DataFrame:
    return threads.coverage(t(s, d, "threads").where("created_utc is not null"))


def thread_coverage_report(s: SparkSession, d: str) -> DataFrame:
    return threads.coverage_report(t(s, d, "threads").where("created_utc is not null"))


def _keyed(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "comments").withColumn("thread", norm_key(F.col("link_id"))).where("thread is not null")


def cap_per_group(s: SparkSession, d: str) -> DataFrame:
    return threads.cap_per_thread(_keyed(s, d).where("created_utc is not null"), 20, "thread").select("row_id", "thread", "created_utc")


def truncated_threads(s: SparkSession, d: str) -> DataFrame:
    return threads.truncated(_keyed(s, d), 20, "thread")


def thread_comments(s: SparkSession, d: str) -> DataFrame:
    """Every comment of every stored thread, keys met however spelled."""
    return crawl.comments_of_threads(t(s, d, "comments"), t(s, d, "threads")).select("row_id", "_thread_id", "_thread_type")


def crawl_stats(s: SparkSession, d: str) -> DataFrame:
    c = _done(s, d).withColumn("status", F.when(F.col("record_count") >= 20, "truncated").when(F.col("track") == "api", "failed").otherwise("done"))
    return crawl.crawl_stats(c)


def month_windows(s: SparkSession, d: str) -> DataFrame:
    return calendars.month_windows(s, date(2023, 1, 15), date(2024, 4, 10), 2)


def day_spine(s: SparkSession, d: str) -> DataFrame:
    return calendars.day_range(s, date(2023, 2, 1), date(2024, 5, 1))


# --- bulk files and pages ------------------------------------------------------------------------------------------


def parse_timestamp(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "bulk_comments").select("row_id", calendars.parse_timestamp(F.col("created_utc")).alias("epoch"))


def _normal(s: SparkSession, d: str) -> DataFrame:
    return bulk.normalise(t(s, d, "bulk_comments").select("row_id", "id", "created_utc", "body", "author", "score", "subreddit"), "feeds", "row_id")


def normalise_rows(s: SparkSession, d: str) -> DataFrame:
    return _normal(s, d).where("reason is null").select(F.col("_row").alias("row_id"), "id", "created_utc", "body", "score")


def ingest_outcome(s: SparkSession, d: str) -> DataFrame:
    return bulk.classify(_normal(s, d)).select(F.col("_row").alias("row_id"), "reason")


def ingest_report(s: SparkSession, d: str) -> DataFrame:
    return bulk.ingest_report(bulk.classify(_normal(s, d))).withColumn("kept_share", r8("kept_share"))


def dedupe_first(s: SparkSession, d: str) -> DataFrame:
    """The first row of each id of the posts."""
    p = t(s, d, "posts").where("id is not null")
    return p.groupBy("id").agg(F.min("row_id").alias("row_id"))


def paginate(s: SparkSession, d: str) -> DataFrame:
    c = t(s, d, "posts").where("id is not null and created_utc is not null").select("id", "created_utc", "row_id")
    return pages.paginate(c)


def crowded_seconds(s: SparkSession, d: str) -> DataFrame:
    """Hours with more posts than a small page, as no second of the data is that crowded."""
    c = t(s, d, "posts").where("id is not null and created_utc is not null").select("id", (F.floor(F.col("created_utc") / 86_400) * 86_400).alias("created_utc"))
    return pages.crowded_seconds(c, 2)


def stream_daily_authors(s: SparkSession, d: str) -> DataFrame:
    """Mentions as a stream of files, each batch stored as pairs; distinct authors by symbol and day of all batches."""
    src = t(s, d, "mentions")
    out = scratch(s, "stream")
    attention.store_pairs(attention.files(s, f"{d}/mentions.parquet", src.schema).where("created_utc is not null"), f"{out}/data", f"{out}/state").awaitTermination()
    return attention.stored_daily_authors(s, f"{out}/data")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        attention_panel, rolling_zscore, attention_events, event_paths, event_stack, event_stack_size, event_drift_verdict,
        latest_bars, bar_returns, window_returns, forward_return, dollar_volume_bucket, listing_flags, price_status, price_status_report, price_status_lists, price_outcomes, cache_keys, chart_bars, symbol_event_stack, mention_zscores,
        universe, cashtag_mentions, unknown_cashtags, mentions_best_route, high_confidence_mentions, corpus_stopwords, symbol_tiers, listed_universe, mentions_in_order, clean_names,
        project_comments, withdrawn_filter, retention_report, live_only, compare_sources, collection_stats, archive_months, archive_roundtrip, manifest_latest, manifest_summary, pending_units, crawl_issues, last_issues, archive_month_list, archive_purged, api_records,
        thread_classify, thread_types, thread_dedupe, thread_merge, threads_from_posts, thread_coverage, thread_coverage_report, cap_per_group, truncated_threads, thread_comments, crawl_stats, month_windows, day_spine,
        parse_timestamp, normalise_rows, ingest_outcome, ingest_report, dedupe_first, paginate, crowded_seconds, stream_daily_authors,
    )
}
