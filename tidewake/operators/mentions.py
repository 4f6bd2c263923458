"""Mentions of symbols in text, and the universe of symbols they are looked up in.

Texts are reduced to candidates inside the JVM; only those meet the universe, whose size is checked before it is
broadcast. No word list or table is joined to whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.text import bare_lower, bare_symbols, cashtags, clean_company_name, tokens
from tidewake.session import join_small, spread

# Confidence of each way to a symbol.
CONFIDENCE = {"cashtag": 0.95, "bare": 0.85, "name": 0.8, "context": 0.6}
HIGH = 0.8
# Frequencies (Zipf scale) from which a word is no symbol without a cashtag, or only near trading words.
CASHTAG_ZIPF, CONTEXT_ZIPF = 5.0, 3.8
SHORTEST_NAME = 4

# Symbols that are taken only with a cashtag.
CASHTAG_ONLY = """
A AN AND ANY ARE AS AT BE BUT BY CAN FOR GO HAS HE IF IN IS IT ME MY NO NOT NOW
OF ON OR OUT SO THE TO TWO UP US WE YOU ONE BIG NEW OLD YES OK OKAY
DD CEO CFO IPO ATH ATL EPS PE PT YOLO FD FDS OTM ITM ATM EOD EOW EOY PSA EDIT
TLDR IMO IMHO AF LOL WTF LMAO GG RIP TA FA ER CC PM AM EST PST UTC GMT
USA USD EUR GDP CPI FED SEC IRS FBI CIA NYSE ETF ETN REIT LLC INC CORP LTD
Q1 Q2 Q3 Q4 FY YTD YOY QOQ MOM API APR APY EV IV OI VIX
HODL FOMO FUD MOON APE APES BAG BAGS CALL CALLS PUT PUTS BUY SELL HOLD LONG SHORT
I II III IV V X XX XXX WSB GAIN GAINS LOSS LOSSES
""".split()
# Symbols that are taken only near trading words.
CONTEXT_REQUIRED = """
ALL CASH DARE DNA EARN FAST GOLD GOOD HOPE KEY LAND LIFE LINK LIVE LOVE LOW MIND
MOVE NEXT NICE ODD OPEN PAY PLAY PLUS POST PURE RACE REAL ROAD ROCK RUN SAFE SHIP
SITE SKIN SNAP SOS SPOT STEP SUN TEAM TECH TOP TOUR TREE UNIT WAVE WAY WELL WEST
ZONE
""".split()
# Words of the trade that are no symbols and no names.
TRADE_WORDS = """
bullish bearish calls puts call put strike expiry moon tendies stonks stonk
squeeze short long hold holding bag bags gain gains loss losses yolo hype
dip rip pump dump rally crash bounce breakout retrace hedge margin leverage
buy sell trade trading trader position size open close high low volume float
crypto bitcoin reddit webull robinhood vanguard fidelity schwab discord twitter
youtube google apple amazon market markets economy news earnings company stock
""".split()


def listed(sources: DataFrame) -> DataFrame:
    """``symbol, name, is_etf, name_rank`` from listings ``priority, symbol, name, etf, test`` of several sources.

    Trailer rows and test issues are skipped; the first source's name wins; a fund anywhere is a fund.
    """
    sym = F.upper(F.btrim("symbol"))
    ok = sources.withColumn("symbol", sym).where((F.col("symbol") != "") & ~F.lower("symbol").contains("file creation") & (F.coalesce(F.btrim("test"), F.lit("")) != "Y"))
    return ok.groupBy("symbol").agg(F.min_by("name", F.struct("priority", "name")).alias("name"), F.max(F.coalesce(F.btrim("etf"), F.lit("")) == "Y").alias("is_etf"), F.min("priority").alias("name_rank")).withColumn("name", clean_company_name(F.coalesce("name", F.lit(""))))


def symbol_tier(symbol: Column, zipf: Column) -> Column:
    """``cashtag_only``, ``context_required`` or ``safe``, by list first and by word frequency (null: 0) then."""
    z = F.coalesce(zipf, F.lit(0.0))
    return (
        F.when(symbol.isin(*CASHTAG_ONLY), "cashtag_only")
        .when(symbol.isin(*CONTEXT_REQUIRED), "context_required")
        .when(F.lower(symbol).isin(*TRADE_WORDS) | (z >= CASHTAG_ZIPF), "cashtag_only")
        .when(z >= CONTEXT_ZIPF, "context_required")
        .otherwise("safe")
    )


def build_universe(sources: DataFrame, zipf: DataFrame | None = None) -> DataFrame:
    """The universe: ``symbol, name, name_rank, is_etf, tier, name_matchable, name_needs_context``.

    ``zipf`` (word, zipf) gives word frequencies; words it lacks are rare.
    """
    u = listed(sources)
    if zipf is None:
        u = u.withColumns({"zs": F.lit(0.0), "zn": F.lit(0.0)})
    else:
        w = zipf.groupBy(F.lower("word").alias("w")).agg(F.max("zipf").alias("z"))
        u = u.join(w.select(F.upper("w").alias("symbol"), F.col("z").alias("zs")), "symbol", "left").join(w.select(F.col("w").alias("name"), F.col("z").alias("zn")), "name", "left")
    zn = F.coalesce("zn", F.lit(0.0))
    return u.select("symbol", "name", "name_rank", "is_etf", symbol_tier(F.col("symbol"), F.col("zs")).alias("tier"), ((F.col("name") != "") & ~F.col("name").isin(*TRADE_WORDS) & (zn < CASHTAG_ZIPF)).alias("name_matchable"), (zn >= CONTEXT_ZIPF).alias("name_needs_context"))


def name_index(universe: DataFrame) -> DataFrame:
    """``name, symbol``: one-word names of four letters and more, the first symbol of each; funds are dropped after that choice."""
    ok = universe.where((F.length("name") >= SHORTEST_NAME) & ~F.contains("name", F.lit(" ")) & F.col("name_matchable"))
    return ok.groupBy("name").agg(F.min_by(F.struct("symbol", "is_etf", "name_needs_context"), F.struct("name_rank", "symbol")).alias("s")).select("name", "s.*")


def cashtag_mentions(docs: DataFrame) -> DataFrame:
    """``doc_id, symbol`` of every cashtag occurrence."""
    return docs.select("doc_id", F.explode(cashtags(F.col("text"))).alias("symbol"))


def unknown_cashtags(docs: DataFrame, universe: DataFrame) -> DataFrame:
    """``symbol, n`` of cashtags outside the universe, by occurrence."""
    return cashtag_mentions(docs).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).join(universe.select("symbol"), "symbol", "left_anti")


def extract_mentions(docs: DataFrame, universe: DataFrame, include_etfs: bool = False) -> DataFrame:
    """``doc_id, symbol, method, confidence``: each symbol once per text, by its most confident way.

    Cashtags count inside and outside the universe; upper-case tokens if they are safe, or near trading words if the
    universe wants that; names if they are one rare word.
    """
    text = spread(docs.where("text is not null and text <> ''").select("doc_id", "text"), "doc_id")
    # generators keep the token arrays from being made anew at every use
    cut = text.select("doc_id", F.inline(F.array(F.struct(tokens(F.col("text")).alias("toks"))))).select("doc_id", "toks", F.inline(F.array(F.struct(bare_lower(F.col("toks")).alias("lower")))))
    dim = universe.select("symbol", "tier", "is_etf")
    admitted = F.lit(True) if include_etfs else ~F.coalesce("is_etf", F.lit(False))
    tags = join_small(text.select("doc_id", F.explode(F.array_distinct(cashtags(F.col("text")))).alias("symbol")), dim, ["symbol"]).where(admitted).select("doc_id", "symbol", F.lit("cashtag").alias("method"))
    found = join_small(cut.select("doc_id", F.explode(F.array_distinct(bare_symbols(F.col("toks"), F.col("lower")))).alias("s")).select("doc_id", "s.*"), dim, ["symbol"], "inner").where(admitted)
    bares = found.where("tier = 'safe' or tier = 'context_required' and near").select("doc_id", "symbol", F.when(F.col("tier") == "safe", "bare").otherwise("context").alias("method"))
    words = cut.select("doc_id", F.explode(F.array_distinct("lower")).alias("name")).where(F.length("name") >= SHORTEST_NAME)
    names = join_small(words, name_index(universe), ["name"], "inner").where(admitted & ~F.col("name_needs_context")).select("doc_id", "symbol", F.lit("name").alias("method"))
    confidence = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    every = tags.unionByName(bares).unionByName(names).withColumn("confidence", F.element_at(confidence, F.col("method")))
    return every.groupBy("doc_id", "symbol").agg(F.max(F.struct("confidence", "method")).alias("m")).select("doc_id", "symbol", "m.method", "m.confidence")


def high_confidence(mentions: DataFrame) -> DataFrame:
    return mentions.where(F.col("confidence") >= HIGH)


def corpus_stopwords(docs: DataFrame, top: int = 400) -> DataFrame:
    """``word, n`` of the most frequent words of three letters and more; ties go by the alphabet."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))
    return docs.where("text is not null").select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(top)


def mentions_sorted(mentions: DataFrame) -> DataFrame:
    """``doc_id, mentions``: those of a text in one array, by symbol."""
    return mentions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("symbol", "method", "confidence"))).alias("mentions"))


def ranked_first(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row of each group: the first in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
