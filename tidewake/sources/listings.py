"""Listings of symbols and word frequencies from the files their publishers give out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a pipe-delimited listing that give the symbol, the name, whether it is a fund and whether it is a test.
SYMBOL, NAME, ETF, TEST = ("Symbol", "ACT Symbol"), ("Security Name",), ("ETF",), ("Test Issue",)


def _shape(df: DataFrame, priority: int, symbol: str | None, name: str | None, etf: str | None, test: str | None) -> DataFrame:
    def col(c: str | None):  # noqa: ANN202
        return F.lit(None).cast("string") if c is None else F.col(f"`{c}`").cast("string")

    return df.select(F.lit(priority).alias("priority"), col(symbol).alias("symbol"), col(name).alias("name"), col(etf).alias("etf"), col(test).alias("test"))


def pipe_listing(spark: SparkSession, path: str, priority: int) -> DataFrame:
    """A pipe-delimited listing with a header; its trailer is left to ``mentions.listed``."""
    df = spark.read.option("header", True).option("sep", "|").option("quote", "").csv(path)
    pick = [next((c for c in df.columns if c.strip() in names), None) for names in (SYMBOL, NAME, ETF, TEST)]
    return _shape(df, priority, *pick)


def json_listing(spark: SparkSession, path: str, priority: int) -> DataFrame:
    """One JSON object whose values are ``{"ticker": ..., "title": ...}``."""
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,struct<ticker:string,title:string>>").alias("m"))
    return _shape(whole.select(F.explode(F.map_values("m")).alias("v")).select("v.*"), priority, "ticker", "title", None, None)


def listings(*sources: DataFrame) -> DataFrame:
    """All sources in the shape of ``mentions.listed``; the one with the least priority names a symbol."""
    return reduce(DataFrame.unionByName, sources)


def word_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """``word, zipf`` from tab-separated lines of a word and its frequency on the Zipf scale (log10 per billion words)."""
    df = spark.read.option("sep", "\t").option("quote", "").schema("word string, zipf double").csv(path)
    return df.where("word is not null and zipf is not null")


def zipf_of(counts: DataFrame) -> DataFrame:
    """``word, zipf`` from ``word, n`` of a corpus, where no table is at hand."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("word", F.log10(F.col("n") * 1e9 / F.col("total")).alias("zipf"))
