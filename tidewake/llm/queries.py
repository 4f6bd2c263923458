"""Queries of the problems on training text, with production parameters over the whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewake.llm import bpe, garbled, packing
from tidewake.session import table as t


def p8_ids(s: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(t(s, d, "documents"))


def p9_packed(s: SparkSession, d: str) -> DataFrame:
    return packing.pack(t(s, d, "documents"))


def p9_fill(s: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(t(s, d, "documents")))


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return garbled.garbled_documents(t(s, d, "documents"))


def p10_restored(s: SparkSession, d: str) -> DataFrame:
    return garbled.restored(t(s, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p8_ids, p9_packed, p9_fill, p10_found, p10_restored)}
#: Tokenising, packing and restoring are beyond SQL; they are tested against other implementations and round trips.
SQL: dict[str, str] = {}
