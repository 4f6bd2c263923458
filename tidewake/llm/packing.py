"""Filling containers of fixed capacity with documents (problem 9): bulk-synchronous best-fit, decreasing.

Documents are range-sorted by size and so are the gaps. Both sorted lists are kept run-length encoded (as sizes are
whole tokens, there are at most ``capacity`` runs of documents and of gaps, whatever the corpus), which makes a
successor sweep exact and small: in each step the documents of one size, largest first, meet the smallest gaps that
hold them, one each, conflicts resolved by rank; the gaps shrink and the step repeats; what finds no gap opens new
containers. The result says which ranks of a size go to which containers. Single documents are never gathered: their
rank within their size comes from their place in the range-sorted table and per-partition counts, and a binary
search over the runs gives each its container.

A size that a third of all documents share is split by the range sort like any other.

Cases: null and empty text has no tokens and takes no room: one row with piece 0 and no container; a text longer than
a container is cut into full containers and a rest, a text of exactly the capacity is not cut; equal sizes are ranked
by doc_id; repeated texts are packed each; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.bpe import TOKENIZER, token_counts
from tidewake.session import materialise

CAPACITY = 2048
#: One rank space per size in a sorted key of 63 bits.
_RANKS = 1 << 46


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (size, first rank, first container, offset) and the number of containers for ``counts[size]`` documents each."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_sizes: list[int] = []
    runs: list[tuple[int, int, int, int]] = []
    containers = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_sizes, gap)
            gaps[gap].append((first, n))

    for size in sorted((s for s in counts if s > 0), reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(open_sizes, size)
            if at == len(open_sizes):
                fresh = -(-left // (capacity // size))
                put(capacity, containers, fresh)
                containers += fresh
                continue
            gap = open_sizes[at]
            first, n = gaps[gap].pop()
            take = min(n, left)
            runs.append((size, rank, first, capacity - gap))
            if take < n:
                gaps[gap].append((first + take, n - take))
            if not gaps[gap]:
                del gaps[gap], open_sizes[at]
            put(gap - size, first, take)
            rank, left = rank + take, left - take
    return np.array(runs, np.int64).reshape(-1, 4), containers


def pieces(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, size``: one row per document, or per part of a document longer than a container."""
    n = F.col("n_tokens")
    return sizes.select("doc_id", n, F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / capacity) - 1, F.lit(0)).cast("int"))).alias("piece")).select("doc_id", "piece", F.least(n - F.col("piece") * capacity, F.lit(capacity)).alias("size"))


def _assigner(starts: np.ndarray, offsets: np.ndarray, runs: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    keys = runs[:, 0] * _RANKS + runs[:, 1]
    order = np.argsort(keys)
    keys, first, begin, at = keys[order], runs[order, 1], runs[order, 2], runs[order, 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, place = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy()
            filled = size > 0
            # rank within the size: distance from where the size begins in this sorted part, plus those in the parts before
            part = np.searchsorted(starts, place, side="right") - 1
            rank = np.where(filled, place - starts[part] + offsets[part], 0)
            r = np.maximum(np.searchsorted(keys, size * _RANKS + rank, side="right") - 1, 0)
            if not len(keys):
                container = offset = np.zeros(len(size), np.int64)
            else:
                container, offset = begin[r] + rank - first[r], at[r]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(container, mask=~filled), pa.array(offset, mask=~filled)], names=["doc_id", "piece", "n_tokens", "container", "start"])

    return run


def pack(documents: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, n_tokens, container, start``: where each document (or part) lies, start being its first token's place."""
    # a range sort samples its input before it reads it: texts are tokenised once, their sizes read twice
    sized = pieces(materialise(token_counts(documents, path)), capacity)
    # sorted once and kept, so that places don't change between the two passes over it
    kept = materialise(sized.repartitionByRange("size", "doc_id", "piece").sortWithinPartitions("size", "doc_id", "piece").withColumn("place", F.monotonically_increasing_id()))
    # sizes and sorted parts only: at most ``capacity`` rows more than there are partitions
    runs = kept.groupBy("size", F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n")).orderBy("start").collect()
    counts: dict[int, int] = {}
    offsets = []
    for x in runs:
        offsets.append(counts.get(x["size"], 0))
        counts[x["size"]] = counts.get(x["size"], 0) + x["n"]
    plan, _ = sweep({s: n for s, n in counts.items() if s}, capacity)
    starts = np.array([x["start"] for x in runs] or [0], np.int64)
    return kept.mapInArrow(_assigner(starts, np.array(offsets or [0], np.int64), plan), "doc_id long, piece int, n_tokens long, container long, start long")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, the least number of containers that could hold them, and the share of room used."""
    one = packed.agg(F.coalesce(F.max("container") + 1, F.lit(0)).alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return one.select("n_containers", "n_tokens", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"), F.try_divide(F.col("n_tokens"), F.col("n_containers") * capacity).alias("fill"))
