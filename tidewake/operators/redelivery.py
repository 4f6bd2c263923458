"""Messages delivered more than once (problem 6).

1. Storage: the slim rows (key, its hash, time of receipt, row) are written once, in one folder per time bucket, as they
   come; nothing is shuffled.
2. Screen: only hashes are spread, combined on the map side to one entry per hash and time bucket, so that a key with a
   third of all rows weighs no more than the buckets it is in. Each task reads its entries in order of bucket and holds
   one Bloom filter per bucket and one of all before (about four bytes per entry; nothing is broadcast). What no filter
   knows and came once in its bucket is definitely new and goes no further.
3. Verify: possible repeats are looked up exactly, by key, in only the buckets of the storage that matched.
4. The rows of keys that really repeat, except each key's first copy by (received_at, row_id), are the repeats.

Cases: rows without a key (null, empty, blank, prefix only) are all different messages; rows without receipt time
count as received last; ties in receipt time fall to row_id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.functions.keys import norm_key
from tidewake.session import materialise

#: Width of a time bucket in days, bits of filter per entry, hash functions.
BUCKET_DAYS, BITS, HASHES = 7, 16, 3
LAST = (1 << 62) // 1_000_000 * 1_000_000


def deliveries(df: DataFrame, key: str = "id", bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """``key, at (microseconds), row_id, bucket, h`` of every row that has a key."""
    at = F.coalesce(F.unix_micros("received_at"), F.lit(LAST))
    return df.select(norm_key(F.col(key)).alias("key"), at.alias("at"), "row_id").where(F.col("key").isNotNull()).withColumns({"bucket": F.floor(F.col("at") / F.lit(bucket_days * 86_400_000_000)).cast("long"), "h": F.xxhash64("key")})


class Bloom:
    """A Bloom filter over 64-bit hashes for so many entries."""

    def __init__(self, room: int, bits: int = BITS, k: int = HASHES) -> None:
        self.k, self.mask = k, np.uint64((1 << max(6, int(np.ceil(np.log2(max(1, room) * bits))))) - 1)
        self.words = np.zeros(int(self.mask) // 64 + 1, np.uint64)

    def _places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        step = (h >> np.uint64(33)) | np.uint64(1)
        for i in range(self.k):
            yield (h + step * np.uint64(i)) & self.mask

    def add(self, h: np.ndarray) -> Bloom:
        for p in self._places(h):
            np.bitwise_or.at(self.words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        return self

    def maybe(self, h: np.ndarray) -> np.ndarray:
        hit = np.ones(len(h), bool)
        for p in self._places(h):
            hit &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) != 0
        return hit


class Seen:
    """The filters of the buckets so far, behind generations of one filter of all of them, each twice as large as the last.

    An entry is tested against a filter per generation, however many buckets there are; only where one knows it are the
    buckets asked.
    """

    def __init__(self, room: int = 1 << 16) -> None:
        self.room, self.left = room, room
        self.all, self.by_bucket = [Bloom(room)], {}

    def close(self, bucket: int, h: np.ndarray) -> None:
        self.by_bucket[bucket] = Bloom(len(h)).add(h)
        while len(h):
            if not self.left:
                self.room *= 2
                self.left = self.room
                self.all.append(Bloom(self.room))
            self.all[-1].add(h[: self.left])
            h, self.left = h[self.left :], self.left - min(self.left, len(h))

    def matches(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """Places of possible repeats, by the bucket that may hold them."""
        known = np.zeros(len(h), bool)
        for g in self.all:
            known |= g.maybe(h)
        if (at := np.flatnonzero(known)).size:
            for bucket, bloom in self.by_bucket.items():
                if (found := at[bloom.maybe(h[at])]).size:
                    yield found, bucket


def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (hash, bucket, copies) in order of bucket in; possible repeats with each bucket that may hold copies out."""
    seen, now, mine = Seen(), None, []
    for batch in batches:
        hashes, buckets, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if now is not None and buckets[a] != now:
                seen.close(now, np.concatenate(mine).view(np.uint64))
                mine = []
            now = int(buckets[a])
            own = hashes[a:b]
            mine.append(own.copy())
            again = copies[a:b] > 1
            for found, old in seen.matches(own.view(np.uint64)):
                again[found] = True
                out.append((own[found], np.full(len(found), old, np.int64)))
            out.append((own[again], np.full(int(again.sum()), now, np.int64)))
        if sum(len(x) for x, _ in out):
            yield pa.record_batch([pa.array(np.concatenate([x[k] for x in out])) for k in (0, 1)], names=["h", "bucket"])


def possible_repeats(stored: DataFrame) -> DataFrame:
    """``h, bucket``: the hashes that may repeat, with every bucket that may hold a copy."""
    entries = stored.groupBy("h", "bucket").agg(F.count(F.lit(1)).alias("n")).repartition("h").sortWithinPartitions("bucket")
    return entries.mapInArrow(screen, "h long, bucket long").distinct()


def repeats(df: DataFrame, key: str = "id") -> DataFrame:
    """``row_id`` of every row whose key came before."""
    stored = materialise(deliveries(df, key), by=("bucket",))
    # written out, so that it has an exchange of its own and a hot hash on the other side can be split
    met = materialise(stored.join(materialise(possible_repeats(stored)), ["h", "bucket"], "left_semi").select("key", "at", "row_id"))
    first = materialise(met.groupBy("key").agg(F.min(F.struct("at", "row_id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first"))
    return met.join(first, "key").where(F.struct("at", "row_id") > F.col("first")).select("row_id")


def unique_messages(df: DataFrame, key: str = "id") -> DataFrame:
    """Exactly one copy of each message, all columns: the first received; rows without a key all stay."""
    return df.join(repeats(df, key), "row_id", "left_anti")
