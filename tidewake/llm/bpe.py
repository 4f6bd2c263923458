"""Byte-level BPE of a whole corpus with a public tokenizer (problem 8).

A partition's texts are cut into words by the tokenizer's pattern; its distinct words are laid out as one array of
byte symbols. A pair occurrence index maps each mergeable pair to all its positions in that array. Active ranks are
applied in ascending order, each to all of its positions at once (numpy), and only the lists of the pairs that a
merge touches are updated. The ids of a text are then gathered from those of its words.

The scan reads two columns and nothing is shuffled. The tokenizer's file is a parameter; the driver reads it and sends
it to the workers (a vocabulary has a fixed size), which need no such file.

Cases: null and empty text give the empty list; blank text is text (its ids are those of its white space); strings
of special tokens inside a text are ordinary text; a text of any length and a word of any length are encoded whole;
repeated texts cost one look-up; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidewake.session import spread

#: The public vocabulary and its pattern of words.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Words of a worker that are kept between batches.
KEPT = 2_000_000
_NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndexBPE:
    """A byte-level BPE vocabulary, and the encoding of many words at once by a pair occurrence index."""

    def __init__(self, path: str, text: str | None = None) -> None:
        """``text``: what the file of ``path`` holds, where it is not there."""
        model = json.loads(Path(path).read_text(encoding="utf-8") if text is None else text)["model"]
        vocab: dict[str, int] = model["vocab"]
        self.byte_id = np.zeros(256, np.int32)
        for letter, b in byte_letters().items():
            self.byte_id[b] = vocab[letter]
        self.width = np.int64(max(vocab.values()) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.words = regex.compile(WORDS)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat: list[np.ndarray] = []
        self.start, self.length, self.filled = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, _NONE where it doesn't merge (or one of them is a gap, -1)."""
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = np.full(int(size.sum()) + len(words) + 1, -1, np.int32)
        inside = np.ones(len(sym), bool)
        inside[np.concatenate(([0], np.cumsum(size + 1)))] = False  # gaps before, between and after the words
        sym[inside] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        after[-1] = len(sym) - 1
        before[0] = 0
        live = np.ones(len(sym), bool)
        rank = np.append(self.rank_of(sym[:-1], sym[1:]), _NONE)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enter positions into the index under the ranks they now have."""
            at = at[rank[at] != _NONE]
            if not at.size:
                return
            at = at[np.argsort(rank[at], kind="stable")]
            r = rank[at]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for one in np.split(at, cuts) if cuts.size else (at,):
                k = int(rank[one[0]])
                if k in index:
                    index[k].append(one)
                else:
                    index[k] = [one]
                    heapq.heappush(active, k)

        note(np.flatnonzero(rank != _NONE))
        while active:
            k = heapq.heappop(active)
            lists = index.pop(k)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[(rank[at] == k) & live[at]]
            if not at.size:
                continue
            right = after[at]
            if at.size > 1 and (touch := right[:-1] == at[1:]).any():
                # a run of overlapping occurrences (aaaa) merges from its left end, every other one
                place = np.arange(at.size)
                begin = np.maximum.accumulate(np.where(np.concatenate(([True], ~touch)), place, 0))
                keep = (place - begin) % 2 == 0
                at, right = at[keep], right[keep]
            beyond = after[right]
            sym[at] = self.made[k]
            live[right] = False
            rank[right] = _NONE
            after[at] = beyond
            before[beyond] = at
            left = before[at]
            rank[at] = self.rank_of(sym[at], sym[beyond])
            rank[left] = self.rank_of(sym[left], sym[after[left]])
            note(np.unique(np.concatenate((at, left))))
        out = sym[live]
        gaps = np.flatnonzero(out < 0)
        return out[out >= 0], np.diff(gaps) - 1

    def learn(self, words: list[str]) -> None:
        """Encode words not met before and keep their ids."""
        ids, n = self.merge([w.encode("utf-8", "surrogatepass") for w in words])
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.start = np.concatenate((self.start, self.filled + np.cumsum(n) - n))
        self.length = np.concatenate((self.length, n))
        self.flat = [np.concatenate((*self.flat, ids))]
        self.filled += len(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the bounds of each text in it."""
        if len(self.place) > KEPT:
            self.forget()
        cut = [self.words.findall(t) if t else [] for t in texts]
        fresh = {w for ws in cut for w in ws if w not in self.place}
        if fresh:
            self.learn(sorted(fresh))
        of = np.fromiter((self.place[w] for ws in cut for w in ws), np.int64)
        n = self.length[of]
        bounds = np.concatenate(([0], np.cumsum(n)))
        pick = np.repeat(self.start[of] - bounds[:-1], n) + np.arange(bounds[-1])
        ids = self.flat[0][pick] if self.flat else np.zeros(0, np.int32)
        return ids, bounds[np.concatenate(([0], np.cumsum([len(ws) for ws in cut], dtype=np.int64)))]


#: Vocabularies of this worker, by path.
_LOADED: dict[str, PairIndexBPE] = {}


def tokenizer(path: str, text: Callable[[], str]) -> PairIndexBPE:
    if path not in _LOADED:
        _LOADED[path] = PairIndexBPE(path, text())
    return _LOADED[path]


def _encoder(spark: SparkSession, path: str, lengths: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    sent = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, lambda: sent.value)
        for b in batches:
            ids, bounds = bpe.encode(b.column(1).to_pylist())
            if lengths:
                yield pa.record_batch([b.column(0), pa.array(np.diff(bounds))], names=["doc_id", "n_tokens"])
            else:
                yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return run


def encode_corpus(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids`` of every document, without special tokens."""
    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(_encoder(documents.sparkSession, path, False), "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` of every document, by the same encoding."""
    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(_encoder(documents.sparkSession, path, True), "doc_id long, n_tokens long")
