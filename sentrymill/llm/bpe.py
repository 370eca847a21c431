"""Encoding of texts with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern; each word's bytes are merged by rank. A word is
held as contiguous arrays: the boundaries of its parts and, beside each, the rank of joining the part
with its right neighbour. The smallest rank is found by scanning, its right boundary is deleted, and
the two ranks next to it are refreshed, until no neighbours can be joined. For words of more than
``SCAN_LIMIT`` bytes the scan would be quadratic, so that the same merges are taken from a heap.

Words repeat, so each Python worker keeps the ids of those it has met, up to a bound, from task to task. The
vocabulary is read once on the driver and broadcast: its size is fixed (under 1 MB).

Defined results: null and empty texts give the empty list; blank texts give the ids of their blanks;
strings that look like special tokens are ordinary text; texts of any length are encoded whole;
repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sentrymill.sources.tables import spread

#: Fixed value: the pattern that the byte_bpe_50k vocabulary was made for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCAN_LIMIT = 96
_NONE = 1 << 60
_CACHED_WORDS = 400_000
_CACHED_LENGTH = 48


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.words: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.cache: dict[str, tuple[int, ...]] = {}

    def encode_bytes(self, word: bytes) -> list[int]:
        known = self.ranks.get(word)
        if known is not None:
            return [known]
        return self._scanned(word) if len(word) <= SCAN_LIMIT else self._heaped(word)

    def _scanned(self, word: bytes) -> list[int]:
        ranks = self.ranks.get
        starts = list(range(len(word) + 1))
        joined = [ranks(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
        while joined:
            least = min(joined)
            if least == _NONE:
                break
            i = joined.index(least)
            del starts[i + 1]
            del joined[i]
            if i < len(joined):
                joined[i] = ranks(word[starts[i] : starts[i + 2]], _NONE)
            if i:
                joined[i - 1] = ranks(word[starts[i - 1] : starts[i + 1]], _NONE)
        return [self.ranks[word[a:b]] for a, b in zip(starts, starts[1:])]

    def _heaped(self, word: bytes) -> list[int]:
        n, ranks = len(word), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (middle := after[i]) >= n or after[middle] != end:
                continue
            alive[middle] = 0
            after[i] = end
            if end < n:
                before[end] = i
                if (r := ranks(word[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            left = before[i]
            if left >= 0 and (r := ranks(word[left:end])) is not None:
                heapq.heappush(heap, (r, left, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return out

    def _word(self, word: str) -> tuple[int, ...]:
        """The ids of a word that isn't held yet."""
        ids = tuple(self.encode_bytes(word.encode()))
        if len(word) <= _CACHED_LENGTH:
            if len(self.cache) >= _CACHED_WORDS:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, fresh = self.cache.get, self._word
        return list(chain.from_iterable([known(w) or fresh(w) for w in self.words(text)]))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, fresh = self.cache.get, self._word
        return sum([len(known(w) or fresh(w)) for w in self.words(text)])


#: The encoder of the vocabulary and pattern used last, for the tasks that a Python worker runs one after the other.
_LAST: dict[tuple[bytes, str], BytePairEncoder] = {}


def shared_encoder(content: bytes, pattern: str) -> BytePairEncoder:
    key = (sha256(content).digest(), pattern)
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = BytePairEncoder(read_ranks(content), pattern)
    return _LAST[key]


def _batches(vocabulary, pattern: str, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(vocabulary.value, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                if counts_only:
                    counts = pa.array([encoder.count(t) for t in b.column(1).to_pylist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0), counts], names=["key", "n_tokens"])
                    continue
                rows = [encoder.encode(t) for t in b.column(1).to_pylist()]
                lengths = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
                flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(lengths.sum()))
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["key", "ids"])

    return run


def broadcast_vocabulary(spark: SparkSession, path: str = VOCABULARY):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(texts: DataFrame, key: str, text: str, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, ids) of every row."""
    run = _batches(broadcast_vocabulary(texts.sparkSession, path), pattern, False)
    kind = texts.schema[key].dataType.simpleString()
    return spread(texts.select(key, text)).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(texts: DataFrame, key: str, text: str, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, n_tokens) of every row."""
    run = _batches(broadcast_vocabulary(texts.sparkSession, path), pattern, True)
    kind = texts.schema[key].dataType.simpleString()
    return spread(texts.select(key, text)).mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)
