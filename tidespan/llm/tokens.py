"""Byte-level BPE encoding of a corpus with a public tokenizer's vocabulary.

The merges of a pre-token run off a rank queue: a bucket of linked-list positions per merge
rank, and a hierarchy of 64-bit bitmaps over the buckets in which find-first-set gives the
next rank. Entries are never taken out of a bucket; those that no longer hold are skipped.
A pre-token of n bytes costs O(n) queue steps, so a text that is one word is no problem.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabularies lie, unless a path is given.
VOCABULARIES = "/opt/tokenizers"
#: How byte_bpe_50k splits text before its merges; a fixed value of the vocabulary.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens that a worker remembers, and the longest of them.
_REMEMBERED, _LONGEST = 150_000, 40
#: Ids of a batch that is handed on.
_FLUSH = 2_000_000


@dataclass(frozen=True)
class Vocabulary:
    """``pairs``: row r holds the two ids that merge r joins into ``first + r``; ``of_byte``: the id of each byte."""

    pairs: np.ndarray
    of_byte: np.ndarray
    first: int


def load_vocabulary(path: str | None = None) -> Vocabulary:
    """Reads a byte-level BPE in the ``tokenizers`` JSON format; ``path`` defaults to byte_bpe_50k."""
    with open(path or os.path.join(VOCABULARIES, "byte_bpe_50k.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    pairs = np.array([(ids[a], ids[b]) for a, b in merges], np.int32).reshape(-1, 2)
    first = ids["".join(merges[0])]
    # the format writes a byte that is no visible Latin-1 character as the next character from U+0100 on
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    of_byte = np.array([ids[chr(b if b in visible else next(others))] for b in range(256)], np.int32)
    if any(ids[a + b] != first + r for r, (a, b) in enumerate(merges)) or (pairs >= first + np.arange(len(pairs))[:, None]).any() or first + len(pairs) > 1 << 16:
        raise ValueError("the ids of merged tokens must follow the order of the merges")
    return Vocabulary(pairs, of_byte, first)


class RankQueue:
    """Buckets of positions by rank; three levels of 64-bit bitmaps find the lowest rank in use."""

    __slots__ = ("buckets", "low", "middle", "top")

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * (ranks // 64 + 1)
        self.middle = [0] * (len(self.low) // 64 + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.middle[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank in use and its positions in order; it is empty afterwards."""
        i = (self.top & -self.top).bit_length() - 1
        bits = self.middle[i]
        word = (i << 6) + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        lowest = bits & -bits
        rank = (word << 6) + lowest.bit_length() - 1
        self.low[word] = bits ^ lowest
        if bits == lowest:
            self.middle[i] ^= 1 << (word & 63)
            if not self.middle[i]:
                self.top ^= 1 << i
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class Encoder:
    """Encodes texts with a ``Vocabulary``; special tokens' strings are ordinary text."""

    def __init__(self, vocabulary: Vocabulary):
        self._ranks = {(int(a) << 16) | int(b): r for r, (a, b) in enumerate(vocabulary.pairs)}
        self._of_byte = vocabulary.of_byte.tolist()
        self._first = vocabulary.first
        self._queue = RankQueue(len(vocabulary.pairs))
        self._split = regex.compile(PRE_TOKENS).findall
        self._known: dict[str, list[int]] = {}

    def encode(self, text: str) -> array:
        """The ids of ``text``; an empty text has none."""
        out, known = array("i"), self._known
        for word in self._split(text):
            ids = known.get(word)
            if ids is None:
                ids = self.merge(word.encode("utf-8", "surrogatepass"))
                if len(word) <= _LONGEST:
                    if len(known) >= _REMEMBERED:
                        known.clear()
                    known[word] = ids
            out.extend(ids)
        return out

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        of_byte, ranks, first, queue = self._of_byte, self._ranks, self._first, self._queue
        ids = [of_byte[b] for b in word]
        n = len(ids)
        for i in range(n - 1):
            rank = ranks.get(ids[i] << 16 | ids[i + 1])
            if rank is not None:
                queue.push(rank, i)
        if not queue.top:
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue.top:
            # a pair with the token of this merge ranks higher, so nothing is added to the bucket meanwhile
            rank, positions = queue.pop()
            token = first + rank
            for i in positions:
                j = after[i]
                if j >= n or ids[i] < 0 or ranks.get(ids[i] << 16 | ids[j]) != rank:
                    continue
                ids[i], ids[j] = token, -1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    new = ranks.get(token << 16 | ids[k])
                    if new is not None:
                        queue.push(new, i)
                h = before[i]
                if h >= 0:
                    new = ranks.get(ids[h] << 16 | token)
                    if new is not None:
                        queue.push(new, h)
        return [x for x in ids if x >= 0]


_encoders: dict[str, Encoder] = {}


def _encoder(shipped: Broadcast) -> Encoder:
    """The worker's encoder of a broadcast vocabulary; it keeps what it has learned for later tasks."""
    vocabulary = shipped.value
    key = f"{len(vocabulary.pairs)} {hash(vocabulary.pairs.tobytes())}"
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def share_vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """A vocabulary for the executors: eight bytes a merge, whatever the corpus."""
    return spark.sparkContext.broadcast(load_vocabulary(path))


def encode_texts(df: DataFrame, row_id: str, text: str, *, vocabulary: str | None = None) -> DataFrame:
    """``row_id`` and ``ids`` (ARRAY<INT>) of every row, without special tokens.

    Defined cases: a null and an empty text have an empty list; blank texts are encoded like
    any other; strings of special tokens are ordinary text; repeated rows are each listed;
    texts may be of any length; an empty table gives no rows; further columns are ignored.
    """
    shipped = share_vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shipped).encode
        yield from _encoded(batches, encode, lambda flat, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32())), "ids")

    return df.select(row_id, text).mapInArrow(run, T.StructType([T.StructField(row_id, df.schema[row_id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def token_counts(df: DataFrame, row_id: str, text: str, *, vocabulary: str | None = None) -> DataFrame:
    """``row_id`` and ``n_tokens`` (BIGINT) of every row: the lengths of ``encode_texts``."""
    shipped = share_vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shipped).encode
        yield from _encoded(batches, encode, lambda flat, ends: pa.array(np.diff(np.array(ends, np.int64))), "n_tokens")

    return df.select(row_id, text).mapInArrow(run, T.StructType([T.StructField(row_id, df.schema[row_id].dataType), T.StructField("n_tokens", T.LongType())]))


def _encoded(batches: Iterator[pa.RecordBatch], encode: Callable[[str], array], column: Callable[[array, list[int]], pa.Array], name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        flat, ends, low = array("i"), [0], 0
        for i, text in enumerate(texts.to_pylist()):
            if text:
                flat.extend(encode(text))
            ends.append(len(flat))
            if len(flat) >= _FLUSH:
                yield pa.RecordBatch.from_arrays([ids.slice(low, i + 1 - low), column(flat, ends)], names=[batch.schema.names[0], name])
                flat, ends, low = array("i"), [0], i + 1
        if low < batch.num_rows:
            yield pa.RecordBatch.from_arrays([ids.slice(low), column(flat, ends)], names=[batch.schema.names[0], name])
