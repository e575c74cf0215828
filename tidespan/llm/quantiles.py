"""Percentiles of very large columns per group, from relative-error sketches that merge.

A sketch is a stack of relative-rank compactors. Level h holds values that stand for 2**h
of the input. A full compactor leaves one tail of its sorted buffer alone and halves the
other: of each pair one value, chosen by a coin, moves up a level. How far a compaction
reaches into the buffer follows the trailing ones of a counter, so values near the
protected tail are seldom touched and the error of a rank shrinks with its distance from
that tail. Sketches of partitions or days merge level by level, in an order that follows from
what they hold, so that the same sketches give the same result however they arrive.

Bound: with section size ``k`` the estimated rank of a value differs from its true rank by
at most ``rank_error(k)`` times the number of values on the protected side of it (three
standard deviations); groups that never filled a compactor are exact.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Values of a section; the first compactors have three sections on the side that is halved.
SECTION = 32
_SECTIONS, _LEAST_SECTION = 3, 4
#: Values of a split that are held before they are sketched.
_HELD = 2_000_000
#: Partial sketches of a group that one task merges at most, roughly, in the first round.
_FAN_IN = 64


def rank_error(section: int = SECTION) -> float:
    """The stated bound: three standard deviations of a rank, relative to the values beyond it."""
    return 3 * math.sqrt(0.0512 / _SECTIONS) / section


class _Compactor:
    __slots__ = ("values", "section", "width", "sections", "state", "coin")

    def __init__(self, section: float, sections: int = _SECTIONS, state: int = 0, coin: int = 0, values: np.ndarray | None = None):
        self.values = np.empty(0) if values is None else values
        self.section, self.sections, self.state, self.coin = section, sections, state, coin
        self.width = max(_LEAST_SECTION, 2 * round(section / 2))

    @property
    def capacity(self) -> int:
        return 2 * self.sections * self.width

    def grow(self) -> None:
        """More, narrower sections once this level was compacted often enough for them."""
        while self.state >= 1 << (self.sections - 1) and 2 * round(self.section / math.sqrt(2) / 2) >= _LEAST_SECTION:
            self.section /= math.sqrt(2)
            self.width = 2 * round(self.section / 2)
            self.sections *= 2

    def compact(self, high: bool, flip: int) -> np.ndarray:
        """Takes the unprotected part out of the buffer; returns the half of it that moves up."""
        values = np.sort(self.values)
        reach = min(self.sections, ((self.state + 1) & -(self.state + 1)).bit_length())  # trailing ones, plus one
        kept = self.capacity // 2 + (self.sections - reach) * self.width
        kept += (len(values) - kept) % 2
        part = values[: len(values) - kept] if high else values[kept:]
        self.values = values[len(values) - kept :] if high else values[:kept]
        self.coin = 1 - self.coin if self.state & 1 else flip
        self.state += 1
        self.grow()
        return part[self.coin :: 2]


class Sketch:
    """A mergeable sketch of numbers. ``high``: whether the largest values are protected, or the smallest."""

    __slots__ = ("section", "high", "n", "low_value", "high_value", "levels", "_seed")

    def __init__(self, section: int = SECTION, high: bool = True, seed: int = 0):
        self.section, self.high, self._seed = section, high, seed
        self.n, self.low_value, self.high_value = 0, math.inf, -math.inf
        self.levels = [_Compactor(section)]

    def update(self, values: np.ndarray) -> None:
        """Adds finite or infinite numbers; NaN isn't one."""
        if not len(values):
            return
        self.n += len(values)
        self.low_value, self.high_value = min(self.low_value, float(values.min())), max(self.high_value, float(values.max()))
        at = 0
        while at < len(values):
            base = self.levels[0]
            take = max(1, base.capacity - len(base.values))
            base.values = np.concatenate([base.values, values[at : at + take]])
            at += take
            self._settle()

    def merge(self, other: Sketch) -> None:
        """Adds what ``other`` has seen; both need the same section and protected side."""
        if (self.section, self.high) != (other.section, other.high):
            raise ValueError("sketches of different kinds don't merge")
        self.n += other.n
        self.low_value, self.high_value = min(self.low_value, other.low_value), max(self.high_value, other.high_value)
        for h, theirs in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(_Compactor(self.section))
            ours = self.levels[h]
            ours.state |= theirs.state
            ours.grow()
            ours.values = np.concatenate([ours.values, theirs.values])
        self._settle()

    def _settle(self) -> None:
        h = 0
        while h < len(self.levels):
            level = self.levels[h]
            if len(level.values) >= level.capacity:
                if h + 1 == len(self.levels):
                    self.levels.append(_Compactor(self.section))
                up = level.compact(self.high, self._flip(h))
                self.levels[h + 1].values = np.concatenate([self.levels[h + 1].values, up])
            else:
                h += 1

    def _flip(self, level: int) -> int:
        # the coin follows from what was seen, so that a task that runs again gives the same sketch
        self._seed = crc32(struct.pack("<qqq", self._seed, level, self.n))
        return (self._seed >> 7) & 1

    def quantiles(self, shares: list[float]) -> list[float | None]:
        """For each share the least value whose estimated rank is at least that share of all."""
        if not self.n:
            return [None] * len(shares)
        values = np.concatenate([c.values for c in self.levels])
        weight = np.concatenate([np.full(len(c.values), 1 << h, np.int64) for h, c in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        values, ranks = values[order], np.cumsum(weight[order])
        at = np.searchsorted(ranks, [max(1, math.ceil(q * self.n - 1e-9)) for q in shares])
        out = [float(x) for x in values[np.minimum(at, len(values) - 1)]]
        return [self.low_value if q <= 0 else self.high_value if q >= 1 else x for q, x in zip(shares, out)]

    def rank(self, value: float) -> int:
        """The estimated number of values that are at most ``value``."""
        return sum(int((c.values <= value).sum()) << h for h, c in enumerate(self.levels))

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<i?qqddi", self.section, self.high, self._seed, self.n, self.low_value, self.high_value, len(self.levels))]
        for c in self.levels:
            parts += [struct.pack("<dqqqi", c.section, c.sections, c.state, c.coin, len(c.values)), c.values.astype("<f8").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Sketch:
        head = struct.Struct("<i?qqddi")
        section, high, seed, n, low, top, count = head.unpack_from(data)
        out, at, each = cls(section, high, seed), head.size, struct.Struct("<dqqqi")
        out.n, out.low_value, out.high_value, out.levels = n, low, top, []
        for _ in range(count):
            width, sections, state, coin, size = each.unpack_from(data, at)
            at += each.size
            out.levels.append(_Compactor(width, sections, state, coin, np.frombuffer(data, "<f8", size, at).copy()))
            at += 8 * size
        return out


def sketch_groups(df: DataFrame, groups: list[str], value: Column, *, section: int = SECTION, high: bool = True) -> DataFrame:
    """A sketch of ``value`` for each combination of ``groups``: the groups, ``n`` and ``sketch`` (BINARY).

    Nulls and NaN are not values; further exclusions (a -1 for "not measured") belong into
    ``value`` as nulls. A group without a value isn't listed; a null is a group of its own;
    repeated rows count each time; an empty table gives no rows; columns of other names are
    ignored, ``groups`` may not be named ``n``, ``sketch``, ``salt``, ``raw``, ``content`` or ``value``.

    Every split sketches its own rows, so the rows of a group are never brought together;
    splits are merged in two rounds when there are many.
    """
    return _merged(_partial(df, groups, value, section, high), groups, section, high, None)


def merge_sketches(sketches: DataFrame, groups: list[str], *, section: int = SECTION, high: bool = True) -> DataFrame:
    """Merges the results of ``sketch_groups`` (of days, of parts of the rows) to coarser ``groups``."""
    rows = sketches.select(*groups, F.lit(None).cast("array<double>").alias("raw"), "sketch")
    return _merged(rows, groups, section, high, None)


def percentiles(df: DataFrame, groups: list[str], value: Column, shares: dict[str, float], *, section: int = SECTION, high: bool = True) -> DataFrame:
    """``sketch_groups`` read at once: the groups, ``n``, ``least``, a DOUBLE for each of ``shares``, ``greatest``."""
    return _merged(_partial(df, groups, value, section, high), groups, section, high, shares)


def read_percentiles(sketches: DataFrame, groups: list[str], shares: dict[str, float], *, section: int = SECTION, high: bool = True) -> DataFrame:
    """``merge_sketches`` to ``groups``, read at once as in ``percentiles``."""
    rows = sketches.select(*groups, F.lit(None).cast("array<double>").alias("raw"), "sketch")
    return _merged(rows, groups, section, high, shares)


def _partial(df: DataFrame, groups: list[str], value: Column, section: int, high: bool) -> DataFrame:
    """For each split and group: its values while a compactor would hold them, else its sketch."""
    if {"n", "sketch", "salt", "raw", "content", "value"} & set(groups):
        raise ValueError("rename the groups")
    slim = df.select(*groups, value.cast("double").alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("raw", T.ArrayType(T.DoubleType())), T.StructField("sketch", T.BinaryType())])
    arrow, exact = to_arrow_schema(schema), 2 * _SECTIONS * section

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _HELD:
                yield reduce(held)
                held, rows = [], 0
        if rows:
            yield reduce(held)

    def reduce(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.select(groups).append_column("at", pa.array(np.arange(table.num_rows)))
        code = np.zeros(table.num_rows, np.int64)
        for g in groups:  # mixed radix over the columns' own codes, renumbered each time so that it can't overflow
            own = pc.dictionary_encode(keys.column(g).combine_chunks(), null_encoding="encode")
            own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
            code = np.unique(code * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        values = table.column("value").to_numpy()[order]
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        ends = np.append(starts[1:], len(values))
        sketches: list[bytes | None] = [None] * len(starts)
        lengths = ends - starts
        for i in np.flatnonzero(lengths >= exact):
            s = Sketch(section, high, seed=int(starts[i]) * 31 + TaskContext.get().partitionId())
            s.update(values[starts[i] : ends[i]])
            sketches[i] = s.to_bytes()
        small = lengths < exact
        kept = np.repeat(small, lengths)
        offsets = np.concatenate([[0], np.cumsum(np.where(small, lengths, 0))]).astype(np.int32)
        raw = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[kept]))
        first = pa.array(order[starts])
        columns = [table.column(g).combine_chunks().take(first) for g in groups]
        return pa.RecordBatch.from_arrays([(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).cast(f.type) for c, f in zip([*columns, raw, pa.array(sketches, pa.binary())], arrow)], schema=arrow)

    return slim.mapInArrow(run, schema)


def _merged(partial: DataFrame, groups: list[str], section: int, high: bool, shares: dict[str, float] | None) -> DataFrame:
    splits = _splits(partial)
    if splits > _FAN_IN:
        rounds = F.pmod(F.xxhash64("raw", "sketch"), F.lit(max(2, math.isqrt(splits)))).cast("int")
        first = _merge_round(partial.select(*groups, rounds.alias("salt"), "raw", "sketch"), [*groups, "salt"], section, high, None)
        partial = first.select(*groups, F.lit(None).cast("array<double>").alias("raw"), "sketch")
    return _merge_round(partial.select(*groups, "raw", "sketch"), groups, section, high, shares)


def _splits(df: DataFrame) -> int:
    """Partitions of ``df``, or those that a shuffle would give: finding out what one gave would run it."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.rdd.getNumPartitions()


def _merge_round(partial: DataFrame, groups: list[str], section: int, high: bool, shares: dict[str, float] | None) -> DataFrame:
    """One sketch (or its percentiles) for each group of rows with ``raw`` values or a ``sketch``."""
    kinds = [partial.schema[g] for g in groups]
    if shares is None:
        result = [T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())]
    else:
        result = [T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("least", *shares, "greatest"))]
    schema = T.StructType([*kinds, *result])
    arrow, wanted = to_arrow_schema(schema), list((shares or {}).values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in arrow]
        now, raw, sketch = None, [], None

        def total() -> Sketch:
            s = sketch or Sketch(section, high, seed=crc32(repr(now).encode()))
            if raw:
                s.update(np.sort(np.concatenate(raw)))
            return s

        def close() -> None:
            s = total()
            found = [s.n, s.to_bytes()] if shares is None else [s.n, *s.quantiles([0.0, *wanted, 1.0])]
            for column, x in zip(out, [*now, *found]):
                column.append(x)

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(groups)))))
            lists, sketches = batch.column(len(groups)), batch.column(len(groups) + 1).to_pylist()
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            for i, key in enumerate(keys):
                if key != now:
                    if now is not None:
                        close()
                        if len(out[0]) >= 5_000:
                            yield ready()
                            out = [[] for _ in arrow]
                    now, raw, sketch = key, [], None
                if sketches[i] is None:
                    raw.append(values[offsets[i] : offsets[i + 1]])
                    if len(raw) > 4096:
                        sketch, raw = total(), []
                elif sketch is None:
                    sketch = Sketch.from_bytes(sketches[i])
                else:
                    sketch.merge(Sketch.from_bytes(sketches[i]))
        if now is not None:
            close()
            yield ready()

    # by content within a group: the order in which sketches come in must not matter
    ordered = partial.withColumn("content", F.xxhash64("raw", "sketch")).repartition(*groups).sortWithinPartitions(*groups, "content")
    return ordered.select(*groups, "raw", "sketch").mapInArrow(run, schema)
