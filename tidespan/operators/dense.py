"""Per-key aggregates that stay balanced when a few keys own most rows.

Keys are dictionary-encoded to dense codes. Every input split, hot keys included,
is reduced where it lies: numpy scatter-reduces its rows into one accumulator slot per
code and the split hands on array blocks of ``BLOCK`` codes. The blocks are summed by a
second, distributed reduction whose input is (splits x distinct keys) numbers at most and
never depends on how the rows spread over the keys. No row is shuffled by key, so no task
can become the task of the hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Codes of one array block.
BLOCK = 1024
#: Most keys for which a dictionary goes to the executors; 8 to a few dozen bytes each.
MAX_DICTIONARY = 200_000

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_I64 = np.iinfo(np.int64)


def dense_aggregate(
    df: DataFrame,
    key: str,
    sums: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    maxs: dict[str, Column] | None = None,
    *,
    max_dictionary: int = MAX_DICTIONARY,
) -> DataFrame:
    """Count, sums, minima and maxima of integer expressions per value of ``key``.

    Result: ``key``, ``n`` (rows, repeated ones included), then for each entry of ``sums``,
    ``mins`` and ``maxs`` its BIGINT column. Defined cases:

    * a null key is a group of its own, with a null in ``key``;
    * null values are left out; a group without any value gets null, as in SQL;
    * sums wrap at 64 bits; rows repeated count each time;
    * an empty input gives no rows; further columns of ``df`` are never read, so their
      names can't clash. ``n`` may not be used as a name of an aggregate.

    The dictionary is broadcast while it has at most ``max_dictionary`` keys (checked by
    counting no further than that). Beyond it, each split encodes its own keys and the
    blocks are one code wide; the result is the same.
    """
    sums, mins, maxs = sums or {}, mins or {}, maxs or {}
    values = [*((k, "sum", c) for k, c in sums.items()), *((k, "min", c) for k, c in mins.items()), *((k, "max", c) for k, c in maxs.items())]
    names = [k for k, _, _ in values]
    if len({key, "n", *names}) != len(names) + 2:
        raise ValueError("the key, n and the aggregates need different names")
    kind = df.schema[key].dataType
    slim = df.select(F.col(key).alias("k"), *(c.cast("bigint").alias(f"v{i}") for i, (_, _, c) in enumerate(values)))
    ops = [how for _, how, _ in values]

    found = df.select(F.col(key).alias("k")).where(F.col("k").isNotNull()).distinct().limit(max_dictionary + 1)
    keys = found.toArrow().column("k").combine_chunks()
    if len(keys) <= max_dictionary:
        return _by_blocks(slim, keys.take(pc.sort_indices(keys)), kind, key, names, ops)
    return _by_split_dictionary(slim, kind, key, names, ops, max_dictionary)


def _accumulators(ops: list[str], size: int) -> list[np.ndarray]:
    """Counts, then for each aggregate the number of values and the accumulator."""
    start = {"sum": 0, "min": _I64.max, "max": _I64.min}
    out = [np.zeros(size, np.int64)]
    for how in ops:
        out += [np.zeros(size, np.int64), np.full(size, start[how], np.int64)]
    return out


def _scatter(acc: list[np.ndarray], ops: list[str], codes: np.ndarray, batch: pa.RecordBatch) -> None:
    size = len(acc[0])
    acc[0] += np.bincount(codes, minlength=size)
    for i, how in enumerate(ops):
        column = batch.column(i + 1)
        at = codes
        if column.null_count:
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            at, column = codes[valid], column.drop_null()
        x = column.to_numpy(zero_copy_only=False)
        acc[1 + 2 * i] += np.bincount(at, minlength=size)
        {"sum": np.add, "min": np.minimum, "max": np.maximum}[how].at(acc[2 + 2 * i], at, x)


def _finish(key: str, names: list[str], ops: list[str], df: DataFrame) -> DataFrame:
    """``df``: k and one row of partial accumulators a0.. for each code and split."""
    reduce = {"sum": F.sum, "min": F.min, "max": F.max}
    parts = [F.sum("a0").alias("n")]
    for i, how in enumerate(ops):
        has = F.col(f"a{1 + 2 * i}")
        parts.append(reduce[how](F.when(has > 0, F.col(f"a{2 + 2 * i}"))).alias(names[i]))
    return df.groupBy(F.col("k").alias(key)).agg(*parts)


def _by_blocks(slim: DataFrame, keys: pa.Array, kind: T.DataType, key: str, names: list[str], ops: list[str]) -> DataFrame:
    size = len(keys) + 1  # the last code is the null key's
    shipped = slim.sparkSession.sparkContext.broadcast(keys)
    width = 1 + 2 * len(ops)

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, acc, seen = shipped.value, _accumulators(ops, size), False
        for batch in batches:
            if batch.num_rows:
                seen = True
                found = pc.index_in(batch.column(0).cast(dictionary.type), value_set=dictionary)
                _scatter(acc, ops, pc.fill_null(found, size - 1).to_numpy(zero_copy_only=False), batch)
        if seen:
            for low in range(0, size, BLOCK):
                part = [a[low : low + BLOCK] for a in acc]
                if part[0].any():
                    yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), *(pa.array([p], pa.list_(pa.int64())) for p in part)], names=["low", *(f"a{i}" for i in range(width))])

    fields = ", ".join(f"a{i} array<bigint>" for i in range(width))
    blocks = slim.mapInArrow(splits, f"low bigint, {fields}")
    cells = blocks.select("low", F.posexplode(F.arrays_zip(*(f"a{i}" for i in range(width)))).alias("pos", "cell")).where("cell.a0 > 0").select((F.col("low") + F.col("pos")).alias("k"), "cell.*")
    summed = _finish("code", names, ops, cells)
    lookup = pa.table({"code": pa.array(range(size), pa.int64()), "key_value": pa.concat_arrays([keys, pa.nulls(1, keys.type)])})
    decoded = slim.sparkSession.createDataFrame(lookup, T.StructType([T.StructField("code", T.LongType()), T.StructField("key_value", kind)]))
    # at most one row for each key of the dictionary, whose size was checked above
    return summed.join(F.broadcast(decoded), "code").select(F.col("key_value").alias(key), "n", *names)


def _by_split_dictionary(slim: DataFrame, kind: T.DataType, key: str, names: list[str], ops: list[str], most: int) -> DataFrame:
    width = 1 + 2 * len(ops)

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield from reduce(held)
                held, rows = [], 0
        if rows:
            yield from reduce(held)

    def reduce(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        whole = table.to_batches()[0]
        encoded = pc.dictionary_encode(whole.column(0), null_encoding="encode")
        acc = _accumulators(ops, len(encoded.dictionary))
        _scatter(acc, ops, encoded.indices.to_numpy(zero_copy_only=False), whole)
        yield pa.RecordBatch.from_arrays([encoded.dictionary, *(pa.array(a) for a in acc)], names=["k", *(f"a{i}" for i in range(width))])

    schema = T.StructType([T.StructField("k", kind), *(T.StructField(f"a{i}", T.LongType()) for i in range(width))])
    return _finish(key, names, ops, slim.mapInArrow(splits, schema))


def heavy_keys(df: DataFrame, key: str, one_in: int) -> DataFrame:
    """The keys that each hold at least one row in ``one_in`` of ``df``; columns ``key`` and ``n``.

    All rows count towards the total, those with a null key too; a null key is never listed.
    An empty input gives no rows.
    """
    counts = dense_aggregate(df, key)
    total = df.select(F.count(F.lit(1))).scalar()  # reads no column
    return counts.where(F.col(key).isNotNull() & (F.col("n") * one_in >= total))
