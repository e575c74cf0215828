"""Filling containers of one capacity with items of varying length (minimum bin slack).

Items of equal length are interchangeable, so the whole corpus is packed as a histogram of
at most ``capacity`` lengths: a bin takes the longest length left and, by subset-sum dynamic
programming over a bitset of reachable fills, the combination of the other lengths that
leaves least slack. The same combination is used for as many bins as the counts allow, then
it is removed and the search goes on. What the plan says per length is then applied to the
items by their rank among those of their length, without bringing a length together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidespan.durable import durable

#: Most containers' capacity. The plan is made on the driver, from a histogram of at most that many
#: lengths whatever the number of items; at this capacity it took 26 s at most (0.2 s at 2,048).
MOST_CAPACITY = 1 << 15
#: Items of a length that are ranked in one task, roughly.
_RANKED = 200_000


@dataclass(frozen=True)
class Slot:
    """Items ``first`` .. ``last`` - 1 of a length, ``each`` to a bin, go to the bins from ``bin`` on."""

    length: int
    first: int
    last: int
    each: int
    bin: int


def fullest(largest: int, lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset with ``largest`` in it that leaves least of ``capacity``; ``lengths`` descending."""
    room = capacity - largest
    mask = (1 << (room + 1)) - 1
    reach, steps, goal = 1, [], 1 << room
    for length in lengths:
        if length > room or reach & goal:
            continue
        left = min(counts[length] - (length == largest), room // length)
        before, many = reach, 1
        while left > 0:  # copies by doubling
            take = min(many, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            many *= 2
        if reach != before:
            steps.append((length, before))
    fill, chosen = reach.bit_length() - 1, {largest: 1}
    for length, before in reversed(steps):
        while not before >> fill & 1:
            fill -= length
            chosen[length] = chosen.get(length, 0) + 1
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[list[Slot], int]:
    """Slots for every item of ``histogram`` (length -> count, 1 to ``capacity``), and the number of bins."""
    counts = {k: v for k, v in histogram.items() if v}
    lengths = sorted(counts, reverse=True)
    used = dict.fromkeys(lengths, 0)
    slots, bins = [], 0
    while lengths:
        chosen = fullest(lengths[0], lengths, counts, capacity)
        times = min(counts[k] // m for k, m in chosen.items())
        for length, each in chosen.items():
            slots.append(Slot(length, used[length], used[length] + times * each, each, bins))
            used[length] += times * each
            counts[length] -= times * each
        bins += times
        lengths = [k for k in lengths if counts[k]]
    return slots, bins


def fill_containers(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """Every item's container: ``item``, ``part`` (from 0), ``part_start``, ``part_size``, ``container`` (from 0).

    An item of at most ``capacity`` has one part; a larger one is cut into parts of
    ``capacity`` and a rest. ``size`` counts units, such as tokens.

    Defined cases: an item with a null, negative or zero size has one part of size 0 and goes
    to a container spread by its hash, as it takes no space; repeated rows are items of their
    own; an empty table gives no rows; further columns are ignored. The items, whose sizes
    are costly, are written once to the checkpoint folder and read twice.
    """
    if not 1 <= capacity <= MOST_CAPACITY:
        raise ValueError(f"a capacity is 1 to {MOST_CAPACITY}")
    if item in {"part", "part_start", "part_size", "container", "bucket", "place", "size"}:
        raise ValueError("rename the item's column")
    sized = items.select(item, F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    last = F.greatest(F.lit(0), F.floor((F.col("size") - 1) / capacity)).cast("bigint")
    parts = durable(
        sized.select(item, "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part")).select(
            item,
            "part",
            (F.col("part") * capacity).alias("part_start"),
            F.least(F.col("size") - F.col("part") * capacity, F.lit(capacity)).cast("bigint").alias("part_size"),
        )
    )
    rows = parts.groupBy("part_size").count().collect()  # at most capacity + 1
    histogram = {r["part_size"]: r["count"] for r in rows}
    empty = histogram.pop(0, 0)
    slots, bins = plan_bins(histogram, capacity)
    spread = parts.where("part_size = 0").withColumn("container", F.pmod(F.xxhash64(item), F.lit(max(1, bins))))
    if not slots:
        return spread
    full = parts.where("part_size > 0")
    placed = _placed(_ranked(full, item, max(histogram.values())), slots)
    return placed.unionByName(spread) if empty else placed


def _ranked(full: DataFrame, item: str, most: int) -> DataFrame:
    """``place``: the rank (from 0) of each part among those of its size.

    A size is spread over hash buckets of about ``_RANKED`` parts; each bucket is ranked by
    itself and starts where the counts of the ones before it end.
    """
    buckets = max(1, most // _RANKED)
    spread = full.withColumn("bucket", F.pmod(F.xxhash64(item, "part"), F.lit(buckets)))
    within = Window.partitionBy("part_size", "bucket").orderBy(item, "part")
    if buckets == 1:
        return spread.withColumn("place", F.row_number().over(within).cast("bigint") - 1)
    before = Window.partitionBy("part_size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("part_size", "bucket").agg(F.count(F.lit(1)).alias("n")).select("part_size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = spread.withColumn("place", F.row_number().over(within).cast("bigint") - 1)
    return ranked.join(offsets, ["part_size", "bucket"]).withColumn("place", F.col("place") + F.col("offset"))


def _placed(ranked: DataFrame, slots: list[Slot]) -> DataFrame:
    table = sorted((s.length, s.first, s.each, s.bin) for s in slots)
    # a few slots for each of at most capacity lengths
    shipped = ranked.sparkSession.sparkContext.broadcast(np.array(table, np.int64))
    names = [c for c in ranked.columns if c not in ("bucket", "place", "offset")]
    schema = T.StructType([*(ranked.schema[c] for c in names), T.StructField("container", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, each, start = shipped.value.T
        at_length = np.flatnonzero(np.diff(length, prepend=-1))
        for batch in batches:
            sizes, places = (batch.column(i).to_numpy() for i in (len(names), len(names) + 1))
            slot = np.empty(len(sizes), np.int64)
            low = at_length[np.searchsorted(length[at_length], sizes)]
            order = np.lexsort((places, sizes))
            for run_start, run_end in _runs(sizes[order]):
                at = order[run_start:run_end]
                a = low[at[0]]
                b = np.searchsorted(length, sizes[at[0]], "right")
                slot[at] = a + np.searchsorted(first[a:b], places[at], "right") - 1
            container = start[slot] + (places - first[slot]) // each[slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(container)], schema=arrow)

    return ranked.select(*names, F.col("part_size").alias("size"), "place").mapInArrow(run, schema)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.diff(values, prepend=values[:1] - 1)) if len(values) else []
    yield from zip(starts, [*starts[1:], len(values)])
