"""Merging overlapping intervals per entity into continuous periods, and the gaps between.

The state of an entity is an ordered map of disjoint intervals (``IntervalMap``); each
insertion finds the overlaps by binary search, merges them and updates the gaps. The same
map serves a bounded table here and a stream in ``tidespan.streaming.periods``.

An entity with more than ``TILE_ROWS`` rows is cut along the axis into tiles of about that
many rows, so that no task holds it whole; only the outermost periods of its tiles are
brought together afterwards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidespan.durable import durable

#: Rows of an entity above which it is cut into tiles, and those of a tile.
TILE_ROWS = 250_000
#: Entities that are cut at most, so that the cuts stay small. Only from 5 * 10**10 rows on does
#: the number of rows of a tile follow from it (10**7 rows over 2 * 10**12).
MOST_LARGE = 200_000


class IntervalMap:
    """Disjoint half-open intervals in order; intervals that touch are one.

    ``starts`` and ``stops`` are sorted; the gaps are what lies between neighbours, so an
    insertion that changes the intervals changes the gaps next to them with it.
    """

    __slots__ = ("starts", "stops")

    def __init__(self, starts: Iterable[int] = (), stops: Iterable[int] = ()):
        self.starts: list[int] = list(starts)
        self.stops: list[int] = list(stops)

    def insert(self, start: int, stop: int, changes: Counter | None = None) -> bool:
        """Adds [start, stop); an empty or inverted one adds nothing. Whether anything changed.

        ``changes`` is told of the periods and gaps that vanish (-1) and that are new (1).
        """
        if stop <= start:
            return False
        starts, stops = self.starts, self.stops
        low = bisect_left(stops, start)  # the first that reaches start
        high = bisect_right(starts, stop)  # the first beyond stop
        if high - low == 1 and starts[low] <= start and stops[low] >= stop:
            return False
        if changes is not None:
            changes.subtract(self._near(low, high))
        if low == high:
            starts.insert(low, start)
            stops.insert(low, stop)
        else:
            starts[low:high] = [min(start, starts[low])]
            stops[low:high] = [max(stop, stops[high - 1])]
        if changes is not None:
            changes.update(self._near(low, low + 1))
        return True

    def _near(self, low: int, high: int) -> list[tuple[str, int, int]]:
        """The periods ``low`` to ``high`` - 1 and the gaps that touch them, or that between ``low`` - 1 and ``low`` if there are none."""
        starts, stops = self.starts, self.stops
        periods = [("period", starts[i], stops[i]) for i in range(low, high)]
        return periods + [("gap", stops[i - 1], starts[i]) for i in range(max(low, 1), min(high, len(starts) - 1) + 1)]

    def gaps(self) -> Iterator[tuple[int, int]]:
        return zip(self.stops, self.starts[1:])


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", *, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The maximal covered periods and the gaps between successive ones, per entity ``keys``.

    Result: ``keys``, ``kind`` (``period`` or ``gap``), ``start``, ``stop`` (BIGINT, half-open).
    Touching intervals form one period. Defined cases: rows with a null in a key, start or
    stop, or with stop <= start, cover nothing; repeated and nested rows change nothing; an
    entity without cover has no rows; nothing is listed before its first and after its last
    period; an empty table gives no rows; further columns are ignored.
    """
    clash = {"kind", "start", "stop", "tile", "edge"} & set(keys)
    if clash:
        raise ValueError(f"rename these keys: {sorted(clash)}")
    slim = df.select(*keys, F.col(start).cast("bigint").alias("start"), F.col(stop).cast("bigint").alias("stop"))
    for c in (*keys, "start", "stop"):
        slim = slim.where(F.col(c).isNotNull())
    slim = slim.where(F.col("stop") > F.col("start"))

    # at most MOST_LARGE entities can be that large, and they get at most twice as many tiles
    least = F.greatest(F.lit(tile_rows), F.floor(df.select(F.count(F.lit(1))).scalar() / MOST_LARGE))
    large = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).withColumn("least", least)
    cuts = _cuts(slim, large, keys)
    if not cuts:
        return _states(slim.withColumn("tile", F.lit(0)), keys, None).select(*keys, "kind", "start", "stop")
    # two cuts for each TILE_ROWS rows of large entities at most, which MOST_LARGE bounds
    shipped = slim.sparkSession.sparkContext.broadcast(cuts)
    tiled = slim.mapInArrow(_tiler(shipped, keys, slim.schema), T.StructType([*slim.schema.fields, T.StructField("tile", T.IntegerType())]))
    # read three times
    return _stitch(durable(_states(tiled, keys, shipped)), keys)


def _cuts(slim: DataFrame, large: DataFrame, keys: list[str]) -> dict[tuple, list[int]]:
    """Where the axis is cut, for each large entity."""
    rows = large.collect()
    if not rows:
        return {}
    by_tiles: dict[int, list[tuple]] = {}
    for r in rows:
        by_tiles.setdefault(1 << int(r["n"] // r["least"]).bit_length(), []).append(tuple(r)[:-2])
    cuts: dict[tuple, list[int]] = {}
    for tiles, entities in by_tiles.items():
        share = [i / tiles for i in range(1, tiles)]
        marked = slim.join(F.broadcast(slim.sparkSession.createDataFrame(entities, slim.select(*keys).schema)), keys, "left_semi")
        at = marked.groupBy(*keys).agg(F.percentile_approx("start", share, 10_000).alias("at")).collect()
        cuts |= {tuple(r)[:-1]: sorted(set(r["at"])) for r in at}
    return cuts


def _tiler(shipped: Broadcast, keys: list[str], schema: T.StructType):
    """Merges the rows of large entities within a split first, then cuts them at the tiles."""
    arrow = to_arrow_schema(T.StructType([*schema.fields, T.StructField("tile", T.IntegerType())]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, IntervalMap] = {}
        cuts: dict[tuple, list[int]] = shipped.value
        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys)))))
            large = np.fromiter((k in cuts for k in names), bool, len(names))
            if not large.all():
                rest = batch.filter(pa.array(~large))
                yield _batch([*rest.columns, pa.nulls(rest.num_rows, pa.int32()).fill_null(0)], arrow)
            starts, stops = batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()
            for i in np.flatnonzero(large):
                state.setdefault(names[i], IntervalMap()).insert(starts[i], stops[i])
        for k, held in state.items():
            at, out = cuts[k], []
            for a, b in zip(held.starts, held.stops):
                tile = bisect_right(at, a)
                while tile < len(at) and at[tile] < b:
                    out.append((a, at[tile], tile))
                    a, tile = at[tile], tile + 1
                out.append((a, b, tile))
            yield _batch([*([x] * len(out) for x in k), *map(list, zip(*out))], arrow)

    return split


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _states(tiled: DataFrame, keys: list[str], large: Broadcast | None) -> DataFrame:
    """Keyed state over each (entity, tile): its periods and gaps.

    ``edge`` is true for the first and last period of a tile of a large entity. Rows come
    sorted by key, so that the state of a key is let go where the next begins.
    """
    fields = {f.name: f for f in tiled.schema}
    result = T.StructType([*(fields[k] for k in keys), T.StructField("tile", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("edge", T.BooleanType())])
    arrow = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in arrow]
        cut = large.value if large is not None else {}
        now, held = None, IntervalMap()

        def close() -> None:
            edges = now[:-1] in cut
            periods, gaps = len(held.starts), max(0, len(held.starts) - 1)
            for column, x in zip(out, now):
                column.extend([x] * (periods + gaps))
            out[-4].extend(["period"] * periods + ["gap"] * gaps)
            out[-3].extend(held.starts + held.stops[:-1])
            out[-2].extend(held.stops + held.starts[1:])
            out[-1].extend([edges and i in (0, periods - 1) for i in range(periods)] + [False] * gaps)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            starts, stops, tiles = (batch.column(len(keys) + i).to_pylist() for i in range(3))
            for k, a, b in zip(zip(*columns, tiles), starts, stops):
                if k != now:
                    if now is not None:
                        close()
                        if len(out[0]) >= 10_000:
                            yield _batch(out, arrow)
                            out = [[] for _ in arrow]
                    now, held = k, IntervalMap()
                held.insert(a, b)
        if now is not None:
            close()
            yield _batch(out, arrow)

    return tiled.select(*keys, "start", "stop", "tile").repartition(*keys, "tile").sortWithinPartitions(*keys, "tile").mapInArrow(run, result)


def _stitch(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Brings the outermost periods of neighbouring tiles together (two a tile at most)."""
    inner = pieces.where(~F.col("edge"))
    by = Window.partitionBy(*keys).orderBy("start", "stop")
    edges = pieces.where("edge").select(*keys, "tile", "start", "stop")
    # a gap within a tile lies between its two edges; one between tiles must be added
    before = F.lag("stop").over(by)
    opens = edges.withColumn("last", before).withColumn("last_tile", F.lag("tile").over(by))
    island = F.sum(F.when(F.col("last") == F.col("start"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    periods = opens.withColumn("island", island).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    gaps = opens.where((F.col("last") < F.col("start")) & (F.col("last_tile") != F.col("tile")))
    return (
        inner.select(*keys, "kind", "start", "stop")
        .unionByName(periods.select(*keys, F.lit("period").alias("kind"), "start", "stop"))
        .unionByName(gaps.select(*keys, F.lit("gap").alias("kind"), F.col("last").alias("start"), F.col("start").alias("stop")))
    )
