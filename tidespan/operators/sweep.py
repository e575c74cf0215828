"""Depth at every position as maximal runs.

Each interval is a +1 where it starts and a -1 where it stops; the net changes per position,
summed in order, are the depth. Where the net change is not zero a run begins, so maximal
runs need no comparison with their neighbours.

A reference longer than ``TILE`` is cut into tiles: a running sum within each tile, and the
sums of the tiles before it carried in from a table with one row a tile. So neither a long
nor a crowded reference is one task's work; positions that many reads share are summed
before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidespan.functions.regions import Bands

#: Positions of a tile.
TILE = 1 << 20


def coverage(intervals: DataFrame, refs: DataFrame, *, stranded: bool = False, samples: list[str] | None = None, bands: str | None = None, tile: int = TILE) -> DataFrame:
    """``sample, tid, start, stop, fwd, rev`` runs that tile every reference of every sample from 0 to its length.

    ``intervals``: the result of ``read_intervals``. Unstranded runs change where the total
    changes and have it in ``cov``; stranded ones change where either strand does and have
    ``fwd``, ``rev`` and ``cov``. With ``bands`` (breaks such as ``"2,4"``) runs change where the
    band of the total changes and have ``band`` instead (stranded: ``band_fwd``, ``band_rev``).

    A reference without reads is one run of 0. ``samples`` (default: those of the intervals)
    are all listed, and intervals of others are left out; a null sample is one of its own.
    Empty references have no runs.
    """
    keys = ["group", "tid"]
    if samples is None:
        # as many as there are files, whatever their rows
        samples = [r["sample"] for r in intervals.select("sample").distinct().collect()]
    samples = list(dict.fromkeys(samples))
    known = refs.where(F.col("length") > 0).groupBy("tid").agg(F.max("length").alias("length"))
    longest = refs.agg(F.max("length")).first()[0] or 0
    tiles = tile if longest > tile else None
    sums = ["df", "dr"] if stranded else ["d"]
    changes = _changes(intervals, known, samples, keys, stranded)
    moved = F.col("edge")
    for c in sums:
        moved = moved | (F.col(c) != 0)
    changes = changes.where(moved)
    depth = _running(changes, keys, sums, tiles, bands is not None)
    levels = [F.col(f"{c}_sum") for c in sums]
    if bands is None:
        values = [("fwd", levels[0]), ("rev", levels[1]), ("cov", levels[0] + levels[1])] if stranded else [("cov", levels[0])]
    else:
        cut = Bands(bands)
        values = [(k, cut.label(level)) for k, level in zip(["band_fwd", "band_rev"] if stranded else ["band"], levels)]
        other = F.col("edge")
        for (_, now), level, c in zip(values, levels, sums):
            other = other | (now != cut.label(level - F.col(c)))
        depth = depth.where(other)
    runs = _with_stops(depth.select(*keys, "pos", *(["tile"] if tiles else []), *(["next"] if tiles and bands is None else []), *(v.alias(k) for k, v in values)), keys, [k for k, _ in values], tiles)
    return runs.withColumn("sample", _named(samples)).select("sample", "tid", "start", "stop", *(k for k, _ in values))


#: Samples up to which their numbers stand in the plan; more are joined.
_IN_PLAN = 64


def _numbered(intervals: DataFrame, samples: list[str | None]) -> DataFrame:
    """Intervals of ``samples`` with the sample's number as ``group``: it is small in shuffles, and a null sample has one too."""
    if len(samples) > _IN_PLAN:
        numbers = intervals.sparkSession.createDataFrame(list(enumerate(samples)), "group int, __sample string")
        # one row a file
        return intervals.join(F.broadcast(numbers), F.col("sample").eqNullSafe(F.col("__sample")))
    number = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(samples))):
        number = F.when(F.col("sample").eqNullSafe(F.lit(s).cast("string")), i).otherwise(number)
    return intervals.withColumn("group", number).where(F.col("group").isNotNull())


def _named(samples: list[str | None]) -> Column:
    return F.get(F.array(*(F.lit(s).cast("string") for s in samples)), F.col("group")) if samples else F.lit(None).cast("string")


def _changes(intervals: DataFrame, known: DataFrame, samples: list[str | None], keys: list[str], stranded: bool) -> DataFrame:
    """The net change at each position: ``keys``, pos, d (or df and dr for the strands), and whether the position is an ``edge``.

    Every reference has an edge at 0 and one at its length, where its last run closes. The
    positions are summed before they are shuffled, by position; the tiles' own shuffle comes
    after it with one row a position, as Spark has no shuffle by tile between the two halves
    of an aggregation by position.
    """
    inside = _numbered(intervals, samples).where((F.col("start") < F.col("stop")) & (F.col("start") < F.col("length")))
    none, one, less = (F.lit(x).cast("bigint") for x in (0, 1, -1))
    stop, back = F.least("stop", "length"), F.col("reverse")
    if stranded:
        parts = lambda at, d: F.struct(at.alias("pos"), F.when(back, none).otherwise(d).alias("df"), F.when(back, d).otherwise(none).alias("dr"))
    else:
        parts = lambda at, d: F.struct(at.alias("pos"), d.alias("d"))
    sums = ["df", "dr"] if stranded else ["d"]
    events = inside.select("group", "tid", F.inline(F.array(parts(F.col("start"), one), parts(stop, less)))).withColumn("edge", F.lit(False))
    listed = F.sequence(F.lit(0), F.lit(len(samples) - 1)) if samples else F.array().cast("array<int>")
    edges = known.select("tid", F.explode(F.array(none, F.col("length"))).alias("pos"))
    edges = edges.select(F.explode(listed).alias("group"), "tid", "pos", *(none.alias(c) for c in sums), F.lit(True).alias("edge"))
    return events.unionByName(edges).groupBy(*keys, "pos").agg(*(F.sum(c).alias(c) for c in sums), F.max("edge").alias("edge"))


def _running(changes: DataFrame, keys: list[str], sums: list[str], tile: int | None, edges: bool) -> DataFrame:
    """Adds ``<c>_sum``, the running sum of each of ``sums`` in order of ``pos``; with tiles also ``next``, the change that follows. Keeps ``edge`` if ``edges``."""
    if tile is None:
        by = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        return changes.select("*", *(F.sum(c).over(by).alias(f"{c}_sum") for c in sums))
    # shuffled here, so that the sums of the tiles are read from the same shuffle and not from the one by position; Spark shares
    # it if both branches read the same columns and filter none out, so the tile is never null and an edge is read by both or none
    at = F.coalesce(F.expr(f"pos div {tile}"), F.lit(0).cast("bigint")).alias("tile")
    tiled = changes.select(*keys, "pos", *sums, *(["edge"] if edges else []), at).repartition(*keys, "tile")
    by = Window.partitionBy(*keys, "tile").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    parts = [F.min("pos").alias("first"), *(F.sum(c).alias(f"{c}_tile") for c in sums), *([F.max("edge").alias("edge")] if edges else [])]
    carried = tiled.groupBy(*keys, "tile").agg(*parts)
    carried = carried.where(F.col("edge").isNotNull()) if edges else carried
    later = F.lead("first").over(Window.partitionBy(*keys).orderBy("tile")).alias("later")
    carried = carried.select(*keys, "tile", later, *(F.coalesce(F.sum(f"{c}_tile").over(before), F.lit(0)).alias(f"{c}_carry") for c in sums))
    # the same window tells the next change, so that runs of depth need no second one
    following = F.lead("pos").over(Window.partitionBy(*keys, "tile").orderBy("pos")).alias("following")
    inner = tiled.select("*", *(F.sum(c).over(by).alias(f"{c}_in") for c in sums), following)
    return _join_tiles(inner, carried, keys).select(*keys, "tile", "pos", *(["edge"] if edges else []), F.coalesce("following", "later").alias("next"), *sums, *((F.col(f"{c}_in") + F.col(f"{c}_carry")).alias(f"{c}_sum") for c in sums))


def _join_tiles(rows: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their tile's row."""
    on = [F.col(f"r.{k}") == F.col(f"t.{k}") for k in (*keys, "tile")]
    return rows.alias("r").join(tiles.alias("t"), on).select("r.*", *(f"t.{c}" for c in tiles.columns if c not in (*keys, "tile")))


def _with_stops(runs: DataFrame, keys: list[str], values: list[str], tile: int | None) -> DataFrame:
    """Each run stops where the next of its reference begins; the edge at the reference's end begins none."""
    by = Window.partitionBy(*keys, *(["tile"] if tile else [])).orderBy("pos")
    following = F.lead("pos").over(by)
    if tile is None:
        runs = runs.withColumn("next", following)
    elif "next" not in runs.columns:
        firsts = runs.groupBy(*keys, "tile").agg(F.min("pos").alias("first"))
        later = firsts.select(*keys, "tile", F.lead("first").over(Window.partitionBy(*keys).orderBy("tile")).alias("later"))
        runs = _join_tiles(runs.withColumn("next", following), later, keys).withColumn("next", F.coalesce("next", "later"))
    return runs.where(F.col("next").isNotNull()).select(*keys, F.col("pos").alias("start"), F.col("next").alias("stop"), *values)


def merge_equal_runs(runs: DataFrame, keys: list[str], values: list[str], *, tile: int = TILE) -> DataFrame:
    """Fuses adjacent runs with equal ``values``; for runs that weren't made by ``coverage``.

    A run is compared with its neighbour within a tile of the axis; a tile's first run looks
    at the last of the tile before it through a table of one row a tile. The islands are
    numbered the same way, so no reference is one task's work.
    """
    tiled = runs.select(F.struct(*keys).alias("group"), F.expr(f"start div {tile}").alias("tile"), "start", "stop", F.struct(*values).alias("value"))
    by = Window.partitionBy("group", "tile").orderBy("start", "stop")
    last = F.struct("stop", "value")
    tops = tiled.groupBy("group", "tile").agg(F.max(F.struct("start", "stop", "value")).alias("top"))
    over = Window.partitionBy("group").orderBy("tile")
    before = tops.select("group", "tile", F.lag(F.struct("top.stop", "top.value")).over(over).alias("before"))
    seen = _join_tiles(tiled.withColumn("own", F.lag(last).over(by)), before, ["group"]).withColumn("last", F.coalesce("own", "before"))
    same = (F.col("last.stop") == F.col("start")) & F.col("last.value").eqNullSafe(F.col("value"))
    fresh = seen.withColumn("fresh", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    numbered = fresh.withColumn("inner", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    carried = fresh.groupBy("group", "tile").agg(F.sum("fresh").alias("n")).select("group", "tile", F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"))
    islands = _join_tiles(numbered, carried, ["group"]).withColumn("island", F.col("inner") + F.col("carry"))
    out = islands.groupBy("group", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("value").alias("value"))
    return out.select(*(F.col(f"group.{k}").alias(k) for k in keys), "start", "stop", *(F.col(f"value.{v}").alias(v) for v in values))
