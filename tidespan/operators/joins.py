"""Interval joins as equi-joins on bins.

Right intervals lie in bins about as wide as they are long, in a few classes of width, so that
a giant doesn't widen the bins of the others. A left interval looks into the bins of each class;
one that is much longer than a class's bins (a stretch without depth, say) would touch too many
of them and lies in bins of its own length instead, where the right ones look. A pair is kept in
the first bin that both touch, so it comes out once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The narrowest and widest bins in powers of two, and the powers from one class to the next.
_NARROW, _WIDE, _STEP = 7, 41, 2
#: A class with at most so many times the intervals of the next wider one isn't worth another look by every left row.
_MERGE = 4
#: A left interval looks into bins of up to so many powers of two less than its length.
_REACH = 4
#: Classes of left intervals that are too long for that.
_LONG = (12, 18, 24, 30, 41)
#: Classes of left intervals in a semi-join.
_LOOKS = (14, 20, 26, 32, 41)
#: Rows of the right side of a semi-join, in its bins, that Spark may broadcast at most.
MOST_IN_BINS = 500_000
#: Bytes that such a row takes in a broadcast (132 to 148, as measured).
ROW_IN_BIN = 150


def _bits(start: Column, stop: Column) -> Column:
    """The least power of two that is longer than the interval."""
    return F.length(F.bin(F.greatest(stop - start, F.lit(0))))


def bin_classes(regions: DataFrame) -> list[int]:
    """The classes of bins for ``regions``, as powers of two in order: one or a few."""
    level = F.lit(_NARROW) + F.greatest(F.lit(0), F.ceil((_bits(F.col("start"), F.col("stop")) - _NARROW) / _STEP)).cast("int") * _STEP
    counts = {r["level"]: r["n"] for r in regions.where(F.col("start") <= F.col("stop")).groupBy(F.least(level, F.lit(_WIDE)).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    present, kept = sorted(counts), []
    for this, wider in zip(present, [*present[1:], None]):
        if wider is not None and counts[this] <= _MERGE * counts[wider]:
            counts[wider] += counts[this]
        else:
            kept.append(this)
    return kept or [_NARROW]


def interval_join(left: DataFrame, right: DataFrame, on: list[str], *, width: int | None = None, touching: bool = False, how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals (``start``, ``stop``) with equal ``on``.

    Result: ``on``, ``start`` and ``stop`` of the left side and its other columns, then
    ``right_start``, ``right_stop`` and the right side's other columns. Columns of the right
    side that the left has too get the prefix ``right_``. ``touching``: intervals that share
    only a bound meet too, and so do empty ones. ``how``: ``inner``, or ``semi`` for the left
    rows with a partner, each once. Empty intervals overlap nothing; nulls in ``on`` or a bound
    match nothing; repeated rows each match.

    ``width`` (default: by the right side's lengths) is the width of the right side's bins, up to
    the next power of two.
    """
    if not touching:
        left, right = (df.where(F.col("start") < F.col("stop")) for df in (left, right))
    end = F.col("stop") if touching else F.col("stop") - 1
    meet = (lambda a, b: a <= b) if touching else (lambda a, b: a < b)
    names = {c: f"right_{c}" if c in left.columns and c not in on else c for c in right.columns}
    if how == "semi":
        return _semi(left, right, on, end, meet)
    classes = bin_classes(right) if width is None else [(max(2, width) - 1).bit_length()]
    left_bins, right_bins = _looks(classes, end)
    r = right.withColumn("__look", F.explode(right_bins)).withColumn("__class", _class_of(_bits(F.col("start"), F.col("stop")), classes))
    r = r.select(*on, "__look", "__class", *(F.col(c).alias(names[c]) for c in right.columns if c not in on))
    pairs = left.withColumn("__look", F.explode(left_bins)).join(r, [*on, "__look"])
    first = F.expr("shiftright(greatest(start, right_start), cast(shiftright(__look, 1) & 63 AS int)) = shiftright(__look, 7)")
    # a pair meets in the right one's bins if the left one is short enough to look there
    near = F.expr("__look & 1 = 0") | (_bits(F.col("start"), F.col("stop")) > F.col("__class") + _REACH)
    return pairs.where(meet(F.col("start"), F.col("right_stop")) & meet(F.col("right_start"), F.col("stop")) & first & near).drop("__look", "__class")


def _class_of(bits: Column, classes: Sequence[int]) -> Column:
    """The least of ``classes`` that is no less than ``bits``, or the greatest."""
    out = F.lit(classes[-1])
    for k in reversed(classes[:-1]):
        out = F.when(bits <= k, F.lit(k)).otherwise(out)
    return out


def _looks(classes: list[int], end: Column) -> tuple[Column, Column]:
    """The bins of a left and of a right interval. A bin of 2**k positions is one number: bin * 128 + k * 2, plus 1 in those that follow the left side's lengths."""
    bits = _bits(F.col("start"), F.col("stop"))

    def touched(k: int | Column, by_left: int) -> Column:
        shift, code = (F.lit(k) if isinstance(k, int) else k).cast("int"), k * 2 + by_left
        low, high = (F.call_function("shiftright", at.cast("bigint"), shift) for at in (F.col("start"), end))
        return F.sequence(low * 128 + code, high * 128 + code, F.lit(128).cast("bigint"))

    none = F.array().cast("array<bigint>")
    near = F.concat(*(F.when(bits <= k + _REACH, touched(k, 0)).otherwise(none) for k in classes))
    left = F.when(bits > classes[0] + _REACH, F.concat(near, touched(_class_of(bits, _LONG), 1))).otherwise(touched(classes[0], 0) if len(classes) == 1 else near)
    own = _class_of(bits, classes)
    far = [F.when(F.lit(k) > own + _REACH, touched(k, 1)).otherwise(none) for k in _LONG if k > classes[0] + _REACH]
    right = F.concat(touched(own, 0), *far)
    there = F.col("start") <= F.col("stop")
    return F.when(there, left), F.when(there, right)


def _semi(left: DataFrame, right: DataFrame, on: list[str], end: Column, meet: Callable[[Column, Column], Column]) -> DataFrame:
    """Left rows that meet the right side.

    A left row reaches from its first bin, of a class at least as wide as it is long, into
    the next at most. It asks in its first bin only, and right intervals also lie in the bin
    before their own; so each left row is one row throughout and none needs a number. Beyond
    ``MOST_IN_BINS`` rows, counted first, or Spark's threshold at ``ROW_IN_BIN`` bytes each, the
    right side isn't broadcast.
    """
    bits = _bits(F.col("start"), F.col("stop"))
    size = F.lit(1 << _LOOKS[-1])
    for k in reversed(_LOOKS[:-1]):
        size = F.when(bits <= k, F.lit(1 << k).cast("bigint")).otherwise(size)
    asks = left.withColumn("__size", size.cast("bigint"))
    asks = asks.withColumn("__bin", F.floor(F.col("start") / F.col("__size")).cast("bigint"))
    own = right.select(*on, "start", "stop", F.explode(F.array(*(F.lit(1 << k).cast("bigint") for k in _LOOKS))).alias("__size"))
    first, last = F.floor(F.col("start") / F.col("__size")).cast("bigint") - 1, F.floor(end / F.col("__size")).cast("bigint")
    own = own.where(end >= F.col("start") - 1)
    # Spark's estimate of the size leaves out what an explode adds, so it would broadcast far more than it means to
    most = left.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    many = (own.agg(F.sum(last - first + 1)).first()[0] or 0) > min(MOST_IN_BINS, most // ROW_IN_BIN)
    own = own.select(*on, "start", "stop", "__size", F.explode(F.sequence(first, last)).alias("__bin"))
    l, r = asks.alias("l"), (own.hint("merge") if many else own).alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*on, "__size", "__bin")]
    overlap = meet(F.col("l.start"), F.col("r.stop")) & meet(F.col("r.start"), F.col("l.stop"))
    return l.join(r, [*same, overlap], "left_semi").drop("__size", "__bin")


#: Rows of a reference dictionary (a number and a length) that go to every task at most.
MOST_BROADCAST = 1_000_000


def checked_broadcast(few: DataFrame, source: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``few`` marked for a broadcast if ``source``, which has at least its rows, has at most ``most``; they are counted no further than that.

    Spark knows no size of what comes from a header or from Python, and would shuffle the other side.
    """
    counted = source.limit(most + 1).count()
    return F.broadcast(few) if counted <= most else few


def strictly_meets(start: Column, stop: Column, region_start: Column, region_stop: Column) -> Column:
    """The older counting predicate: reads that share a bound with the region and aren't inside it don't count, nor do those equal to it."""
    inside = (start > region_start) & (start < region_stop)
    return inside | ((stop > region_start) & (stop < region_stop)) | ((start < region_start) & (stop > region_stop))


def bind_regions(raw: DataFrame, refs: DataFrame, *, unknown: str = "error") -> DataFrame:
    """Raw regions (chrom, start, stop, name) on the references' tids, names filled in.

    A chrom that ``refs`` lacks raises, or is left out with ``unknown="drop"``. Repeated
    names of ``refs`` stand for their lowest tid. Other columns are kept.
    """
    from tidespan.functions.regions import default_name

    known = refs.groupBy(F.col("name").alias("chrom")).agg(F.min("tid").alias("tid"))
    bound = raw.join(known, "chrom", "left" if unknown == "error" else "inner")
    tid = F.col("tid")
    if unknown == "error":
        tid = F.when(tid.isNull(), F.raise_error(F.concat(F.lit("region on an unknown reference: "), F.coalesce("chrom", F.lit("null")))).cast("int")).otherwise(tid)
    rest = [c for c in raw.columns if c not in ("chrom", "start", "stop", "name", "tid")]
    return bound.select(tid.alias("tid"), "start", "stop", default_name(F.col("name"), F.col("chrom"), F.col("start"), F.col("stop")).alias("name"), "chrom", *rest)
