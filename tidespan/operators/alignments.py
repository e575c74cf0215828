"""Alignments to intervals: which reads count, and what each covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidespan.durable import durable
from tidespan.functions.alignments import PROPER, READ2, has_flag, is_reverse
from tidespan.operators.joins import checked_broadcast
from tidespan.options import InputOptions


def keep_reads(alignments: DataFrame, options: InputOptions = InputOptions()) -> DataFrame:
    """The reads that pass the quality and flag filters and lie on a reference."""
    kept = alignments.where(F.col("tid") >= 0).where(F.col("flag").bitwiseAND(options.flag_mask) == 0)
    return kept.where(F.col("mapq") >= options.min_mapq) if options.min_mapq else kept


def keep_fragments(alignments: DataFrame) -> DataFrame:
    """One read of each proper pair."""
    return alignments.where(has_flag(F.col("flag"), PROPER) & ~has_flag(F.col("flag"), READ2))


def read_intervals(alignments: DataFrame, refs: DataFrame, options: InputOptions = InputOptions()) -> DataFrame:
    """``sample, tid, start, stop, reverse, length`` of every read that counts; ``length`` is the reference's.

    Reads with a null bound or on an unknown reference cover nothing. Ends beyond the
    reference are cut, or raise with ``overhang="error"``; an interval left empty is dropped.
    """
    kept = keep_reads(alignments, options)
    stop = F.col("stop")
    if options.physical:
        kept = kept.where(F.col("isize") > 0)
        stop = F.col("start") + F.col("isize")
    if options.fragment_length:
        stop = F.col("start") + options.fragment_length
    # greatest and least skip nulls
    kept = kept.where(F.col("start").isNotNull() & stop.isNotNull())
    if options.require_sorted:
        kept = assert_sorted(kept, options.require_sorted)
    known = refs.where(F.col("tid").isNotNull()).groupBy("tid").agg(F.max("length").alias("length"))
    out = kept.select("sample", "tid", F.greatest(F.col("start"), F.lit(0)).alias("start"), stop.alias("stop"), is_reverse(F.col("flag")).alias("reverse")).join(checked_broadcast(known, refs), "tid")
    end = F.least(F.col("stop"), F.col("length"))
    if options.overhang == "error":
        beyond = F.raise_error(F.concat(F.lit("a read ends beyond reference "), F.col("tid").cast("string")))
        end = F.when(F.col("stop") > F.col("length"), beyond.cast("bigint")).otherwise(end)
    return out.select("sample", "tid", "start", end.alias("stop"), "reverse", "length").where(F.col("start") < F.col("stop"))


def assert_sorted(alignments: DataFrame, order: str) -> DataFrame:
    """``alignments``, raising on a read that starts before its predecessor on the reference in the order of column ``order``.

    References may follow in any order, but each only once. A read must not start before the
    greatest start so far; the order is cut into ranges, each of which begins with the greatest
    start of the ranges before it, so no reference is one task's work.
    """
    keys = [F.col("sample"), F.col("tid")]
    placed = alignments.repartitionByRange(F.asc_nulls_first("sample"), F.asc_nulls_first("tid"), F.asc_nulls_first(order)).withColumn("__part", F.spark_partition_id())
    # ranges are drawn from samples, so they must stay as they were when they were summed
    placed = durable(placed)
    tops = placed.groupBy("sample", "tid", "__part").agg(F.max("start").alias("top"))
    # at most one row for each reference and range
    earlier = F.max("top").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(F.struct("sample", "tid").alias("__of"), "__part", earlier.alias("__top"))
    joined = placed.withColumn("__of", F.struct("sample", "tid")).join(tops, ["__of", "__part"])
    within = F.max("start").over(Window.partitionBy("__of", "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    before = F.greatest(within, F.col("__top"))
    message = F.concat(F.lit("coverage went backwards on reference "), F.col("tid").cast("string"))
    checked = F.when(F.col("__before") > F.col("start"), F.raise_error(message).cast("bigint")).otherwise(F.col("start"))
    return joined.withColumn("__before", before).withColumn("start", checked).select(*alignments.columns)
