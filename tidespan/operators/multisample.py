"""Combining samples: wide reports, count and mean matrices, shared low coverage, complements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidespan.operators.sweep import TILE, coverage, merge_equal_runs


def wide_report(stats: DataFrame, samples: list[str], *, key: str = "name") -> DataFrame:
    """One row per region: ``<sample>_<metric>`` for each sample in order, then ``length``."""
    metrics = [c for c in stats.columns if c not in ("sample", key, "length")]
    cell = lambda s, m: F.first(F.when(F.col("sample") == s, F.col(m)), ignorenulls=True).alias(f"{s}_{m}")
    return stats.groupBy(key).agg(*(cell(s, m) for s in samples for m in metrics), F.max("length").alias("length"))


def sample_matrix(values: DataFrame, key: str, value: str, samples: list[str]) -> DataFrame:
    """One row per ``key``, one column per sample, 0 where a sample has none."""
    zero = F.lit(0).cast(values.schema[value].dataType)
    return values.groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col("sample") == s, F.col(value))), zero).alias(s) for s in samples))


def mean_depths(runs: DataFrame, refs: DataFrame, samples: list[str], *, total: bool = False) -> DataFrame:
    """Weighted mean depth per reference and sample, and with ``total`` over all as ``#Total``.

    Raises where the samples cover different positions of a reference.
    """
    span = F.col("stop") - F.col("start")
    grouped = runs.rollup("tid") if total else runs.groupBy("tid")
    parts = []
    for s in samples:
        mine = F.col("sample") == s
        parts += [F.sum(F.when(mine, F.col("cov") * span)).alias(f"{s}_bases"), F.sum(F.when(mine, span)).alias(f"{s}_span")]
    wide = grouped.agg(*parts, F.grouping("tid").alias("all_refs") if total else F.lit(0).alias("all_refs"))
    names = refs.select("tid", F.col("name").alias("reference"))
    out = wide.join(names, "tid", "left")
    name = F.when(F.col("all_refs") == 1, "#Total").otherwise(F.col("reference"))
    ragged = F.lit(False)
    for s in samples[1:]:
        ragged = ragged | ~F.col(f"{s}_span").eqNullSafe(F.col(f"{samples[0]}_span"))
    name = F.when(ragged, F.raise_error(F.concat(F.lit("the samples differ in the positions of "), name))).otherwise(name)
    return out.select(name.alias("name"), *((F.col(f"{s}_bases").cast("double") / F.col(f"{s}_span").cast("double")).alias(s) for s in samples))


def depth_band(runs: DataFrame, low: int, high: int) -> DataFrame:
    """The runs whose depth is ``low`` to ``high``, both included."""
    return runs.where(F.col("cov").between(low, high))


def shared_low_coverage(runs: DataFrame, refs: DataFrame, low: int, high: int, n_samples: int, share: float = 1.0, *, tile: int = TILE) -> DataFrame:
    """Stretches in which at least ``share`` of the samples have a depth of ``low`` to ``high``: tid, start, stop, n.

    Stretches are split where the number of samples ``n`` changes.
    """
    needed = max(1, math.ceil(share * n_samples - 1e-9))
    chosen = depth_band(runs, low, high).select(F.lit(None).cast("string").alias("sample"), "tid", "start", "stop", F.lit(False).alias("reverse")).join(refs.select("tid", "length"), "tid")
    depth = coverage(chosen, refs, samples=[None], tile=tile)
    return depth.where(F.col("cov") >= needed).select("tid", "start", "stop", F.col("cov").alias("n"))


def band_label(low: int, high: int, share: Column) -> Column:
    return F.concat(F.lit(f"{low}X-{high}X,"), F.format_string("%.0f%%", share * 100))


def intersect_samples(intervals: DataFrame, refs: DataFrame, at_least: int, *, tile: int = TILE) -> DataFrame:
    """Stretches that intervals (sample, tid, start, stop) of at least ``at_least`` samples share: tid, start, stop, n."""
    from tidespan.operators.periods import merge_intervals

    own = merge_intervals(intervals, ["sample", "tid"]).where("kind = 'period'")
    events = own.select(F.lit(None).cast("string").alias("sample"), "tid", "start", "stop", F.lit(False).alias("reverse")).join(refs.select("tid", "length"), "tid")
    return coverage(events, refs, samples=[None], tile=tile).where(F.col("cov") >= at_least).select("tid", "start", "stop", F.col("cov").alias("n"))


def antitarget(regions: DataFrame, refs: DataFrame, *, tile: int = TILE) -> DataFrame:
    """What no region covers: tid, start, stop."""
    events = regions.select(F.lit(None).cast("string").alias("sample"), "tid", F.greatest("start", F.lit(0)).alias("start"), "stop", F.lit(False).alias("reverse")).join(refs.select("tid", "length"), "tid")
    events = events.withColumn("stop", F.least("stop", "length"))
    return coverage(events, refs, samples=[None], tile=tile).where("cov = 0").select("tid", "start", "stop")


def compare_counts(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Two count columns side by side: key, left_value, right_value, delta, percent. Both must hold the same keys."""
    both = left.select(key, F.col(value).alias("left_value")).join(right.select(key, F.col(value).alias("right_value")), key, "full_outer")
    lacking = F.col("left_value").isNull() | F.col("right_value").isNull()
    checked = F.when(lacking, F.raise_error(F.concat(F.lit("only one side has "), F.col(key).cast("string"))).cast("bigint")).otherwise(F.col("right_value") - F.col("left_value"))
    return both.select(key, "left_value", "right_value", checked.alias("delta")).withColumn("percent", F.when(F.col("left_value") != 0, 100.0 * F.col("delta") / F.col("left_value")))


def total_delta(compared: DataFrame) -> DataFrame:
    """The sum of the deltas of ``compare_counts`` and of their amounts."""
    return compared.agg(F.sum("delta").alias("delta"), F.sum(F.abs("delta")).alias("amount"))


def union_names(stats: DataFrame) -> DataFrame:
    """Every region name that any sample has."""
    return stats.select("name").distinct()


def missing_names(stats: DataFrame, names: DataFrame) -> DataFrame:
    """Names in ``stats`` that ``names`` lacks."""
    return stats.select("name").distinct().join(names, "name", "left_anti")


def fuse_runs(runs: DataFrame) -> DataFrame:
    """Adjacent runs of equal depth as one."""
    return merge_equal_runs(runs, ["sample", "tid"], ["cov"])
