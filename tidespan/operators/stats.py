"""Statistics of depth per region or reference, and counts of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidespan.functions.regions import overlap, per_million, per_position, rpkm
from tidespan.operators.joins import interval_join, strictly_meets

_STRANDS = {"": "cov", "_forward": "fwd", "_reverse": "rev"}


def clip_to_regions(runs: DataFrame, regions: DataFrame, *, compat: bool = False) -> DataFrame:
    """The part of each run within each region, with the region's ``name``.

    ``compat`` keeps contacts of length 0, which then count towards minima and maxima.
    """
    pairs = interval_join(runs.drop("name"), regions.select("tid", "start", "stop", "name"), ["tid"], touching=compat)
    clipped = pairs.withColumn("start", F.greatest("start", "right_start")).withColumn("stop", F.least("stop", "right_stop")).drop("right_start", "right_stop")
    return clipped if compat else clipped.where(F.col("start") < F.col("stop"))


def depth_stats(pieces: DataFrame, keys: list[str], *, stranded: bool = False, low: int | None = None) -> DataFrame:
    """Bases, mean, min, max (and positions under ``low``) of runs per ``keys``, and ``length``.

    With ``stranded`` also for ``fwd`` and ``rev``, with suffixes. The mean over no positions is 0.
    """
    span = F.col("stop") - F.col("start")
    parts, out = [F.sum(span).alias("length")], []
    for suffix, c in (_STRANDS if stranded else {"": "cov"}).items():
        parts += [F.sum(F.col(c) * span).alias(f"bases{suffix}"), F.min(c).alias(f"min{suffix}"), F.max(c).alias(f"max{suffix}")]
        out += [F.col(f"bases{suffix}"), _mean(F.col(f"bases{suffix}"), F.col("length")).alias(f"mean{suffix}"), F.col(f"min{suffix}"), F.col(f"max{suffix}")]
        if low is not None:
            parts.append(F.sum(F.when(F.col(c) < low, span).otherwise(0)).alias(f"low{suffix}"))
            out.append(F.col(f"low{suffix}"))
    return pieces.groupBy(*keys).agg(*parts).select(*keys, *out, "length")


def _mean(bases: Column, length: Column) -> Column:
    return F.coalesce(bases.cast("double") / F.nullif(length.cast("double"), F.lit(0.0)), F.lit(0.0))


def region_stats(runs: DataFrame, regions: DataFrame, *, samples: list[str] | None = None, stranded: bool = False, low: int | None = None, compat: bool = False) -> DataFrame:
    """``depth_stats`` per sample and region name; regions of one name are pooled.

    Every name is listed for every one of ``samples``, with zeros where nothing lies. Where
    the samples aren't given they are looked up, which computes the runs once more.
    """
    stats = depth_stats(clip_to_regions(runs, regions, compat=compat), ["sample", "name"], stranded=stranded, low=low)
    if samples is None:
        samples = [r["sample"] for r in runs.select("sample").distinct().collect()]
    values = [c for c in stats.columns if c not in ("sample", "name")]
    entries = F.explode(F.array(*(F.lit(s).cast("string") for s in samples)) if samples else F.array().cast("array<string>"))
    listed = regions.select("name").distinct().select("name", entries.alias("sample"))
    on = F.col("l.name").eqNullSafe(F.col("s.name")) & F.col("l.sample").eqNullSafe(F.col("s.sample"))
    return listed.alias("l").join(stats.alias("s"), on, "left").select("l.sample", "l.name", *(F.coalesce(f"s.{c}", F.lit(0).cast(stats.schema[c].dataType)).alias(c) for c in values))


def ref_stats(runs: DataFrame, refs: DataFrame, *, stranded: bool = False, low: int | None = None) -> DataFrame:
    """``depth_stats`` per sample and reference name."""
    stats = depth_stats(runs, ["sample", "tid"], stranded=stranded, low=low)
    return stats.join(refs.select("tid", "name"), "tid").drop("tid").select("sample", "name", *(c for c in stats.columns if c not in ("sample", "tid")))


def count_reads(intervals: DataFrame, regions: DataFrame, *, strict: bool = False, compat: bool = False) -> DataFrame:
    """Reads per sample and region name: ``fwd``, ``rev``, ``counts``; names without reads aren't listed.

    A read counts once for each region it overlaps; ``strict`` only where it lies within.
    ``compat`` counts by the older predicate ``strictly_meets``.
    """
    pairs = interval_join(intervals.select("sample", "tid", "start", "stop", "reverse"), regions.select("tid", "start", "stop", "name"), ["tid"])
    bounds = [F.col(c) for c in ("start", "stop", "right_start", "right_stop")]
    if compat:
        pairs = pairs.where(strictly_meets(*bounds))
    if strict:
        pairs = pairs.where((bounds[2] <= bounds[0]) & (bounds[1] <= bounds[3]))
    reverse = F.sum(F.when(F.col("reverse"), 1).otherwise(0))
    return pairs.groupBy("sample", "name").agg((F.count(F.lit(1)) - reverse).alias("fwd"), reverse.alias("rev"), F.count(F.lit(1)).alias("counts"))


def region_coordinates(regions: DataFrame) -> DataFrame:
    """Each name's parts in order: ``chrom``, ``starts`` and ``stops`` joined by ``;``, and the summed ``length``.

    ``regions`` has a ``chrom`` column (``bind_regions`` keeps it).
    """
    parts = F.array_sort(F.collect_list(F.struct("tid", "start", "stop", "chrom")))
    joined = lambda field: F.array_join(F.transform("parts", lambda p: p[field].cast("string")), ";")
    grouped = regions.groupBy("name").agg(parts.alias("parts"), F.sum(F.col("stop") - F.col("start")).alias("length"))
    return grouped.select("name", joined("chrom").alias("chrom"), joined("start").alias("starts"), joined("stop").alias("stops"), "length")


def name_order(regions: DataFrame) -> DataFrame:
    """Where each name comes first, in the references' order: name, tid, start."""
    first = F.min(F.struct("tid", "start")).alias("first")
    return regions.groupBy("name").agg(first).select("name", "first.*")


def region_counts(intervals: DataFrame, regions: DataFrame, *, samples: list[str], total_reads: DataFrame | None = None, strict: bool = False, compat: bool = False) -> DataFrame:
    """Every name for each of ``samples``: fwd, rev, counts, chrom, starts, stops, length, and per_position.

    ``total_reads`` (sample, total) adds ``rpkm``. Names without reads have zeros.
    """
    counts = count_reads(intervals, regions, strict=strict, compat=compat)
    entries = F.explode(F.array(*(F.lit(s).cast("string") for s in samples)))
    listed = region_coordinates(regions).withColumn("sample", entries)
    on = F.col("l.name").eqNullSafe(F.col("c.name")) & F.col("l.sample").eqNullSafe(F.col("c.sample"))
    zero = lambda c: F.coalesce(f"c.{c}", F.lit(0).cast("bigint")).alias(c)
    out = listed.alias("l").join(counts.alias("c"), on, "left").select("l.sample", "l.name", zero("fwd"), zero("rev"), zero("counts"), "l.chrom", "l.starts", "l.stops", "l.length")
    out = out.withColumn("per_position", per_position(F.col("counts"), F.col("length")))
    if total_reads is not None:
        totals = total_reads.select(F.col("sample").alias("total_sample"), F.col("total").alias("total"))
        out = out.join(totals, F.col("sample").eqNullSafe(F.col("total_sample")), "left").withColumn("rpkm", rpkm(F.col("counts"), F.col("total"), F.col("length"))).drop("total_sample", "total")
    return out


def total_reads(alignments: DataFrame) -> DataFrame:
    """All records of each sample: ``sample``, ``total``."""
    return alignments.groupBy("sample").agg(F.count(F.lit(1)).alias("total"))


def mapped_reads(alignments: DataFrame) -> DataFrame:
    """Records of each sample that aren't unmapped: ``sample``, ``total``."""
    return alignments.where(F.col("flag").bitwiseAND(4) == 0).groupBy("sample").agg(F.count(F.lit(1)).alias("total"))


def count_refs(kept: DataFrame, refs: DataFrame, samples: list[str], *, mapped: DataFrame | None = None) -> DataFrame:
    """Kept reads per sample and reference, zeros included: sample, tid, name, length, counts; ``mapped`` adds ``cpm``."""
    counts = kept.groupBy("sample", "tid").agg(F.count(F.lit(1)).alias("counts"))
    listed = refs.select("tid", "name", "length", F.explode(F.array(*(F.lit(s).cast("string") for s in samples))).alias("sample"))
    out = listed.join(counts, ["sample", "tid"], "left").select("sample", "tid", "name", "length", F.coalesce("counts", F.lit(0).cast("bigint")).alias("counts"))
    if mapped is not None:
        out = out.join(mapped, "sample", "left").withColumn("cpm", per_million(F.col("counts"), F.col("total"))).drop("total")
    return out


def coverage_to_target(coverage: DataFrame, regions: DataFrame, *, normalise: bool = False, first_only: bool = False) -> DataFrame:
    """Depth times overlap per region name from a coverage table (tid, start, stop, cov): name, bases, length; zeros kept.

    ``first_only`` credits each run to its first overlapping region only. ``normalise`` adds
    ``per_position``.
    """
    pairs = interval_join(coverage.select("tid", "start", "stop", "cov"), regions.select("tid", "start", "stop", "name"), ["tid"])
    if first_only:
        best = F.min(F.struct("right_start", "right_stop", "name", "cov"))
        pairs = pairs.groupBy("tid", "start", "stop").agg(best.alias("b")).select("start", "stop", "b.*")
    bases = pairs.groupBy("name").agg(F.sum(F.col("cov") * overlap(F.col("start"), F.col("stop"), F.col("right_start"), F.col("right_stop"))).alias("bases"))
    named = regions.groupBy("name").agg(F.sum(F.col("stop") - F.col("start")).alias("length"))
    out = named.join(bases, "name", "left").select("name", F.coalesce("bases", F.lit(0).cast("bigint")).alias("bases"), "length")
    return out.withColumn("per_position", per_position(F.col("bases"), F.col("length"))) if normalise else out
