"""Length statistics and renaming of references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def length_stats(lengths: DataFrame, column: str = "length") -> DataFrame:
    """``n``, ``total``, ``longest`` and ``n50`` of a column of lengths; one row, nulls over no rows.

    n50 is the length at which the longer ones hold more than half of the total. Lengths fall
    into classes of their ten leading bits (64,000 at most), whose totals say in which class
    the half lies; only that class is ordered.
    """
    length = F.col("length")
    histogram = lengths.where(F.col(column) >= 0).groupBy(F.col(column).cast("bigint").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    shift = F.greatest(F.lit(0), F.length(F.bin(length)) - 10)
    histogram = histogram.withColumn("shift", shift).withColumn("lead", F.expr("shiftright(length, shift)"))
    classes = histogram.groupBy("shift", "lead").agg(F.sum("n").alias("n"), F.sum(length * F.col("n")).alias("total"), F.max("length").alias("longest")).collect()
    total, above = sum(r["total"] for r in classes), 0
    chosen = None
    for r in sorted(classes, key=lambda r: (-r["shift"], -r["lead"])):
        if 2 * (above + r["total"]) > total:
            chosen = r
            break
        above += r["total"]
    summary = lengths.sparkSession.createDataFrame([(sum(r["n"] for r in classes), total if classes else None, max((r["longest"] for r in classes), default=None))], "n bigint, total bigint, longest bigint")
    if chosen is None:
        return summary.withColumn("n50", F.lit(None).cast("bigint"))
    by = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    within = histogram.where((F.col("shift") == chosen["shift"]) & (F.col("lead") == chosen["lead"])).withColumn("cumulative", F.sum(length * F.col("n")).over(by) + above)
    return summary.withColumn("n50", within.where(2 * F.col("cumulative") > total).select(F.max("length")).scalar())


def mean_depth_by_ref(runs: DataFrame, refs: DataFrame) -> DataFrame:
    """Length covered by runs and weighted mean depth per sample and reference."""
    span = F.col("stop") - F.col("start")
    return runs.groupBy("sample", "tid").agg(F.sum(span).alias("length"), (F.sum(F.col("cov") * span).cast("double") / F.sum(span).cast("double")).alias("mean")).join(refs.select("tid", "name"), "tid").select("sample", "name", "length", "mean")


def whole_references(refs: DataFrame) -> DataFrame:
    """Each reference as one region."""
    return refs.select("tid", F.lit(0).cast("bigint").alias("start"), F.col("length").alias("stop"), "name")


def rename_references(records: DataFrame, old: DataFrame, new: DataFrame, column: str = "chrom") -> DataFrame:
    """Replaces names in ``column`` by the name at the same place (``ord``) of another list; unknown names stay."""
    pairs = old.select("ord", F.col("name").alias("__old")).join(new.select("ord", F.col("name").alias("__new")), "ord").select("__old", "__new")
    return records.join(pairs, F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def rewrite_sequences(reads: DataFrame, how: str, *, rename: bool = False) -> DataFrame:
    """Erases (``erase``), masks (``mask``) or shuffles (``shuffle``) the bases; ``rename`` gives the reads names that say nothing."""
    seq = F.col("seq")
    changed = {"erase": F.when(seq.isNotNull(), F.lit("*")), "mask": F.repeat(F.lit("N"), F.length(seq)), "shuffle": F.array_join(F.shuffle(F.regexp_extract_all(seq, F.lit("."), F.lit(0))), "")}
    if how not in changed:
        raise ValueError("how is erase, mask or shuffle")
    out = reads.withColumn("seq", changed[how])
    if not rename:
        return out
    # a digest of 128 bits: mates keep one name, no order over all names is needed, and two names won't meet
    return out.withColumn("qname", F.concat(F.lit("read_"), F.md5("qname")))
