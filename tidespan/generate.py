"""Generated alignments for benchmarks and tests; every value follows from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidespan.durable import numbered
from tidespan.functions.alignments import reference_length


def _draw(name: str, seed: int, below: Column | int) -> Column:
    """A whole number from 0 up to ``below``, from the row's id."""
    return F.pmod(F.xxhash64("id", F.lit(name), F.lit(seed)), below if isinstance(below, Column) else F.lit(below))


def random_cigar(size: Column, seed: int) -> Column:
    """A CIGAR whose query length is ``size``: matches, cut by an insertion or a deletion or with a clipped end where the size allows."""
    third = F.expr("size div 3")
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    gap = _draw("gap", seed, 9) + 1
    kind = _draw("kind", seed, 5)
    return (
        F.when((size < 40) | (kind == 0), text(size, "M"))
        .when(kind == 1, text(third, "M", gap, "I", size - third - gap, "M"))
        .when(kind == 2, text(third, "M", gap, "D", size - third, "M"))
        .when(kind == 3, text(third, "M", gap, "I", third, "M", gap, "D", size - third * 2 - gap, "M"))
        .otherwise(text(size - gap, "M", gap, "S"))
    )


def _reads(rows: DataFrame, sample: str = "sim") -> DataFrame:
    return rows.select(
        F.lit(sample).alias("sample"), F.concat(F.lit("read_"), F.col("id").cast("string")).alias("qname"), F.col("flag").cast("int").alias("flag"), F.col("tid").cast("int").alias("tid"), "start", "stop", F.lit(60).alias("mapq"),
        (F.col("made") if "made" in rows.columns else F.concat((F.col("stop") - F.col("start")).cast("string"), F.lit("M"))).alias("cigar"), F.lit(None).cast("int").alias("mate_tid"), F.lit(None).cast("bigint").alias("mate_pos"), F.lit(0).cast("bigint").alias("isize"), F.lit("*").alias("seq"), F.lit("*").alias("qual"),
    )


def reads_from_bed(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """Alignments from reads (chrom, start, stop, reverse)."""
    known = refs.select("tid", F.col("name").alias("chrom"))
    return _reads(reads.join(known, "chrom").withColumn("id", F.monotonically_increasing_id()).withColumn("flag", F.when(F.col("reverse"), 16).otherwise(0)))


def refs_from_reads(reads: DataFrame, *, least: int = 0, margin: int = 100) -> DataFrame:
    """A reference for each chrom of reads: as long as the last end and a margin."""
    from pyspark.sql import Window

    lengths = reads.groupBy("chrom").agg(F.greatest(F.max("stop") + margin, F.lit(least).cast("bigint")).alias("length"))
    return lengths.select((F.row_number().over(Window.orderBy("chrom")) - 1).cast("int").alias("tid"), F.col("chrom").alias("name"), "length")


def random_reads(spark: SparkSession, length: int, depth: float, *, shortest: int = 1000, longest: int = 10000, seed: int = 1, clones: int = 1, cigars: bool = False) -> DataFrame:
    """Reads of random length at random places of one reference, up to a mean depth; with ``cigars`` random ones, of which a read spans what they say."""
    n = int(length * depth / ((shortest + longest) / 2) / clones)
    size = _draw("size", seed, longest - shortest + 1) + shortest
    rows = spark.range(n).withColumn("size", F.least(size, F.lit(length))).withColumn("start", _draw("start", seed, F.col("size") * 0 + length - F.col("size") + 1))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(clones)))).withColumn("id", F.col("id") * clones + F.col("copy") - 1)
    rows = rows.withColumn("tid", F.lit(0)).withColumn("flag", F.when(_draw("strand", seed, 2) == 1, 16).otherwise(0))
    if not cigars:
        return _reads(rows.withColumn("stop", F.col("start") + F.col("size")))
    rows = rows.withColumn("made", random_cigar(F.col("size"), seed))
    return _reads(rows.withColumn("stop", F.least(F.lit(length), F.col("start") + reference_length(F.col("made")))))


def targeted_reads(regions: DataFrame, per_region: int, *, size: int = 100, seed: int = 1) -> DataFrame:
    """Reads that lie within the regions (tid, start, stop)."""
    rows = regions.where(F.col("stop") > F.col("start")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_region))))
    rows = rows.withColumn("id", F.xxhash64("tid", "start", "stop", "k"))
    width = F.least(F.lit(size).cast("bigint"), F.col("stop") - F.col("start"))
    rows = rows.withColumn("from", F.col("start") + F.pmod(F.xxhash64("id", F.lit(seed)), F.col("stop") - F.col("start") - width + 1))
    return _reads(rows.select("id", "tid", F.col("from").alias("start"), (F.col("from") + width).alias("stop"), F.when(_draw("strand", seed, 2) == 1, 16).otherwise(0).alias("flag")))


def stacked_reads(spark: SparkSession, length: int, stacks: int, per_stack: int, *, size: int = 150, noise: int = 5, seed: int = 1) -> DataFrame:
    """Stacks of reads that start within ``noise`` of one place."""
    rows = spark.range(stacks * per_stack).withColumn("stack", F.expr(f"id div {per_stack}"))
    place = F.pmod(F.xxhash64("stack", F.lit(seed)), F.lit(max(1, length - size - noise)))
    rows = rows.withColumn("start", place + _draw("noise", seed, noise + 1))
    return _reads(rows.withColumn("stop", F.col("start") + size).withColumn("tid", F.lit(0)).withColumn("flag", F.lit(0)))


def tiling_reads(refs: DataFrame, size: int) -> DataFrame:
    """Reads of ``size`` end to end over every reference."""
    rows = refs.where(F.col("length") >= size).withColumn("k", F.explode(F.expr(f"sequence(0L, length div {size} - 1)")))
    return _reads(rows.withColumn("id", F.xxhash64("tid", "k")).withColumn("start", F.col("k") * size).withColumn("stop", (F.col("k") + 1) * size).withColumn("flag", F.lit(0)))


def flag_reads(spark: SparkSession, flags: list[int]) -> DataFrame:
    """One read [0, "1" + flag) for each flag."""
    rows = spark.createDataFrame([(f, f, 0, 0, int(f"1{f}")) for f in flags], "id bigint, flag int, tid int, start bigint, stop bigint")
    return _reads(rows)


def every_nth(features: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The ``n``-th feature in the order of ``order``, and each ``n``-th after it: a sampling operator."""
    return numbered(features, order, "__number").where(F.col("__number") % n == n - 1).drop("__number")
