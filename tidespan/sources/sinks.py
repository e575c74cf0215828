"""Text outputs as one-column frames of lines (``value``), and how to write them.

A frame of lines carries its order in leading columns where order matters; ``write_lines``
sorts by range, so the parts follow one another without passing through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidespan.functions.regions import fixed
from tidespan.operators.spans import spread_spans


def _text(*columns: Column) -> Column:
    return F.concat_ws("\t", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))


def bed_lines(runs: DataFrame, refs: DataFrame, values: list[str]) -> DataFrame:
    """Coverage text: chrom, start, stop, then ``values``; ordered by tid and start."""
    named = runs.where(F.col("start") < F.col("stop")).join(refs.select("tid", F.col("name").alias("chrom")), "tid")
    return named.select(F.col("tid").alias("o1"), F.col("start").alias("o2"), _text(F.col("chrom"), F.col("start"), F.col("stop"), *(F.col(v) for v in values)).alias("value"))


def wig_lines(spans: DataFrame, refs: DataFrame, span: int, values: list[str]) -> DataFrame:
    """fixedStep text: a header for each reference, then one line of values a span."""
    named = spans.join(refs.select("tid", F.col("name").alias("chrom")), "tid")
    head = named.select("tid", "chrom").distinct().select(F.col("tid").alias("o1"), F.lit(-1).cast("bigint").alias("o2"), F.concat(F.lit("fixedStep chrom="), "chrom", F.lit(f" start=1 step={span} span={span}")).alias("value"))
    return head.unionByName(named.select(F.col("tid").alias("o1"), F.col("span").alias("o2"), _text(*(F.col(v) for v in values)).alias("value")))


def report_lines(report: DataFrame, *, key: str = "name", header: bool = True, comments: list[str] | None = None, first: str = "interval") -> DataFrame:
    """A table with tabs, ordered by its key, after optional comment and header lines."""
    rest = [c for c in report.columns if c != key]
    rows = report.select(F.lit(1).alias("o1"), F.col(key).alias("o2"), _text(F.col(key), *(F.col(c) for c in rest)).alias("value"))
    top = [*(comments or []), *(["\t".join([first, *rest])] if header else [])]
    if not top:
        return rows
    lead = report.sparkSession.createDataFrame([(0, f"{i:09d}", line) for i, line in enumerate(top)], "o1 int, o2 string, value string")
    return lead.unionByName(rows)


def count_lines(counts: DataFrame, *, stranded: bool = False, coords: bool = False, rpkm: bool = False, per_position: bool = False, precision: int = 3, header: bool = False) -> DataFrame:
    """Read counts of one sample: the name, optional coordinates, the counts, optional normalised values."""
    columns = [F.col("name"), *((F.col(c) for c in ("chrom", "starts", "stops")) if coords else []), *((F.col(c) for c in ("fwd", "rev")) if stranded else [F.col("counts")])]
    columns += [fixed(F.coalesce("rpkm", F.lit(0.0)), precision)] if rpkm else []
    columns += [fixed(F.coalesce("per_position", F.lit(0.0)), precision)] if per_position else []
    rows = counts.select(F.lit(1).alias("o1"), F.col("name").alias("o2"), _text(*columns).alias("value"))
    if not header:
        return rows
    names = ["#Feature", *(["Chrom", "Starts", "Stops"] if coords else []), *(["Forward", "Reverse"] if stranded else ["Counts"]), *(["RPKM"] if rpkm else []), *(["Counts/Length"] if per_position else [])]
    return counts.sparkSession.createDataFrame([(0, "", "\t".join(names))], "o1 int, o2 string, value string").unionByName(rows)


#: What the report viewer needs in front of a matrix; fixed values.
MULTIQC = ["# plot_type: 'table'", "# section_name: 'Reads per reference'", "# description: 'Reads on each reference sequence'"]


def ref_count_lines(matrix: DataFrame, *, tag: str = "ViralSequence", multiqc: bool = False) -> DataFrame:
    """The matrix of reads per reference under ``tag`` and the samples' names."""
    return report_lines(matrix, comments=MULTIQC if multiqc else None, first=tag)


def target_lines(found: DataFrame, *, value: str = "bases", regions: DataFrame | None = None) -> DataFrame:
    """Name and value of ``coverage_to_target``; with ``regions`` (chrom, start, stop, name) a BED line for each of them, all parts of a name with its value."""
    if regions is None:
        return found.select(F.lit(1).alias("o1"), F.col("name").alias("o2"), _text(F.col("name"), F.col(value)).alias("value"))
    parts = regions.select("chrom", "start", "stop", "name").join(found.select("name", F.col(value).alias("found")), "name", "left")
    return parts.select(F.col("chrom").alias("o1"), F.col("start").alias("o2"), _text(*(F.col(c) for c in ("chrom", "start", "stop", "name", "found"))).alias("value"))


def mean_lines(matrix: DataFrame, samples: list[str], precision: int = 2) -> DataFrame:
    """The matrix of ``mean_depths`` with rounded means, ``#Total`` last."""
    cells = [fixed(F.col(s), precision) for s in samples]
    rows = matrix.select(F.when(F.col("name") == "#Total", 2).otherwise(1).alias("o1"), F.col("name").alias("o2"), _text(F.col("name"), *cells).alias("value"))
    head = matrix.sparkSession.createDataFrame([(0, "", "\t".join(["Sequence", *samples]))], "o1 int, o2 string, value string")
    return head.unionByName(rows)


def region_lines(regions: DataFrame, *, bound: bool = False) -> DataFrame:
    """Regions as BED, or with ``bound`` as ``[tid] start stop label``."""
    if bound:
        line = F.concat_ws(" ", F.concat(F.lit("["), F.col("tid").cast("string"), F.lit("]")), F.col("start").cast("string"), F.col("stop").cast("string"), F.col("name"))
        return regions.select(F.col("tid").alias("o1"), F.col("start").alias("o2"), line.alias("value"))
    return regions.select(F.col("chrom").alias("o1"), F.col("start").alias("o2"), _text(F.col("chrom"), F.col("start"), F.col("stop"), F.col("name")).alias("value"))


def gtf_lines(regions: DataFrame, *, feature: str = "exon", source: str = "tidespan") -> DataFrame:
    """BED-like regions as GTF."""
    line = F.format_string(f'%s\t{source}\t{feature}\t%d\t%d\t.\t+\t.\tgene_id "%s"; transcript_id "%s";', F.col("chrom"), F.col("start") + 1, F.col("stop"), F.col("name"), F.col("name"))
    return regions.select(F.col("chrom").alias("o1"), F.col("start").alias("o2"), line.alias("value"))


#: Bases of a line of FASTA.
FASTA_WIDTH = 64


def fasta_lines(refs: DataFrame, *, seed: int | None = None) -> DataFrame:
    """A record of N, or of random bases with ``seed``, for each reference; a row is a line, so no sequence is one value.

    A base is two bits of a digest of the reference's name, the seed and the line's number.
    """
    lines = F.expr(f"(length + {FASTA_WIDTH - 1}) div {FASTA_WIDTH}")
    spread = refs.where(F.col("length") > 0).select("tid", "name", "length", F.lit(0).cast("bigint").alias("first"), (lines - 1).alias("last"))
    spread = spread_spans(spread).withColumnRenamed("span", "line")
    width = F.least(F.lit(FASTA_WIDTH), F.col("length") - F.col("line") * FASTA_WIDTH).cast("int")
    if seed is None:
        bases = F.repeat(F.lit("N"), width)
    else:
        part = lambda k: F.md5(F.concat_ws(":", "name", F.lit(str(seed)), F.col("line").cast("string"), F.lit(str(k))))
        bases = F.substring(F.translate(F.concat(part(0), part(1)), "0123456789abcdef", "ACGT" * 4), F.lit(1), width)
    head = refs.select(F.col("tid").alias("o1"), F.lit(-1).cast("bigint").alias("o2"), F.concat(F.lit(">"), "name").alias("value"))
    return head.unionByName(spread.select(F.col("tid").alias("o1"), F.col("line").alias("o2"), bases.alias("value")))


def fastq_lines(reads: DataFrame) -> DataFrame:
    """A FASTQ record for each read, with its mate's place as a comment."""
    end = F.when(F.col("flag").bitwiseAND(64) != 0, "/1").when(F.col("flag").bitwiseAND(128) != 0, "/2").otherwise("")
    mate = F.concat(F.lit("\t"), F.coalesce(F.col("mate_tid").cast("string"), F.lit("*")), F.lit(":"), F.coalesce(F.col("mate_pos").cast("string"), F.lit("*")))
    return reads.select(F.col("qname").alias("o1"), F.col("flag").alias("o2"), F.concat(F.lit("@"), "qname", end, mate, F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def sam_lines(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """SAM text with its header."""
    head = refs.select(F.lit(-1).alias("o1"), F.col("tid").cast("bigint").alias("o2"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("length").cast("string")).alias("value"))
    names = refs.select("tid", F.col("name").alias("rname"))
    mates = refs.select(F.col("tid").alias("mate_tid"), F.col("name").alias("mate"))
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    place = lambda c: (F.coalesce(F.col(c), F.lit(-1)) + 1).cast("string")
    line = F.concat_ws("\t", "qname", F.col("flag").cast("string"), star("rname"), place("start"), F.col("mapq").cast("string"), star("cigar"), F.when(F.col("mate_tid") == F.col("tid"), "=").otherwise(star("mate")), place("mate_pos"), F.coalesce("isize", F.lit(0)).cast("string"), star("seq"), star("qual"))
    rows = reads.join(names, "tid", "left").join(mates, "mate_tid", "left")
    last = F.lit(1 << 30)
    return head.unionByName(rows.select(F.coalesce("tid", last).alias("o1"), F.col("start").alias("o2"), line.alias("value")))


def in_region_order(lines: DataFrame, order: DataFrame) -> DataFrame:
    """``report_lines`` or ``count_lines`` ordered as the regions come on the references (``name_order``), not by name."""
    places = order.select(F.col("name").alias("o2"), F.col("tid").alias("place"), F.col("start").alias("within"))
    return lines.join(places, "o2", "left").select("o1", F.coalesce("place", F.lit(-1)).alias("place"), F.coalesce("within", F.lit(-1).cast("bigint")).alias("within"), "o2", "value")


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes text in order; the parts' names follow the order."""
    order = [c for c in lines.columns if c != "value"]
    # spread by range, so that no task writes everything
    lines.orderBy(*order).select("value").write.mode("overwrite").text(path)


def write_by_reference(rows: DataFrame, path: str) -> None:
    """Parquet in one folder per reference, so that a scan of one reference reads only that."""
    rows.repartition("tid", F.pmod(F.xxhash64("start"), F.lit(16))).sortWithinPartitions("tid", "start").write.mode("overwrite").partitionBy("tid").parquet(path)
