"""Queries of the readers and writers: domain tables are written as text or BAM to a folder of the query, and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidespan.durable import numbered, scratch_folder
from tidespan.functions.regions import default_name
from tidespan.operators.alignments import read_intervals
from tidespan.operators.joins import bind_regions
from tidespan.operators.lengths import rewrite_sequences
from tidespan.operators.multisample import mean_depths, sample_matrix, wide_report
from tidespan.operators.spans import fill_spans, span_summary
from tidespan.operators.stats import coverage_to_target, name_order, region_counts, region_stats, total_reads
from tidespan.operators.sweep import coverage
from tidespan.plans import coverage as cov
from tidespan.plans import testdata
from tidespan.plans.testdata import SAMPLES, table
from tidespan.sources import sinks
from tidespan.sources.files import replacing_file
from tidespan.sources.logs import benchmark_matrix, read_benchmarks
from tidespan.sources.regions import read_bed, read_coverage_bed, read_fasta, read_gff, read_gff_strict, read_gtf, read_lengths, read_read_bed, read_regions
from tidespan.sources.sam import DEPTH_COLUMNS, read_bam, read_bam_refs, read_sam, read_sam_refs, stream_sam, write_bam

def _row(*columns: Column | str) -> Column:
    """Fields with tabs, nulls as empty ones."""
    cells = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return F.concat_ws("\t", *cells)


def _text(lines: DataFrame, name: str) -> str:
    """Writes ``value`` to a folder called ``name``."""
    path = f"{scratch_folder(lines.sparkSession, 'text')}/{name}"
    lines.select("value").write.text(path)
    return path


def _by_chrom(lines: DataFrame, name: str) -> str:
    """Writes a file for each ``file``, its lines in the order of ``place``."""
    path = f"{scratch_folder(lines.sparkSession, 'text')}/{name}"
    lines.repartition("file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(path)
    return path


def _written(lines: DataFrame) -> DataFrame:
    """Lines as ``write_lines`` leaves them: ``line_no`` from 0, ``value``."""
    path = f"{scratch_folder(lines.sparkSession, 'text')}/out"
    sinks.write_lines(lines, path)
    read = lines.sparkSession.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r"), "value")
    return numbered(read, ["f", "b", "r"], "line_no").select("line_no", "value")


# regions


def _bed_text(spark: SparkSession, folder: str) -> str:
    return _text(table(spark, folder, "regions").select(_row("chrom", "start", "stop", "name").alias("value")), "panels.bed")


def bed_regions(spark: SparkSession, folder: str) -> DataFrame:
    return read_bed(spark, _bed_text(spark, folder)).select("chrom", "start", "stop", "name")


def bed_corrupt(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the same text that are no regions."""
    return read_bed(spark, _bed_text(spark, folder), corrupt=True).select("line")


def _feature_lines(spark: SparkSession, folder: str, value: Column, *, header: bool = True) -> DataFrame:
    """A file for each chrom: its header, its regions, and a part that no reader may take for features."""
    regions = table(spark, folder, "regions").where("chrom IS NOT NULL")
    body = regions.select(F.col("chrom").alias("file"), F.struct(F.lit(1).alias("a"), F.col("region_id").alias("b")).alias("place"), value.alias("value"))
    chroms = regions.select(F.col("chrom").alias("file")).distinct()
    bogus = F.concat(F.col("file"), F.lit("\tx\tCDS\t1\t2\t.\t+\t0\tID=no"))
    heads = [(0, F.when(F.length("file") != 4, "##gff-version 3").otherwise("# no version"))] if header else []
    extra = [*heads, (2, F.lit("##FASTA")), (3, F.concat(F.lit(">"), "file")), (4, bogus)]
    for at, line in extra:
        body = body.unionByName(chroms.select("file", F.struct(F.lit(at).alias("a"), F.lit(0).cast("bigint").alias("b")).alias("place"), line.alias("value")))
    return body


def _gff() -> Column:
    kind = F.when(F.col("region_id") % 3 == 0, "gene").otherwise("CDS")
    attributes = F.concat(F.lit("Parent=p"), F.col("panel_id").cast("string"), F.coalesce(F.concat(F.lit(";ID="), "name"), F.lit("")))
    return _row("chrom", F.lit("panel"), kind, F.col("start") + 1, "stop", F.lit("."), F.lit("+"), F.lit("0"), attributes)


def gff_regions(spark: SparkSession, folder: str) -> DataFrame:
    return read_gff(spark, _by_chrom(_feature_lines(spark, folder, _gff()), "panels.gff3")).select("chrom", "start", "stop", "name", "type")


def gff_regions_by_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """All types, named by whatever attribute begins with P."""
    return read_gff(spark, _by_chrom(_feature_lines(spark, folder, _gff()), "panels.gff3"), feature=None, key="P", prefix=True).select("chrom", "start", "stop", "name", "type")


def gtf_regions(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("region_id") % 3 == 0, "gene").otherwise("exon")
    attributes = F.concat(F.lit('transcript_id "t'), F.col("region_id").cast("string"), F.lit('";'), F.coalesce(F.concat(F.lit(' gene_id "'), "name", F.lit('";')), F.lit("")))
    lines = _feature_lines(spark, folder, _row("chrom", F.lit("panel"), kind, F.col("start") + 1, "stop", F.lit("."), F.lit("+"), F.lit("."), attributes))
    return read_gtf(spark, _by_chrom(lines, "panels.gtf")).select("chrom", "start", "stop", "name", "type")


def gff_strict(spark: SparkSession, folder: str) -> DataFrame:
    """Every feature line with its faults; every kind of fault is in the text."""
    key = F.col("region_id")
    kind = F.when(key % 5 == 0, "CDS part").when(key % 5 == 1, "exon").when(key % 5 == 2, "SO:0000147").otherwise("CDS")
    strand = F.when(key % 7 == 0, "?").otherwise("-")
    phase = F.when(key % 11 == 0, "3").otherwise("2")
    attributes = F.when(key % 13 == 0, F.concat(F.lit("ID="), "name", F.lit(";loose"))).otherwise(F.concat(F.lit("Parent=p"), F.coalesce(F.concat(F.lit(";ID="), "name", F.lit(";")), F.lit(""))))
    whole = _row("chrom", F.lit("panel"), kind, F.col("start") + 1, "stop", F.lit("."), strand, phase, attributes)
    line = F.when(key % 17 == 0, F.concat(whole, F.lit("\tmore"))).otherwise(whole)
    found = read_gff_strict(spark, _by_chrom(_feature_lines(spark, folder, line), "strict.gff3"))
    return found.select("chrom", "start", "stop", "name", F.array_join("faults", ",").alias("faults"))


def regions_by_format(spark: SparkSession, folder: str) -> DataFrame:
    """Formats told by the files' names."""
    lines = _feature_lines(spark, folder, _gff())
    gtf = _row("chrom", F.lit("panel"), F.lit("CDS"), F.col("start") + 1, "stop", F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit('ID "'), F.coalesce("name", F.lit("")), F.lit('";')))
    texts = [_bed_text(spark, folder), _by_chrom(lines, "panels.GFF3"), _by_chrom(_feature_lines(spark, folder, gtf), "panels.gtf")]
    found = [read_regions(spark, path).select(F.lit(kind).alias("format"), "chrom", "start", "stop", "name") for kind, path in zip(("bed", "gff", "gtf"), texts)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def regions_bound(spark: SparkSession, folder: str) -> DataFrame:
    """Regions on the tids of the references."""
    raw = read_bed(spark, _bed_text(spark, folder)).select("chrom", "start", "stop", "name")
    return bind_regions(raw, table(spark, folder, "refs"))


def read_intervals_from_bed(spark: SparkSession, folder: str) -> DataFrame:
    """Reads in text with 1-based bounds and a strand."""
    rows = table(spark, folder, "regions").where("chrom IS NOT NULL")
    path = _text(rows.select(_row("chrom", F.col("start") + 1, "stop", F.when(F.col("region_id") % 2 == 0, "-").otherwise("+")).alias("value")), "reads.bed")
    return read_read_bed(spark, path).select("chrom", "start", "stop", "reverse")


# coverage and sequences


def _coverage_text(spark: SparkSession, folder: str) -> str:
    named = table(spark, folder, "coverage").join(table(spark, folder, "refs").select("tid", "name"), "tid")
    return _text(named.select(_row("name", "start", "stop", "forward").alias("value")), "depth.bed")


def coverage_text(spark: SparkSession, folder: str) -> DataFrame:
    return read_coverage_bed(spark, _coverage_text(spark, folder))


def coverage_text_corrupt(spark: SparkSession, folder: str) -> DataFrame:
    return read_coverage_bed(spark, _coverage_text(spark, folder), corrupt=True).select("line")


def reference_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """A table of names and lengths, numbered in its order."""
    lines = table(spark, folder, "refs").orderBy("tid").coalesce(1).select(_row("name", "length").alias("value"))
    return read_lengths(spark, _text(lines, "lengths"))


def fasta_records(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    bases = F.translate(F.md5("p_name"), "0123456789abcdef", "ACGT" * 4)
    record = F.concat(F.lit(">part_"), key, F.lit(" size > "), F.col("p_size").cast("string"), F.lit("\n"), F.substring(bases, 1, 20), F.lit("\r\n"), F.substring(bases, 21, 12))
    return read_fasta(spark, _text(table(spark, folder, "part").select(record.alias("value")), "parts.fa"))


def random_fasta(spark: SparkSession, folder: str) -> DataFrame:
    """Random bases for every reference, by lines."""
    return sinks.fasta_lines(testdata.refs(spark, folder), seed=7).select(F.col("o1").alias("tid"), F.col("o2").alias("line"), "value")


def masked_fasta(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.fasta_lines(testdata.refs(spark, folder)).select(F.col("o1").alias("tid"), F.col("o2").alias("line"), "value")


# alignments


def _reads(spark: SparkSession, folder: str) -> DataFrame:
    """The alignments table with bases made from the names, as SAM has them."""
    base = F.translate(F.md5("qname"), "0123456789abcdef", "ACGT" * 4)
    known = F.when(F.col("chrom") >= 0, F.col("chrom"))
    return table(spark, folder, "alignments").select("qname", "flag", known.alias("tid"), "start", "stop", "mapq", "cigar", F.when(F.col("mate_tid") >= 0, F.col("mate_tid")).alias("mate_tid"), "mate_pos", "isize", base.alias("seq"), F.translate(base, "ACGT", "I?5+").alias("qual"))


def _sam_text(spark: SparkSession, folder: str) -> str:
    return _text(sinks.sam_lines(_reads(spark, folder), table(spark, folder, "refs")), "run7.x.sam")


_SAM = ["qname", "flag", "tid", "start", "stop", "mapq", "cigar", "mate_tid", "mate_pos", "isize", "seq", "qual"]


def sam_alignments(spark: SparkSession, folder: str) -> DataFrame:
    return read_sam(spark, _sam_text(spark, folder), table(spark, folder, "refs")).select(*_SAM)


def _bam_folder(spark: SparkSession, folder: str) -> str:
    path = f"{scratch_folder(spark, 'bam')}/runs"
    write_bam(_reads(spark, folder), table(spark, folder, "refs"), path)
    return path


def bam_alignments(spark: SparkSession, folder: str) -> DataFrame:
    return read_bam(spark, _bam_folder(spark, folder)).select(*_SAM)


def bam_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Depth from BAM files of which only what depth needs is decoded."""
    path = _bam_folder(spark, folder)
    known = read_bam_refs(spark, path)
    found = read_intervals(read_bam(spark, path, DEPTH_COLUMNS), known).withColumn("sample", F.lit("all"))
    return coverage(found, known, samples=["all"]).select("tid", "start", "stop", "cov")


def header_references(spark: SparkSession, folder: str) -> DataFrame:
    """The reference dictionaries of a SAM text and of BAM files."""
    ordered = sinks.sam_lines(_reads(spark, folder).limit(0), table(spark, folder, "refs")).orderBy("o2").coalesce(1)
    sam = read_sam_refs(spark, _text(ordered, "head.sam"))
    bam = read_bam_refs(spark, _bam_folder(spark, folder))
    return sam.select(F.lit("sam").alias("source"), "*").unionByName(bam.select(F.lit("bam").alias("source"), "*"))


def streamed_sam(spark: SparkSession, folder: str) -> DataFrame:
    """SAM text that comes in as a stream of files."""
    base = scratch_folder(spark, "stream")
    rows = stream_sam(spark, _sam_text(spark, folder), table(spark, folder, "refs")).select("qname", "flag", "tid", "start", "stop")
    rows.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("qname string, flag int, tid int, start bigint, stop bigint").parquet(f"{base}/out")


def by_reference_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Reads per reference from a folder for each, in which they lie by start."""
    path = f"{scratch_folder(spark, 'refs')}/reads"
    sinks.write_by_reference(_reads(spark, folder).where("tid IS NOT NULL"), path)
    rows = spark.read.parquet(path)
    return rows.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"), F.max("start").alias("last_start"))


def sam_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """SAM text in the order of the references and of the starts: which reference and start each line has."""
    out = _written(sinks.sam_lines(_reads(spark, folder), table(spark, folder, "refs")))
    f = F.split("value", "\t")
    return out.where(~F.col("value").startswith("@")).select("line_no", f[2].alias("rname"), f[3].alias("pos"))


def fastq_records(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.fastq_lines(_reads(spark, folder)).select("value")


def sequences_hidden(spark: SparkSession, folder: str) -> DataFrame:
    """Reads without their bases and names."""
    rows = _reads(spark, folder)
    masked = rewrite_sequences(rows, "mask", rename=True).select("qname", "flag", "seq", F.lit("mask").alias("how"))
    return masked.unionByName(rewrite_sequences(rows, "erase").select("qname", "flag", "seq", F.lit("erase").alias("how")))


def sequences_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every read's shuffled bases are its own."""
    rows = _reads(spark, folder).select("qname", "flag", "seq", F.col("seq").alias("own"))
    in_order = lambda c: F.array_sort(F.regexp_extract_all(F.col(c), F.lit("."), F.lit(0)))
    return rewrite_sequences(rows, "shuffle").select("qname", "flag", (in_order("seq") == in_order("own")).alias("same_bases"))


# writers


def bed_output(spark: SparkSession, folder: str) -> DataFrame:
    return _written(sinks.bed_lines(cov._runs(spark, folder), testdata.refs(spark, folder), ["cov"]))


def bed_output_stranded(spark: SparkSession, folder: str) -> DataFrame:
    return _written(sinks.bed_lines(cov._runs(spark, folder, stranded=True), testdata.refs(spark, folder), ["fwd", "rev"]))


def wig_output(spark: SparkSession, folder: str) -> DataFrame:
    known = testdata.refs(spark, folder)
    spans = fill_spans(span_summary(cov._runs(spark, folder), known, cov.SPAN, "max"), known, cov.SPAN, ["all"])
    return _written(sinks.wig_lines(spans, known, cov.SPAN, ["cov"]))


def report_output(spark: SparkSession, folder: str) -> DataFrame:
    """The wide report in the order of the regions; whole numbers only, so that the text is the same everywhere."""
    target = testdata.regions(spark, folder, pooled=True)
    stats = region_stats(cov._sample_runs(spark, folder), target, samples=SAMPLES).drop("mean")
    lines = sinks.report_lines(wide_report(stats, SAMPLES))
    return _written(sinks.in_region_order(lines, name_order(target)))


def _counted(spark: SparkSession, folder: str, **how) -> tuple[DataFrame, DataFrame]:
    known, reads = testdata.refs(spark, folder), testdata.alignments(spark, folder).withColumn("sample", F.lit("all"))
    bound = testdata.regions(spark, folder, pooled=True).join(known.select("tid", F.col("name").alias("chrom")), "tid")
    return region_counts(read_intervals(reads, known, cov.QUALITY), bound, samples=["all"], total_reads=total_reads(reads), **how), bound


def counts_output(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of the counts, with a header, in the order of the names' first regions."""
    counts, bound = _counted(spark, folder)
    lines = sinks.count_lines(counts, stranded=True, coords=True, rpkm=True, per_position=True, precision=3, header=True)
    return _written(sinks.in_region_order(lines, name_order(bound)))


def counts_output_plain(spark: SparkSession, folder: str) -> DataFrame:
    return _written(sinks.count_lines(_counted(spark, folder)[0]))


def ref_counts_output(spark: SparkSession, folder: str) -> DataFrame:
    return _written(sinks.ref_count_lines(cov.ref_counts_matrix(spark, folder), tag="Reference", multiqc=True))


def sample_matrix_output(spark: SparkSession, folder: str) -> DataFrame:
    return _written(sinks.report_lines(sample_matrix(cov.ref_counts(spark, folder), "name", "counts", SAMPLES), first="#Feature"))


def target_output(spark: SparkSession, folder: str) -> DataFrame:
    target = testdata.regions(spark, folder, pooled=True)
    return _written(sinks.target_lines(coverage_to_target(cov._runs(spark, folder).drop("sample"), target)))


def target_output_bed(spark: SparkSession, folder: str) -> DataFrame:
    """A BED line for each region, with the bases of its name."""
    named = testdata.regions(spark, folder).join(testdata.refs(spark, folder).select("tid", F.col("name").alias("chrom")), "tid")
    found = coverage_to_target(cov._runs(spark, folder).drop("sample"), testdata.regions(spark, folder))
    return _written(sinks.target_lines(found, regions=named))


def mean_output(spark: SparkSession, folder: str) -> DataFrame:
    """Rounded means of each reference and sample, and over all references."""
    means = mean_depths(cov._sample_runs(spark, folder), testdata.refs(spark, folder), SAMPLES, total=True)
    return _written(sinks.mean_lines(means, SAMPLES))


def regions_output(spark: SparkSession, folder: str) -> DataFrame:
    named = testdata.regions(spark, folder).join(testdata.refs(spark, folder).select("tid", F.col("name").alias("chrom")), "tid")
    return _written(sinks.region_lines(named))


def regions_output_bound(spark: SparkSession, folder: str) -> DataFrame:
    return _written(sinks.region_lines(testdata.regions(spark, folder), bound=True))


def gff_to_bed(spark: SparkSession, folder: str) -> DataFrame:
    found = read_gff(spark, _by_chrom(_feature_lines(spark, folder, _gff()), "panels.gff3"))
    return sinks.region_lines(found.select("chrom", "start", "stop", "name")).select("value")


def gtf_output(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "regions").where("chrom IS NOT NULL AND start < stop")
    return sinks.gtf_lines(rows.withColumn("name", default_name(F.col("name"), F.col("chrom"), F.col("start"), F.col("stop")))).select("value")


# benchmark logs


def _logs(spark: SparkSession, folder: str) -> DataFrame:
    """A log for each of the region files, whose table has a fixed size."""
    path = scratch_folder(spark, "logs")
    for row in table(spark, folder, "region_files").select("file_no", "n_cols").collect():
        n = row["file_no"]
        text = f"run {n}\nelapsed time:\t{n * 7 % 50}.{n % 4 * 25:02d}\n" + (f"peak rss:\t{n * 1000}\n" if n % 5 else "peak rss: lost\n")
        with replacing_file(path, f"mem.set{row['n_cols']}.tool.v{n % 6}.txt", "0") as out:
            out.write(text.encode())
    return read_benchmarks(spark, path)


def benchmark_times(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_matrix(_logs(spark, folder), "seconds", [f"tool-v{i}" for i in range(6)])


def benchmark_memory(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_matrix(_logs(spark, folder), "kilobytes", [f"tool-v{i}" for i in range(6)])


QUERIES = {
    f.__name__: f
    for f in (
        bed_regions, bed_corrupt, gff_regions, gff_regions_by_prefix, gtf_regions, gff_strict, regions_by_format, regions_bound, read_intervals_from_bed,
        coverage_text, coverage_text_corrupt, reference_lengths, fasta_records, random_fasta, masked_fasta,
        sam_alignments, bam_alignments, bam_coverage, header_references, streamed_sam, by_reference_scan, sam_sorted, fastq_records, sequences_hidden, sequences_shuffled,
        bed_output, bed_output_stranded, wig_output, report_output, counts_output, counts_output_plain, ref_counts_output, sample_matrix_output, target_output, target_output_bed, mean_output,
        regions_output, regions_output_bound, gff_to_bed, gtf_output, benchmark_times, benchmark_memory,
    )
}

_GOOD = "chrom IS NOT NULL AND start IS NOT NULL AND stop IS NOT NULL AND start <= stop"
_NAMED = "coalesce(nullif(name, ''), chrom || ':' || start || '-' || stop)"
_BED_LINE = "coalesce(chrom, '') || chr(9) || coalesce(CAST(start AS VARCHAR), '') || chr(9) || coalesce(CAST(stop AS VARCHAR), '') || chr(9) || coalesce(name, '')"


def _features(kind: str, name: str = _NAMED, where: str = "region_id % 3 <> 0") -> str:
    return f"SELECT chrom, start, stop, {name} AS name, {kind} AS type FROM regions WHERE {_GOOD} AND {where}"


_DEPTH_LINE = "r.name || chr(9) || c.start || chr(9) || c.stop || chr(9) || coalesce(CAST(forward AS VARCHAR), '')"
_READ = """rd AS (SELECT qname, flag, CASE WHEN chrom >= 0 THEN chrom END AS tid, start, mapq, cigar, CASE WHEN mate_tid >= 0 THEN mate_tid END AS mate_tid, mate_pos, isize,
  CAST(start + CASE WHEN flag & 4 <> 0 THEN 1 ELSE greatest(1, coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT))), 0)) END AS BIGINT) AS stop,
  translate(md5(qname), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM alignments)"""
_READS = f"WITH {_READ} SELECT qname, flag, tid, start, stop, mapq, cigar, mate_tid, mate_pos, isize, seq, translate(seq, 'ACGT', 'I?5+') AS qual FROM rd"
_TABBED = " || chr(9) || ".join


def _lined(source: str, value: str, order: str) -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS line_no, {value} AS value FROM {source}"


def _after(head: list[str], body: str) -> str:
    """Lines after ``head``."""
    top = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS line_no, '{h.replace("'", "''")}' AS value" for i, h in enumerate(head))
    return f"{top} UNION ALL SELECT line_no + {len(head)}, value FROM ({body})"


def _fasta(bases: str) -> str:
    return cov._with() + f"""SELECT tid, CAST(-1 AS BIGINT) AS line, '>' || name AS value FROM refs UNION ALL
SELECT tid, k AS line, {bases} AS value FROM (SELECT *, unnest(generate_series(0, (length - 1) // 64)) AS k FROM refs)"""


_FIRST = "fr AS (SELECT pooled AS name, min((tid, start)) AS place FROM reg GROUP BY pooled)"
_CELLS = [f"coalesce(CAST(max({m}) FILTER (WHERE sample = '{s}') AS VARCHAR), '0')" for s in SAMPLES for m in ("bases", "min", "max")]
_COORDS = """cd AS (SELECT pooled AS name, string_agg(r.name, ';' ORDER BY g.tid, g.start, g.stop) AS chrom, string_agg(CAST(g.start AS VARCHAR), ';' ORDER BY g.tid, g.start, g.stop) AS starts,
  string_agg(CAST(g.stop AS VARCHAR), ';' ORDER BY g.tid, g.start, g.stop) AS stops, CAST(sum(g.stop - g.start) AS DOUBLE) AS length FROM reg g JOIN refs r USING (tid) GROUP BY pooled)"""
_MEANS = ["printf('%.2f', CAST(sum(cov * (stop - start)) FILTER (WHERE sample = '{s}') AS DOUBLE) / sum(stop - start) FILTER (WHERE sample = '{s}'))".format(s=s) for s in SAMPLES]
_LOG = "WITH l AS (SELECT file_no AS n, n_cols FROM region_files) SELECT 'set' || n_cols AS dataset, "

SQL = {
    "bed_regions": f"SELECT chrom, start, stop, {_NAMED} AS name FROM regions WHERE {_GOOD}",
    "bed_corrupt": f"SELECT {_BED_LINE} AS line FROM regions WHERE NOT coalesce({_GOOD}, false) AND NOT regexp_full_match({_BED_LINE}, '\\s*')",
    "gff_regions": _features("'CDS'"),
    "gff_regions_by_prefix": _features("CASE WHEN region_id % 3 = 0 THEN 'gene' ELSE 'CDS' END", "'p' || panel_id", "true"),
    "gtf_regions": _features("'exon'"),
    "gff_strict": """SELECT chrom, start, stop, nullif(name, '') AS name, array_to_string(list_filter([
  CASE WHEN length(chrom) = 4 THEN 'header' END, CASE WHEN region_id % 17 = 0 THEN 'columns' END, CASE WHEN region_id % 5 = 0 THEN 'type' END,
  CASE WHEN NOT coalesce(start < stop, false) THEN 'bounds' END, CASE WHEN region_id % 7 = 0 THEN 'strand' END, CASE WHEN region_id % 11 = 0 THEN 'phase' END,
  CASE WHEN region_id % 13 = 0 THEN 'attributes' END, CASE WHEN nullif(name, '') IS NULL THEN 'name' END], lambda x: x IS NOT NULL), ',') AS faults
FROM regions WHERE chrom IS NOT NULL""",
    "regions_by_format": f"""SELECT 'bed' AS format, chrom, start, stop, {_NAMED} AS name FROM regions WHERE {_GOOD} UNION ALL
SELECT 'gff', chrom, start, stop, {_NAMED} FROM regions WHERE {_GOOD} AND region_id % 3 <> 0 UNION ALL SELECT 'gtf', chrom, start, stop, {_NAMED} FROM regions WHERE {_GOOD}""",
    "regions_bound": f"SELECT r.tid, g.start, g.stop, coalesce(nullif(g.name, ''), chrom || ':' || g.start || '-' || g.stop) AS name, chrom FROM (SELECT * FROM regions WHERE {_GOOD}) g JOIN refs r ON g.chrom = r.name",
    "read_intervals_from_bed": f"SELECT chrom, start, stop, region_id % 2 = 0 AS reverse FROM regions WHERE {_GOOD} AND start < stop",
    "coverage_text": "SELECT r.name AS chrom, c.start, c.stop, forward AS cov FROM coverage c JOIN refs r USING (tid) WHERE forward >= 0",
    "coverage_text_corrupt": f"SELECT {_DEPTH_LINE} AS line FROM coverage c JOIN refs r USING (tid) WHERE forward IS NULL OR forward < 0",
    "reference_lengths": "SELECT tid, name, length FROM refs",
    "fasta_records": "SELECT 'part_' || p_partkey AS name, 'size > ' || p_size AS description, translate(md5(p_name), '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence FROM part",
    "random_fasta": _fasta("substring(translate(md5(name || ':7:' || k || ':0') || md5(name || ':7:' || k || ':1'), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, CAST(least(64, length - 64 * k) AS INTEGER))"),
    "masked_fasta": _fasta("repeat('N', CAST(least(64, length - 64 * k) AS INTEGER))"),
    "sam_alignments": _READS,
    "bam_alignments": _READS,
    "bam_coverage": f"""WITH {_READ}, kn AS (SELECT rd.tid, start, least(stop, r.length) AS stop FROM rd JOIN refs r USING (tid) WHERE flag & 1796 = 0 AND start < least(stop, r.length)),
net AS (SELECT tid, pos, sum(d) AS d FROM (SELECT tid, greatest(start, 0) AS pos, 1 AS d FROM kn UNION ALL SELECT tid, stop, -1 FROM kn UNION ALL SELECT tid, 0, 0 FROM refs) GROUP BY ALL),
chg AS (SELECT n.*, length FROM net n JOIN refs USING (tid) WHERE pos < length AND (pos = 0 OR d <> 0))
SELECT tid, CAST(pos AS BIGINT) AS start, CAST(coalesce(lead(pos) OVER w, length) AS BIGINT) AS stop, CAST(sum(d) OVER w AS BIGINT) AS cov FROM chg WINDOW w AS (PARTITION BY tid ORDER BY pos)""",
    "header_references": "SELECT s.source, tid, name, length FROM refs, (SELECT unnest(['sam', 'bam']) AS source) s",
    "streamed_sam": f"WITH {_READ} SELECT qname, flag, tid, start, stop FROM rd",
    "by_reference_scan": f"WITH {_READ} SELECT tid, count(*) AS n, min(start) AS first_start, max(start) AS last_start FROM rd WHERE tid IS NOT NULL GROUP BY tid",
    "sam_sorted": f"""WITH {_READ} SELECT CAST(row_number() OVER (ORDER BY coalesce(tid, 1 << 30), start) - 1 + (SELECT count(*) FROM refs) AS BIGINT) AS line_no,
  coalesce(r.name, '*') AS rname, CAST(start + 1 AS VARCHAR) AS pos FROM rd LEFT JOIN refs r USING (tid)""",
    "fastq_records": f"""WITH {_READ} SELECT '@' || qname || CASE WHEN flag & 64 <> 0 THEN '/1' WHEN flag & 128 <> 0 THEN '/2' ELSE '' END || chr(9) || coalesce(CAST(mate_tid AS VARCHAR), '*') || ':' || coalesce(CAST(mate_pos AS VARCHAR), '*')
  || chr(10) || seq || chr(10) || '+' || chr(10) || translate(seq, 'ACGT', 'I?5+') AS value FROM rd""",
    "sequences_hidden": f"WITH {_READ} SELECT 'read_' || md5(qname) AS qname, flag, repeat('N', 32) AS seq, 'mask' AS how FROM rd UNION ALL SELECT qname, flag, '*', 'erase' FROM rd",
    "sequences_shuffled": "SELECT qname, flag, true AS same_bases FROM alignments",
    "bed_output": cov._with(cov._kept(), cov._ALL) + _lined("runs u JOIN refs r USING (tid)", _TABBED(["r.name", "u.start", "u.stop", "cov"]), "tid, u.start"),
    "bed_output_stranded": cov._with(cov._kept(), cov._sweep("'all'", keep="df <> 0 OR dr <> 0")) + _lined("runs u JOIN refs r USING (tid)", _TABBED(["r.name", "u.start", "u.stop", "fwd", "rev"]), "tid, u.start"),
    "wig_output": cov._with(
        cov._kept(), cov._ALL,
        f"sp AS (SELECT tid, k, max(cov) AS cov FROM (SELECT *, unnest(generate_series(start // {cov.SPAN}, (stop - 1) // {cov.SPAN})) AS k FROM runs) GROUP BY tid, k)",
        f"li AS (SELECT tid, k, CAST(cov AS VARCHAR) AS value FROM sp UNION ALL SELECT tid, -1, 'fixedStep chrom=' || name || ' start=1 step={cov.SPAN} span={cov.SPAN}' FROM refs)",
    ) + _lined("li", "value", "tid, k"),
    "report_output": cov._with(cov._kept(), cov._EACH, cov._pieces("pooled"), _FIRST, f"st AS (SELECT sample, name, {cov._STAT['cov']}, {cov._LENGTH} FROM pc GROUP BY sample, name)",
        f"wi AS (SELECT n.name, place, {_TABBED(['n.name', *_CELLS, 'CAST(coalesce(max(length), 0) AS VARCHAR)'])} AS value FROM fr n LEFT JOIN st USING (name) GROUP BY n.name, place)")
    + _after(["\t".join(["interval", *(f"{s}_{m}" for s in SAMPLES for m in ("bases", "min", "max")), "length"])], _lined("wi", "value", "place, name")),
    "counts_output": cov._count_sql().rstrip() + f", {_FIRST}, {_COORDS}\n"
    + _after(["\t".join(["#Feature", "Chrom", "Starts", "Stops", "Forward", "Reverse", "RPKM", "Counts/Length"])], _lined("co JOIN fr USING (name) JOIN cd USING (name)", _TABBED(["name", "chrom", "starts", "stops", "fwd", "rev", "printf('%.3f', CAST(counts AS DOUBLE) / ((SELECT count(*) FROM aln) / CAST(1e6 AS DOUBLE)) / (length / CAST(1e3 AS DOUBLE)))", "printf('%.3f', CAST(counts AS DOUBLE) / length)"]), "place, name")),
    "counts_output_plain": cov._count_sql() + _lined("co", _TABBED(["name", "counts"]), "name"),
    "ref_counts_output": cov._with(cov._REFCO, "m AS (SELECT name, " + ", ".join(f"sum(counts) FILTER (WHERE sample = '{s}') AS c{s}" for s in SAMPLES) + " FROM rc GROUP BY name)")
    + _after([*sinks.MULTIQC, "\t".join(["Reference", *SAMPLES])], _lined("m", _TABBED(["name", *(f"c{s}" for s in SAMPLES)]), "name")),
    "sample_matrix_output": cov._with(cov._REFCO, "m AS (SELECT name, " + ", ".join(f"sum(counts) FILTER (WHERE sample = '{s}') AS c{s}" for s in SAMPLES) + " FROM rc GROUP BY name)")
    + _after(["\t".join(["#Feature", *SAMPLES])], _lined("m", _TABBED(["name", *(f"c{s}" for s in SAMPLES)]), "name")),
    "target_output": cov._with(cov._kept(), cov._ALL, cov._pieces("pooled"), "tb AS (SELECT n.name, coalesce(CAST(sum(cov * (stop - start)) AS BIGINT), 0) AS bases FROM (SELECT DISTINCT pooled AS name FROM reg) n LEFT JOIN pc USING (name) GROUP BY n.name)")
    + _lined("tb", _TABBED(["name", "bases"]), "name"),
    "target_output_bed": cov._with(cov._kept(), cov._ALL, cov._pieces("name"), "tb AS (SELECT n.name, coalesce(CAST(sum(cov * (stop - start)) AS BIGINT), 0) AS bases FROM (SELECT DISTINCT name FROM reg) n LEFT JOIN pc USING (name) GROUP BY n.name)")
    + _lined("reg g JOIN tb USING (name) JOIN refs r USING (tid)", _TABBED(["r.name", "g.start", "g.stop", "g.name", "bases"]), "r.name, g.start"),
    "mean_output": cov._with(cov._kept(), cov._EACH, f"me AS (SELECT coalesce(name, '#Total') AS name, {_TABBED(_MEANS)} AS cells FROM runs JOIN refs USING (tid) GROUP BY ROLLUP (name))")
    + _after(["\t".join(["Sequence", *SAMPLES])], _lined("me", "name || chr(9) || cells", "name = '#Total', name")),
    "regions_output": cov._with() + _lined("reg g JOIN refs r USING (tid)", _TABBED(["r.name", "g.start", "g.stop", "g.name"]), "r.name, g.start"),
    "regions_output_bound": cov._with() + _lined("reg", "'[' || tid || '] ' || start || ' ' || stop || ' ' || name", "tid, start"),
    "gff_to_bed": f"SELECT chrom || chr(9) || start || chr(9) || stop || chr(9) || {_NAMED} AS value FROM regions WHERE {_GOOD} AND region_id % 3 <> 0",
    "gtf_output": f"SELECT chrom || chr(9) || 'tidespan' || chr(9) || 'exon' || chr(9) || (start + 1) || chr(9) || stop || chr(9) || '.' || chr(9) || '+' || chr(9) || '.' || chr(9) || 'gene_id \"' || {_NAMED} || '\"; transcript_id \"' || {_NAMED} || '\";' AS value FROM regions WHERE chrom IS NOT NULL AND start < stop",
    "benchmark_times": _LOG + ", ".join(f"max(CAST(n * 7 % 50 AS DOUBLE) + CAST(n % 4 AS DOUBLE) / 4) FILTER (WHERE n % 6 = {i}) AS \"tool-v{i}\"" for i in range(6)) + " FROM (SELECT n_cols, max(n) AS n FROM l GROUP BY n_cols, n % 6) GROUP BY n_cols",
    "benchmark_memory": _LOG + ", ".join(f"max(CASE WHEN n % 5 = 0 THEN -1 ELSE CAST(n * 1000 AS BIGINT) END) FILTER (WHERE n % 6 = {i}) AS \"tool-v{i}\"" for i in range(6)) + " FROM (SELECT n_cols, max(n) AS n FROM l GROUP BY n_cols, n % 6) GROUP BY n_cols",
}
