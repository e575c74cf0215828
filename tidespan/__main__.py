"""Command line: ``python -m tidespan COMMAND ...``; each command prints or writes text."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidespan.durable import scratch_folder
from tidespan.operators.alignments import keep_fragments, keep_reads, read_intervals
from tidespan.operators.joins import bind_regions
from tidespan.operators.lengths import whole_references
from tidespan.operators.multisample import antitarget, sample_matrix, shared_low_coverage, wide_report
from tidespan.operators.spans import fill_spans, span_summary
from tidespan.operators.stats import clip_to_regions, count_refs, coverage_to_target, mapped_reads, name_order, ref_stats, region_counts, region_stats, total_reads
from tidespan.operators.sweep import coverage
from tidespan.options import COMPAT_COUNTS, DEFAULT_FLAG_MASK, SPAN_FUNCTIONS, InputOptions, OutputOptions
from tidespan.session import ship
from tidespan.sources import sinks
from tidespan.sources.files import replacing_file
from tidespan.sources.regions import GFF_ID, GFF_TYPE, read_coverage_bed, read_regions
from tidespan.sources.sam import DEPTH_COLUMNS, read_bam, read_bam_refs, read_sam, read_sam_refs, refuse_cram


def _alignments(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Alignments of all files on the first file's references, the references, the samples in order."""
    refs, found = None, None
    for i, path in enumerate(paths):
        refuse_cram(path)
        if path == "-":
            path = paths[i] = _spooled(spark)
        bam = path.lower().endswith(".bam")
        if refs is None:
            refs = read_bam_refs(spark, path) if bam else read_sam_refs(spark, path)
        one = read_bam(spark, path, DEPTH_COLUMNS) if bam else read_sam(spark, path, refs).select(*DEPTH_COLUMNS)
        found = one if found is None else found.unionByName(one)
    samples = [p.rsplit("/", 1)[-1].split(".")[0] for p in paths]
    if len(set(samples)) < len(samples):
        raise SystemExit("the files' names up to the first dot must differ")
    return found, refs, samples


def _spooled(spark: SparkSession) -> str:
    """SAM text from the standard input, in a file that every executor can read."""
    folder = scratch_folder(spark, "stdin")
    with replacing_file(folder, "stdin.sam", "0") as out:
        while part := sys.stdin.buffer.read(1 << 20):
            out.write(part)
    return f"{folder}/stdin.sam"


def _target(spark: SparkSession, args: argparse.Namespace, refs: DataFrame) -> DataFrame:
    kind = "gff" if args.gff else "gtf" if args.gtf else None
    return bind_regions(read_regions(spark, args.regions, kind, feature=args.type, key=args.id, separator=args.separator), refs)


def _write(lines: DataFrame, out: str | None) -> None:
    if out:
        sinks.write_lines(lines, out)
        return
    order = [c for c in lines.columns if c != "value"]
    for row in lines.orderBy(*order).select("value").toLocalIterator():
        print(row["value"])


def _coverage(spark: SparkSession, args: argparse.Namespace) -> None:
    found, refs, samples = _alignments(spark, args.alignments)
    options = InputOptions(args.mapq, args.flag, args.physical, args.extend_reads)
    shape = OutputOptions(args.stranded, args.quantize, args.wig, args.op, args.report_low)
    intervals = read_intervals(found, refs, options)
    runs = coverage(intervals, refs, stranded=shape.stranded, samples=samples)
    target = _target(spark, args, refs) if args.regions else None
    if len(samples) > 1 and target is None:
        raise SystemExit("several files need --regions")
    values = ["fwd", "rev"] if shape.stranded else ["cov"]
    if not args.skip_output and len(samples) == 1:
        if shape.span:
            spans = fill_spans(span_summary(runs, refs, shape.span, shape.op, columns=values), refs, shape.span, samples)
            _write(sinks.wig_lines(spans, refs, shape.span, values), args.out)
        elif shape.quantize:
            banded = coverage(intervals, refs, stranded=shape.stranded, samples=samples, bands=shape.quantize)
            _write(sinks.bed_lines(clip_to_regions(banded, target) if target is not None else banded, refs, ["band_fwd", "band_rev"] if shape.stranded else ["band"]), args.out)
        else:
            _write(sinks.bed_lines(clip_to_regions(runs, target) if target is not None else runs, refs, values), args.out)
    if args.report:
        how = {"stranded": shape.stranded, "low": shape.report_low}
        stats = region_stats(runs, target, samples=samples, **how) if target is not None else ref_stats(runs, refs, **how)
        order = name_order(target if target is not None else whole_references(refs))
        sinks.write_lines(sinks.in_region_order(sinks.report_lines(wide_report(stats, samples)), order), args.report)


def _counts(spark: SparkSession, args: argparse.Namespace) -> None:
    found, refs, samples = _alignments(spark, args.alignments)
    reads = keep_fragments(found) if args.paired else found
    least = COMPAT_COUNTS.min_mapq if args.compat else args.mapq
    intervals = read_intervals(reads, refs, InputOptions(least, args.flag))
    target = _target(spark, args, refs)
    counts = region_counts(intervals, target, samples=samples, total_reads=total_reads(found) if args.rpkm else None, strict=args.strict, compat=args.compat)
    if len(samples) > 1:
        lines = sinks.report_lines(sample_matrix(counts, "name", "counts", samples), first="#Feature")
    else:
        lines = sinks.count_lines(counts, stranded=args.stranded, coords=args.coords, rpkm=args.rpkm, per_position=args.norm_len, precision=args.precision, header=args.header)
    _write(sinks.in_region_order(lines, name_order(target)), args.out)


def _refcounts(spark: SparkSession, args: argparse.Namespace) -> None:
    found, refs, samples = _alignments(spark, args.alignments)
    kept = keep_reads(found, InputOptions(args.mapq, args.flag))
    counts = count_refs(kept, refs, samples, mapped=mapped_reads(found) if args.cpm else None)
    _write(sinks.ref_count_lines(sample_matrix(counts, "name", "cpm" if args.cpm else "counts", samples), tag=args.tag, multiqc=args.multiqc), args.out)


def _totarget(spark: SparkSession, args: argparse.Namespace) -> None:
    cover = read_coverage_bed(spark, args.coverage)
    kind = "gff" if args.gff else "gtf" if args.gtf else None
    raw = read_regions(spark, args.regions, kind, feature=args.type, key=args.id, separator=args.separator)
    names = cover.select("chrom").union(raw.select("chrom")).distinct()
    numbered = names.select(F.xxhash64("chrom").alias("tid"), "chrom")
    on = lambda df: df.join(numbered, "chrom")
    found = coverage_to_target(on(cover), on(raw), normalise=args.norm_len)
    _write(sinks.target_lines(found, value="per_position" if args.norm_len else "bases", regions=raw if args.bed_output else None), args.out)


def _regions(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.alignments:
        _, refs, _ = _alignments(spark, args.alignments)
        bound = _target(spark, args, refs)
        if args.antitarget:
            _write(sinks.bed_lines(antitarget(bound, refs), refs, []), args.out)
        else:
            _write(sinks.region_lines(bound, bound=True), args.out)
        return
    if args.antitarget:
        raise SystemExit("--antitarget needs an alignment file for the references' lengths")
    kind = "gff" if args.gff else "gtf" if args.gtf else None
    _write(sinks.region_lines(read_regions(spark, args.regions, kind, feature=args.type, key=args.id, separator=args.separator)), args.out)


def _lowcov(spark: SparkSession, args: argparse.Namespace) -> None:
    found, refs, samples = _alignments(spark, args.alignments)
    runs = coverage(read_intervals(found, refs, InputOptions(args.mapq, args.flag)), refs, samples=samples)
    low = shared_low_coverage(runs, refs, args.min, args.max, len(samples), args.shared)
    _write(sinks.bed_lines(low, refs, ["n"]), args.out)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidespan", description="Coverage depth and read counts over intervals.")
    commands = parser.add_subparsers(required=True)

    def command(name: str, run: Callable, about: str, *, files: str | None = "+", filters: bool = True, regions: bool | None = None) -> argparse.ArgumentParser:
        """``regions``: True for a needed region file, False for an optional one, None for none."""
        p = commands.add_parser(name, help=about, description=about)
        p.set_defaults(run=run)
        if files:
            p.add_argument("alignments", nargs=files, help="SAM or BAM files; - reads SAM from the standard input")
        if filters:
            p.add_argument("-Q", "--mapq", type=int, default=0)
            p.add_argument("-F", "--flag", type=int, default=DEFAULT_FLAG_MASK)
        if regions is not None:
            p.add_argument("-r", "--regions", required=regions, help="BED, GFF3 or GTF")
            p.add_argument("-t", "--type", default=GFF_TYPE)
            p.add_argument("-i", "--id", default=GFF_ID)
            p.add_argument("--separator", default=";")
            p.add_argument("--gff", action="store_true")
            p.add_argument("--gtf", action="store_true")
        p.add_argument("--out", help="folder to write to instead of printing")
        return p

    p = command("coverage", _coverage, "Depth at every position, and statistics per region.", regions=False)
    p.add_argument("-p", "--physical", action="store_true")
    p.add_argument("-s", "--stranded", action="store_true")
    p.add_argument("-q", "--quantize", metavar="BREAKS")
    p.add_argument("-w", "--wig", type=int, default=0, metavar="SPAN")
    p.add_argument("--op", choices=SPAN_FUNCTIONS, default="max")
    p.add_argument("--extend-reads", type=int, default=0)
    p.add_argument("-o", "--report")
    p.add_argument("--report-low", type=int)
    p.add_argument("--skip-output", action="store_true")

    p = command("counts", _counts, "Reads on each region.", regions=True)
    for flag in ("--paired", "--strict", "--stranded", "--coords", "--header", "--compat"):
        p.add_argument(flag, action="store_true")
    p.add_argument("-n", "--rpkm", action="store_true")
    p.add_argument("-l", "--norm-len", action="store_true")
    p.add_argument("-p", "--precision", type=int, default=3)

    p = command("refcounts", _refcounts, "Reads on each reference, samples side by side.")
    p.add_argument("--cpm", action="store_true")
    p.add_argument("--tag", default="ViralSequence")
    p.add_argument("--multiqc", action="store_true")

    p = command("totarget", _totarget, "Coverage text summed by region.", files=None, filters=False, regions=True)
    p.add_argument("coverage")
    p.add_argument("-l", "--norm-len", action="store_true")
    p.add_argument("-b", "--bed-output", action="store_true")

    p = command("regions", _regions, "A region file as BED, bound to references, or what it leaves uncovered.", files="*", filters=False, regions=True)
    p.add_argument("-a", "--antitarget", action="store_true")

    p = command("lowcov", _lowcov, "Stretches that are thinly covered in many samples.")
    p.add_argument("--min", type=int, default=0)
    p.add_argument("--max", type=int, default=10)
    p.add_argument("--shared", type=float, default=1.0)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidespan").getOrCreate()
    ship(spark)
    try:
        args.run(spark, args)
    except ValueError as error:
        sys.exit(str(error))


if __name__ == "__main__":
    main()
