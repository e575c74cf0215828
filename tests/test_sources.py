"""Readers, writers, streams and generators."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidespan import generate
from tidespan.durable import numbered
from tidespan.functions.alignments import flag_bits, phred_text, phred_values, query_length, reference_length, sample_name, sample_name_long, swap_strand
from tidespan.functions.regions import attribute, fixed, size_in_bases
from tidespan.operators.alignments import read_intervals
from tidespan.operators.lengths import length_stats, rename_references, rewrite_sequences
from tidespan.operators.stats import region_counts, total_reads
from tidespan.operators.sweep import coverage
from tidespan.sources import regions as R
from tidespan.sources import sam, sinks
from tidespan.sources.logs import benchmark_matrix, read_benchmarks
from tidespan.streaming.coverage import stream_coverage, with_sentinels

SAM = "@HD\tVN:1.0\n@SQ\tSN:b\tLN:249\n@SQ\tSN:a\tLN:10\n" + "".join(
    f"{q}\t{f}\t{r}\t{p}\t{m}\t{c}\t=\t{mp}\t{i}\t{s}\t{'I' * len(s)}\tNM:i:0\n"
    for q, f, r, p, m, c, mp, i, s in [("r1", 99, "b", 1, 60, "4M", 204, 249, "ACGT"), ("r1", 147, "b", 204, 60, "2S10M5D1I", 1, -249, "ACGTACGTACGTA"), ("r2", 4, "*", 0, 0, "*", 0, 0, "NN")]
)


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_bed(spark, tmp_path):
    path = _write(tmp_path / "x.bed", "track x\n#c\n\nchr1\t0\t5\r\nchr1\t7\t9\tn\t0\t-\ta\tb\tc\td\nbad\t1\nchr1\tx\t2\nchr1\t9\t2\n")
    assert rows(R.read_regions(spark, path)) == [("chr1", 0, 5, "chr1:0-5"), ("chr1", 7, 9, "n")]
    assert [r["line"] for r in R.read_bed(spark, path, corrupt=True).collect()] == ["bad\t1", "chr1\tx\t2", "chr1\t9\t2"]
    assert rows(R.read_bed(spark, path).where("name = 'n'"), "strand") == [("-",)]


def test_annotations(spark, tmp_path):
    gff = _write(tmp_path / "x.gff3", "##gff-version 3\nc\ts\tCDS\t51\t221\t.\t+\t0\tParent=p;ID=one\nc\ts\tgene\t1\t9\t.\t+\t0\tID=g\nc\ts\tCDS\t60\t70\t.\t*\t0\tIDX=two\n##FASTA\nc\ts\tCDS\t1\t2\t.\t+\t0\tID=no\n")
    assert rows(R.read_regions(spark, gff)) == [("c", 50, 221, "one"), ("c", 59, 70, "c:59-70")]
    assert rows(R.read_gff(spark, gff, prefix=True), "name") == [("one",), ("two",)]
    assert R.read_gff(spark, gff, feature=None).count() == 3
    strict = {r["line"].split("\t")[8]: r["faults"] for r in R.read_gff_strict(spark, gff).collect()}
    assert strict == {"Parent=p;ID=one": [], "ID=g": [], "IDX=two": ["strand", "name"]}
    gtf = _write(tmp_path / "x.GTF", 'c\ts\texon\t1001\t2000\t.\t+\t.\ttranscript_id "t"; gene_id "f1";\n')
    assert rows(R.read_regions(spark, gtf, feature="exon", key="gene_id")) == [("c", 1000, 2000, "f1")]
    assert R.region_format("a.bed.gz") == "bed" and R.region_format("a.gff3") == "gff"
    for bad in (("a.gff.gtf", None), ("a", "vcf")):
        with pytest.raises(ValueError):
            R.region_format(*bad)


def test_other_texts(spark, tmp_path):
    assert rows(R.read_coverage_bed(spark, _write(tmp_path / "c.bed", "a\t0\t5\t2\na\t5\tx\t1\n"))) == [("a", 0, 5, 2)]
    assert rows(R.read_lengths(spark, _write(tmp_path / "l", "chr2 10\nchr1\t20\nx\n"))) == [(0, "chr2", 10), (1, "chr1", 20)]
    assert rows(R.read_fasta(spark, _write(tmp_path / "f.fa", ">a one\nAC\nGT\n>b\n\n>c\nA"))) == [("a", "one", "ACGT"), ("b", "", ""), ("c", "", "A")]
    assert rows(R.read_read_bed(spark, _write(tmp_path / "r.bed", "#x\nseq1 10\t50 -\nseq1\t900 1000\n"))) == [("seq1", 899, 1000, False), ("seq1", 9, 50, True)]


def test_sam(spark, tmp_path):
    path = _write(tmp_path / "smp.x.sam", SAM)
    refs = sam.read_sam_refs(spark, path)
    assert rows(refs) == [(0, "b", 249), (1, "a", 10)]
    found = sam.read_sam(spark, path)
    assert rows(found, "sample", "qname", "flag", "tid", "start", "stop", "mate_tid", "mate_pos", "isize")[:2] == [("smp", "r1", 147, 0, 203, 218, 0, 0, -249), ("smp", "r1", 99, 0, 0, 4, 0, 203, 249)]
    assert found.where("flag = 4").first()["tid"] is None
    sinks.write_lines(sinks.sam_lines(found, refs), str(tmp_path / "out"))
    again = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(x for x in again if x[0] != "@") == sorted(x.rsplit("\t", 1)[0].replace("0\t*\t=", "0\t*\t*") for x in SAM.splitlines() if x[0] != "@")
    spark.createDataFrame([(x,) for x in SAM.splitlines()], "value string").coalesce(1).write.text(str(tmp_path / "feed"))
    sam.stream_sam(spark, str(tmp_path / "feed"), refs).writeStream.format("memory").queryName("fed").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("fed"), "qname", "flag", "stop") == rows(found, "qname", "flag", "stop")
    assert next(iter(sinks.fastq_lines(found.where("flag = 99")).collect()))["value"] == "@r1/1\t0:203\nACGT\n+\nIIII"


def _bam(records, refs, block=400):
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", len(refs))
    for name, length in refs:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\x00" + struct.pack("<i", length)
    body = bytearray(head)
    for qname, flag, tid, pos, mapq, ops, seq in records:
        packed = bytes(("=ACMGRSVTWYHKDBN".index((seq + "=")[i]) << 4) | "=ACMGRSVTWYHKDBN".index((seq + "=")[i + 1]) for i in range(0, len(seq), 2))
        record = struct.pack("<iiBBHHHiiii", tid, pos, len(qname) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + qname.encode() + b"\x00"
        record += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops) + packed + bytes([30] * len(seq))
        body += struct.pack("<i", len(record)) + record
    out = b""
    for i in range(0, len(body) + block, block):
        raw = bytes(body[i : i + block])
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = c.compress(raw) + c.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(data) + 25) + data + struct.pack("<II", zlib.crc32(raw), len(raw))
    return out


@pytest.mark.parametrize("split", [1 << 20, 3000])
def test_bam(spark, tmp_path, split):
    made = [(f"read_{i}", 16 * (i % 2), i % 2, 5 * i, i % 61, [(3, "S"), (40 + i % 9, "M"), (2, "D")], "ACGTN" * 9) for i in range(700)]
    path = tmp_path / "smp.bam"
    path.write_bytes(_bam(made, [("b", 9000), ("a", 8000)]))
    sam.register_bam(spark)
    read = spark.read.format("bam").option("splitBytes", split)
    found = read.load(str(path))
    assert (found.rdd.getNumPartitions() > 1) == (split < 1 << 20)
    got = {r["qname"]: r for r in found.collect()}
    assert len(got) == found.count() == 700
    for qname, flag, tid, pos, mapq, ops, seq in made:
        r = got[qname]
        assert (r["sample"], r["flag"], r["tid"], r["start"], r["stop"], r["mapq"], r["seq"]) == ("smp", flag, tid, pos, pos + ops[1][0] + 2, mapq, seq)
    assert got["read_1"]["cigar"] == "3S41M2D" and got["read_1"]["qual"] == "?" * 45
    assert read.load(str(path)).where("tid = 1 and mapq >= 30").count() == sum(t == 1 and m >= 30 for _, _, t, _, m, _, _ in made)
    assert rows(sam.read_bam_refs(spark, str(path))) == [(0, "b", 9000), (1, "a", 8000)]
    with pytest.raises(NotImplementedError):
        sam.refuse_cram("x.cram")


def test_bam_round_trip(spark, tmp_path):
    made = [(f"q{i}", i % 4096, None if i % 9 == 0 else i % 2, i - 1, None, None if i % 7 == 0 else i % 250, "*" if i % 5 == 0 else f"{10 + i % 3}M{i % 4 + 1}I", None, -1, i - 300, "" if i % 6 == 0 else "ACGTN"[: i % 5 + 1], None if i % 4 == 0 else "IIIII"[: i % 5 + 1]) for i in range(600)]
    made = [(*m[:10], m[10] or "*", "*" if not m[10] else m[11]) for m in made] + [("long" * 60, 4, None, -1, None, 0, None, None, None, None, "ACGT" * 20_000, "5" * 80_000)]
    refs = spark.createDataFrame([(0, "b", 9000), (1, "a", 8000)], "tid int, name string, length bigint")
    reads = spark.createDataFrame(made, "qname string, flag int, tid int, start bigint, stop bigint, mapq int, cigar string, mate_tid int, mate_pos bigint, isize bigint, seq string, qual string").repartition(2, "qname")
    sam.write_bam(reads, refs, str(tmp_path / "out"))
    path = str(tmp_path / "out")
    found = {r["qname"]: r for r in sam.read_bam(spark, path).collect()}
    assert len(found) == len(made) and rows(sam.read_bam_refs(spark, path)) == [(0, "b", 9000), (1, "a", 8000)]
    for q, flag, tid, start, _, mapq, cigar, _, mate_pos, isize, seq, qual in made:
        r = found[q]
        whole = (flag, tid, start, 255 if mapq is None else mapq, cigar or "*", -1 if mate_pos is None else mate_pos, isize or 0, seq, qual or "*")
        assert tuple(r[c] for c in ("flag", "tid", "start", "mapq", "cigar", "mate_pos", "isize", "seq", "qual")) == whole
    slim = sam.read_bam(spark, path, ["tid", "start", "stop"])
    assert slim.columns == ["tid", "start", "stop"] and slim.where("tid = 1").count() == sum(m[2] == 1 for m in made)
    assert rows(spark.read.format("bam").option("splitBytes", 30_000).load(path), "qname", "seq") == rows(sam.read_bam(spark, path), "qname", "seq")
    sam.write_bam(reads.limit(0), refs, str(tmp_path / "none"))
    assert sam.read_bam(spark, str(tmp_path / "none")).count() == 0


def test_fasta_headers_and_random_bases(spark, tmp_path):
    path = _write(tmp_path / "x.fa", ">s1 map a>b note\nAC>GT\nAA\n\n>s2\r\nTT\r\n>empty\n")
    assert rows(R.read_fasta(spark, path)) == [("empty", "", ""), ("s1", "map a>b note", "AC>GTAA"), ("s2", "", "TT")]
    refs = spark.createDataFrame([(0, "z", 130), (1, "a", 0)], "tid int, name string, length bigint")
    lines = [r["value"] for r in sinks.fasta_lines(refs, seed=3).orderBy("o1", "o2").collect()]
    assert [len(x) for x in lines] == [2, 64, 64, 2, 2] and set("".join(lines[1:4])) == set("ACGT")
    other = [r["value"] for r in sinks.fasta_lines(refs, seed=4).orderBy("o1", "o2").collect()]
    assert other[1] != lines[1]


def test_numbers_follow_the_order(spark):
    data = spark.range(1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("x"))
    assert rows(numbered(data, ["x"]).where("x <> number")) == [] and numbered(data.limit(0), ["x"]).count() == 0


def test_benchmark_logs(spark, tmp_path):
    for name, text in (("mem.set1.tool.v2.txt", "elapsed time:\t4.5\npeak rss:\t190\n"), ("mem.set1.x.txt", "nothing"), ("other.txt", "elapsed time:\t1\n")):
        (tmp_path / name).write_text(text)
    runs = read_benchmarks(spark, str(tmp_path))
    assert rows(runs) == [("set1", "tool-v2", 4.5, 190), ("set1", "x", -1.0, -1)]
    assert rows(benchmark_matrix(runs, "seconds", ["x", "tool-v2", "none"])) == [("set1", -1.0, 4.5, None)]


def test_expressions(spark):
    row = spark.createDataFrame([("3S10M2D5I1N4=2X7H", "/a/b.c.bam", "I?#", 'gene_id "g x"; note "gene_id z"', 2.0 / 3)], "c string, p string, q string, a string, x double")
    got = row.select(reference_length(F.col("c")), query_length(F.col("c")), sample_name(F.col("p")), sample_name_long(F.col("p")), phred_values(F.col("q")), phred_text(phred_values(F.col("q"))), attribute(F.col("a"), "gene_id"), fixed(F.col("x"))).first()
    assert tuple(got) == (19, 24, "b", "bc", [40, 30, 2], "I?#", "g x", "0.667")
    assert size_in_bases("1.5k") == 1500 and size_in_bases("7") == 7


def test_flag_helpers(spark):
    row = spark.createDataFrame([(99,), (16,)], "f int")
    assert [tuple(r) for r in row.select(swap_strand(F.col("f")), flag_bits(F.col("f"))).collect()] == [(83, "000001100011"), (0, "000000010000")]


def test_lengths_and_rewriting(spark):
    lengths = spark.createDataFrame([(x,) for x in [2, 2, 2, 3, 3, 4, 8, 8, None]], "length bigint")
    assert tuple(length_stats(lengths).first()) == (8, 32, 8, 4)
    assert tuple(length_stats(lengths.where("length < 8")).first()) == (6, 16, 4, 3)
    big = spark.createDataFrame([(10**6 + i,) for i in range(101)], "length bigint")
    assert length_stats(big).first()["n50"] == 10**6 + 50
    assert tuple(length_stats(lengths.limit(0)).first()) == (0, None, None, None)
    named = lambda *n: spark.createDataFrame(list(enumerate(n)), "ord int, name string")
    assert rows(rename_references(spark.createDataFrame([("x",), ("z",)], "chrom string"), named("x", "y"), named("p", "q"))) == [("p",), ("z",)]
    reads = spark.createDataFrame([("r", "ACGT")], "qname string, seq string")
    assert rewrite_sequences(reads, "mask").first()["seq"] == "NNNN" and rewrite_sequences(reads, "erase").first()["seq"] == "*"
    assert sorted(rewrite_sequences(reads, "shuffle", rename=True).first()["seq"]) == list("ACGT")


def test_text_outputs(spark, tmp_path):
    refs = spark.createDataFrame([(0, "z", 10), (1, "a", 5)], "tid int, name string, length bigint")
    found = read_intervals(spark.createDataFrame([("s", 16, 0, 2, 4, 60, 0)], "sample string, flag int, tid int, start bigint, stop bigint, mapq int, isize bigint"), refs)
    runs = coverage(found, refs)

    def written(lines, name):
        sinks.write_lines(lines, str(tmp_path / name))
        return [r["value"] for r in spark.read.text(str(tmp_path / name)).orderBy("_metadata.file_path", F.monotonically_increasing_id()).collect()]

    assert written(sinks.bed_lines(runs, refs, ["cov"]), "bed") == ["z\t0\t2\t0", "z\t2\t4\t1", "z\t4\t10\t0", "a\t0\t5\t0"]
    spans = spark.createDataFrame([("s", 0, 0, 3), ("s", 0, 1, 1)], "sample string, tid int, span bigint, cov bigint")
    assert written(sinks.wig_lines(spans, refs, 5, ["cov"]), "wig") == ["fixedStep chrom=z start=1 step=5 span=5", "3", "1"]
    bound = spark.createDataFrame([(0, 0, 10, "r", "z")], "tid int, start bigint, stop bigint, name string, chrom string")
    totals = total_reads(spark.createDataFrame([("s",)] * 4, "sample string"))
    counts = region_counts(found, bound, samples=["s"], total_reads=totals)
    assert written(sinks.count_lines(counts, stranded=True, coords=True, rpkm=True, per_position=True, header=True), "counts") == ["#Feature\tChrom\tStarts\tStops\tForward\tReverse\tRPKM\tCounts/Length", "r\tz\t0\t10\t0\t1\t25000000.000\t0.100"]
    matrix = spark.createDataFrame([("z", 1, 2)], "name string, A bigint, B bigint")
    assert written(sinks.ref_count_lines(matrix, multiqc=True), "matrix") == [*sinks.MULTIQC, "ViralSequence\tA\tB", "z\t1\t2"]
    assert written(sinks.gtf_lines(bound), "gtf") == ['z\ttidespan\texon\t1\t10\t.\t+\t.\tgene_id "r"; transcript_id "r";']
    assert written(sinks.region_lines(bound), "regions") == ["z\t0\t10\tr"] and written(sinks.region_lines(bound, bound=True), "bound") == ["[0] 0 10 r"]
    assert written(sinks.fasta_lines(refs), "fa") == [">z", "N" * 10, ">a", "N" * 5]


def test_stream_equals_batch(spark, tmp_path):
    refs = spark.createDataFrame([(0, "x", 60), (1, "y", 9)], "tid int, name string, length bigint")
    data = [("s", 0, 0, a, b, 60, 0) for a, b in [(0, 5), (0, 5), (5, 9), (7, 20), (20, 30), (20, 22), (41, 60), (59, 70)]]
    found = read_intervals(spark.createDataFrame(data, "sample string, flag int, tid int, start bigint, stop bigint, mapq int, isize bigint"), refs)
    schema = "sample string, tid int, start bigint, stop bigint, length bigint"
    slim = found.select("sample", "tid", "start", "stop", "length")

    def run(batch, late="error"):
        batch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stream_coverage(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), late=late)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    for part in (slim.where("start < 5"), slim.where("start = 5"), slim.where("start > 5 and start <= 20"), slim.where("start > 20"), with_sentinels(slim.limit(0), refs, ["s"])):
        run(part)
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(coverage(found, refs, samples=["s"]), "sample", "tid", "start", "stop", "cov")
    with pytest.raises(Exception, match="went backwards"):
        run(slim.where("start = 5"))


def test_generators(spark):
    refs = spark.createDataFrame([(0, "x", 1000)], "tid int, name string, length bigint")
    reads = generate.random_reads(spark, 100_000, 3, shortest=100, longest=200, clones=2)
    assert 2.5 < reads.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] / 100_000 < 3.5
    assert reads.where("start < 0 or stop > 100000").count() == 0 and reads.exceptAll(generate.random_reads(spark, 100_000, 3, shortest=100, longest=200, clones=2)).count() == 0
    region = spark.createDataFrame([(0, 10, 40)], "tid int, start bigint, stop bigint")
    assert generate.targeted_reads(region, 20, size=10).where("start >= 10 and stop <= 40").count() == 20
    assert coverage(read_intervals(generate.tiling_reads(refs, 100), refs), refs).count() == 1
    assert generate.stacked_reads(spark, 1000, 3, 10).count() == 30
    assert rows(generate.flag_reads(spark, [4, 16]), "flag", "stop") == [(16, 116), (4, 14)]
    bed = spark.createDataFrame([("q", 0, 5, True)], "chrom string, start bigint, stop bigint, reverse boolean")
    assert rows(generate.refs_from_reads(bed)) == [(0, "q", 105)]
    assert rows(generate.reads_from_bed(bed, generate.refs_from_reads(bed)), "flag", "cigar") == [(16, "5M")]
