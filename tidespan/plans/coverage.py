"""Queries of the coverage operators over the order tables read as alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidespan.durable import durable, scratch_folder
from tidespan.functions.alignments import has_flag, query_length, reference_length
from tidespan.functions.regions import attribute, default_name
from tidespan.operators.alignments import keep_fragments, keep_reads, read_intervals
from tidespan.operators.joins import interval_join
from tidespan.operators.lengths import length_stats, mean_depth_by_ref, whole_references
from tidespan.operators.multisample import antitarget, compare_counts, intersect_samples, mean_depths, sample_matrix, shared_low_coverage, wide_report
from tidespan.operators.spans import fill_spans, span_summary
from tidespan.operators.stats import clip_to_regions, count_refs, coverage_to_target, mapped_reads, ref_stats, region_counts, region_stats, total_reads
from tidespan.operators.sweep import coverage
from tidespan.options import InputOptions
from tidespan.plans.testdata import REF_LENGTH, SAMPLES, alignments, refs, regions, table
from tidespan.plans.testdata import SQL as TABLES
from tidespan.streaming.coverage import stream_coverage, with_sentinels

QUALITY = InputOptions(min_mapq=10)
SPAN = 5000
#: 2024-01-01 in microseconds since 1970, and the seconds of the event axis.
_EPOCH, _SECONDS = 1_704_067_200_000_000, 100_000_000
LOW = 3


def _intervals(spark: SparkSession, folder: str, options: InputOptions = QUALITY) -> DataFrame:
    return read_intervals(alignments(spark, folder), refs(spark, folder), options)


def _pooled(spark: SparkSession, folder: str, options: InputOptions = QUALITY) -> DataFrame:
    """All samples as one."""
    return _intervals(spark, folder, options).withColumn("sample", F.lit("all"))


def _runs(spark: SparkSession, folder: str, options: InputOptions = QUALITY, **how) -> DataFrame:
    return coverage(_pooled(spark, folder, options), refs(spark, folder), samples=["all"], **how)


def _sample_runs(spark: SparkSession, folder: str) -> DataFrame:
    return coverage(_intervals(spark, folder), refs(spark, folder), samples=SAMPLES)


def coverage_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).select("tid", "start", "stop", "cov")


def coverage_tiled(spark: SparkSession, folder: str) -> DataFrame:
    """The same with references cut into tiles."""
    return _runs(spark, folder, tile=1 << 14).select("tid", "start", "stop", "cov")


def coverage_stranded(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder, stranded=True).select("tid", "start", "stop", "fwd", "rev")


def coverage_quantized(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder, bands="2,4").select("tid", "start", "stop", "band")


def coverage_physical(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder, InputOptions(min_mapq=10, physical=True)).select("tid", "start", "stop", "cov")


def coverage_extended(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder, InputOptions(min_mapq=10, fragment_length=500)).select("tid", "start", "stop", "cov")


def coverage_samples(spark: SparkSession, folder: str) -> DataFrame:
    return _sample_runs(spark, folder).select("sample", "tid", "start", "stop", "cov")


def coverage_in_regions(spark: SparkSession, folder: str) -> DataFrame:
    return clip_to_regions(_runs(spark, folder), regions(spark, folder)).select("tid", "start", "stop", "cov", "name")


def region_stats_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return region_stats(_runs(spark, folder), regions(spark, folder), samples=["all"]).drop("sample")


def region_stats_pooled_low(spark: SparkSession, folder: str) -> DataFrame:
    return region_stats(_runs(spark, folder), regions(spark, folder, pooled=True), samples=["all"], low=LOW).drop("sample")


def region_stats_stranded(spark: SparkSession, folder: str) -> DataFrame:
    return region_stats(_runs(spark, folder, stranded=True), regions(spark, folder, pooled=True), samples=["all"], stranded=True).drop("sample")


def reference_stats(spark: SparkSession, folder: str) -> DataFrame:
    return ref_stats(_sample_runs(spark, folder), refs(spark, folder), low=LOW)


def _spans(op: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        known = refs(spark, folder)
        found = span_summary(_runs(spark, folder), known, SPAN, op)
        return fill_spans(found, known, SPAN, ["all"]).drop("sample", "span")

    query.__name__ = f"span_{op}"
    return query


def span_mean_partial(spark: SparkSession, folder: str) -> DataFrame:
    known = refs(spark, folder)
    return fill_spans(span_summary(_runs(spark, folder), known, 7000, "mean"), known, 7000, ["all"]).drop("sample", "span")


_COUNTED = ["name", "fwd", "rev", "counts"]


def _counts(spark: SparkSession, folder: str, reads: DataFrame | None = None, *, pooled: bool = True, **how) -> DataFrame:
    known = refs(spark, folder)
    found = read_intervals(reads if reads is not None else alignments(spark, folder), known, QUALITY).withColumn("sample", F.lit("all"))
    bound = regions(spark, folder, pooled=pooled).join(known.select("tid", F.col("name").alias("chrom")), "tid")
    return region_counts(found, bound, samples=["all"], **how)


def region_counts_stranded(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder, pooled=False).select(*_COUNTED)


def region_counts_strict(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder, strict=True).select(*_COUNTED)


def region_counts_compat(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder, compat=True).select(*_COUNTED)


def region_counts_paired(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder, keep_fragments(alignments(spark, folder))).select(*_COUNTED)


def region_coords(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder).select("name", "counts", "chrom", "starts", "stops", "length")


def region_rpkm(spark: SparkSession, folder: str) -> DataFrame:
    totals = total_reads(alignments(spark, folder).withColumn("sample", F.lit("all")))
    return _counts(spark, folder, total_reads=totals).select("name", "counts", "rpkm", "per_position")


def sample_counts_matrix(spark: SparkSession, folder: str) -> DataFrame:
    known = refs(spark, folder)
    bound = regions(spark, folder, pooled=True).join(known.select("tid", F.col("name").alias("chrom")), "tid")
    counts = region_counts(_intervals(spark, folder), bound, samples=SAMPLES)
    return sample_matrix(counts, "name", "counts", SAMPLES)


def ref_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_refs(keep_reads(alignments(spark, folder), QUALITY), refs(spark, folder), SAMPLES).select("sample", "tid", "name", "counts")


def ref_counts_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return sample_matrix(ref_counts(spark, folder), "name", "counts", SAMPLES)


def ref_cpm(spark: SparkSession, folder: str) -> DataFrame:
    reads = alignments(spark, folder)
    return count_refs(keep_reads(reads, QUALITY), refs(spark, folder), SAMPLES, mapped=mapped_reads(reads)).select("sample", "name", "cpm")


def report_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return wide_report(region_stats(_sample_runs(spark, folder), regions(spark, folder, pooled=True), samples=SAMPLES), SAMPLES)


def mean_matrix_total(spark: SparkSession, folder: str) -> DataFrame:
    return mean_depths(_sample_runs(spark, folder), refs(spark, folder), SAMPLES, total=True)


def mean_by_reference(spark: SparkSession, folder: str) -> DataFrame:
    return mean_depth_by_ref(_sample_runs(spark, folder), refs(spark, folder))


def shared_low(spark: SparkSession, folder: str) -> DataFrame:
    return shared_low_coverage(_sample_runs(spark, folder), refs(spark, folder), 0, 1, len(SAMPLES), 1.0)


def shared_by_two(spark: SparkSession, folder: str) -> DataFrame:
    return intersect_samples(_intervals(spark, folder), refs(spark, folder), 2)


def antitarget_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return antitarget(regions(spark, folder), refs(spark, folder))


def target_bases(spark: SparkSession, folder: str) -> DataFrame:
    return coverage_to_target(_runs(spark, folder).drop("sample"), regions(spark, folder, pooled=True), normalise=True)


def reads_in_target(spark: SparkSession, folder: str) -> DataFrame:
    """Reads of each reference that meet a region."""
    reads = _pooled(spark, folder).select("tid", "start", "stop", "reverse")
    return interval_join(reads, regions(spark, folder), ["tid"], how="semi").groupBy("tid").agg(F.count(F.lit(1)).alias("n"))


def regions_from_attributes(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    key = F.col("p_partkey").cast("string")
    gff = F.concat(F.lit("Parent=x"), key, F.lit(";ID=part_"), key, F.lit(";Name="), "p_name")
    gtf = F.concat(F.lit('transcript_id "t'), key, F.lit('"; gene_id "'), "p_name", F.lit('";'))
    start = (F.col("p_partkey") * 7919 % 250000).cast("bigint")
    return part.select(
        F.col("p_partkey").cast("bigint").alias("p_partkey"),
        attribute(gff, "ID").alias("gff_name"),
        attribute(gtf, "gene_id").alias("gtf_name"),
        default_name(attribute(gff, "locus_tag"), F.concat(F.lit("chr"), (F.col("p_partkey") % 25).cast("string")), start, start + 200).alias("made_name"),
    )


def n50_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return length_stats(_pooled(spark, folder).select((F.col("stop") - F.col("start")).alias("length")))


def cigar_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths by CIGAR of the alignments table against its own bounds."""
    rows = table(spark, folder, "alignments")
    return rows.select("aln_id", reference_length(F.col("cigar")).alias("reference_length"), query_length(F.col("cigar")).alias("query_length")).distinct()


def flag_profile(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "alignments")
    bits = {"paired": 1, "proper": 2, "unmapped": 4, "reverse": 16, "read1": 64, "read2": 128, "secondary": 256, "failed": 512, "duplicate": 1024}
    return rows.groupBy("sample").agg(*(F.sum(F.when(has_flag(F.col("flag"), b), 1).otherwise(0)).alias(k) for k, b in bits.items()))


def alignment_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Depth of the alignments table itself, per sample over every reference."""
    known = table(spark, folder, "refs")
    rows = table(spark, folder, "alignments").withColumnRenamed("chrom", "tid")
    found = read_intervals(rows.dropDuplicates(["aln_id"]).select("sample", "flag", "tid", "start", "stop", "mapq", "isize"), known)
    return coverage(found.withColumn("sample", F.lit("all")), known, samples=["all"]).select("tid", "start", "stop", "cov")


def alignment_region_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Reads of the alignments table on each region of the regions table, by region id."""
    known = table(spark, folder, "refs")
    rows = table(spark, folder, "alignments").withColumnRenamed("chrom", "tid")
    found = read_intervals(rows.dropDuplicates(["aln_id"]).select("sample", "flag", "tid", "start", "stop", "mapq", "isize"), known)
    target = table(spark, folder, "regions").where("start < stop").join(known.select("tid", F.col("name").alias("chrom")), "chrom").select("region_id", "tid", "start", "stop").distinct()
    pairs = interval_join(found.select("tid", "start", "stop"), target, ["tid"])
    return pairs.groupBy("region_id").agg(F.count(F.lit(1)).alias("counts"))


def compare_sample_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = ref_counts(spark, folder)
    return compare_counts(counts.where("sample = 'A'"), counts.where("sample = 'R'"), "name", "counts")


def whole_reference_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics with each reference as a region."""
    known = refs(spark, folder)
    return region_stats(_runs(spark, folder), whole_references(known), samples=["all"]).drop("sample")


def streamed_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """``coverage_runs`` by the stateful streaming operator, in batches of the order of start."""
    known = refs(spark, folder)
    reads = durable(_pooled(spark, folder).select("sample", "tid", "start", "stop", "length"))
    base = scratch_folder(spark, "stream")
    schema = "sample string, tid int, start bigint, stop bigint, length bigint"
    bounds = [0, REF_LENGTH // 3, 2 * REF_LENGTH // 3, REF_LENGTH]
    batches = [reads.where(F.col("start").between(a, b - 1)) for a, b in zip(bounds, bounds[1:])]
    batches.append(with_sentinels(reads.limit(0), known, ["all"]))
    for batch in batches:
        # each run of the query takes what came next in order; its state lives on in its checkpoint
        batch.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        query = stream_coverage(stream).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema("sample string, tid int, start bigint, stop bigint, cov bigint").parquet(f"{base}/out").select("tid", "start", "stop", "cov")


def events_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Events in progress at every second, per type: each lasts as many seconds as its value."""
    events = table(spark, folder, "events")
    start = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - _EPOCH) / 1_000_000)
    known = spark.createDataFrame([(0, "time", _SECONDS)], "tid int, name string, length bigint")
    rows = events.select(F.col("event_type").alias("sample"), F.lit(0).alias("flag"), F.lit(0).alias("tid"), start.alias("start"), (start + 1 + F.floor("value")).alias("stop"), F.lit(60).alias("mapq"), F.lit(0).cast("bigint").alias("isize"))
    return coverage(read_intervals(rows, known), known).select("sample", "start", "stop", "cov")


def events_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Tumbling windows of an hour over event time, as a stream would give them."""
    events = table(spark, folder, "events")
    grouped = events.groupBy("event_type", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("largest"))
    return grouped.select("event_type", F.col("window.start").cast("string").alias("hour"), "n", "largest")


QUERIES = {
    f.__name__: f
    for f in (
        coverage_runs, coverage_tiled, coverage_stranded, coverage_quantized, coverage_physical, coverage_extended, coverage_samples, coverage_in_regions,
        region_stats_by_name, region_stats_pooled_low, region_stats_stranded, reference_stats, whole_reference_stats, _spans("max"), _spans("min"), _spans("mean"), span_mean_partial,
        region_counts_stranded, region_counts_strict, region_counts_compat, region_counts_paired, region_coords, region_rpkm, sample_counts_matrix,
        ref_counts, ref_counts_matrix, ref_cpm, report_matrix, mean_matrix_total, mean_by_reference, shared_low, shared_by_two, antitarget_gaps, target_bases, reads_in_target,
        regions_from_attributes, n50_lengths, cigar_lengths, flag_profile, alignment_runs, alignment_region_counts, compare_sample_counts, events_coverage, events_hourly, streamed_coverage,
    )
}


def _kept(where: str = "true", start: str = "start", stop: str = "stop") -> str:
    """The intervals that count, clamped to their reference."""
    return f"""kept AS (SELECT a.sample, a.tid, {start} AS start, least({stop}, r.length) AS stop, a.flag & 16 <> 0 AS reverse FROM aln a JOIN refs r USING (tid)
  WHERE a.flag & 1796 = 0 AND a.mapq >= 10 AND {where} AND {start} < least({stop}, r.length))"""


def _sweep(sample: str, source: str = "kept", keep: str = "d <> 0", samples: str = "SELECT 'all' AS sample") -> str:
    """Runs of depth by running sums, with every reference of every sample from 0."""
    return f"""ev AS (SELECT {sample} AS sample, tid, start AS pos, CASE WHEN reverse THEN 0 ELSE 1 END AS df, CASE WHEN reverse THEN 1 ELSE 0 END AS dr FROM {source}
  UNION ALL SELECT {sample}, tid, stop, CASE WHEN reverse THEN 0 ELSE -1 END, CASE WHEN reverse THEN -1 ELSE 0 END FROM {source}
  UNION ALL SELECT s.sample, r.tid, 0, 0, 0 FROM refs r, ({samples}) s),
net AS (SELECT sample, tid, pos, sum(df) AS df, sum(dr) AS dr, sum(df + dr) AS d FROM ev GROUP BY ALL HAVING pos < 300000),
chg AS (SELECT * FROM net WHERE pos = 0 OR {keep}),
runs AS (SELECT sample, tid, pos AS start, lead(pos, 1, 300000) OVER w AS stop, CAST(sum(df) OVER w AS BIGINT) AS fwd, CAST(sum(dr) OVER w AS BIGINT) AS rev, CAST(sum(d) OVER w AS BIGINT) AS cov
  FROM chg WINDOW w AS (PARTITION BY sample, tid ORDER BY pos))"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join((TABLES, *parts)) + "\n"


_ALL, _EACH = _sweep("'all'"), _sweep("sample", samples="SELECT unnest(['A', 'N', 'R']) AS sample")
_RUNS = _with(_kept(), _ALL) + "SELECT tid, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, cov FROM runs"


def _pieces(name: str) -> str:
    return f"pc AS (SELECT u.sample, g.{name} AS name, u.tid, greatest(u.start, g.start) AS start, least(u.stop, g.stop) AS stop, u.cov, u.fwd, u.rev FROM runs u JOIN reg g ON u.tid = g.tid AND u.start < g.stop AND g.start < u.stop)"


_STAT = {
    c: f"CAST(sum({e} * (stop - start)) AS BIGINT) AS bases{x}, CAST(sum({e} * (stop - start)) AS DOUBLE) / CAST(sum(stop - start) AS DOUBLE) AS mean{x}, min({e}) AS min{x}, max({e}) AS max{x}"
    for c, e, x in (("cov", "cov", ""), ("fwd", "fwd", "_forward"), ("rev", "rev", "_reverse"))
}
_LENGTH = "CAST(sum(stop - start) AS BIGINT) AS length"
_LOWER = f"CAST(sum(CASE WHEN cov < {LOW} THEN stop - start ELSE 0 END) AS BIGINT) AS low"


def _span_sql(op: str, span: int) -> str:
    value = {"max": "max(cov)", "min": "min(cov)", "mean": f"CAST(sum(cov * (least(stop, (k + 1) * {span}) - greatest(start, k * {span}))) AS DOUBLE) / {span}.0"}[op]
    return _with(_kept(), _ALL) + f"""SELECT tid, CAST(k * {span} AS BIGINT) AS start, CAST(least((k + 1) * {span}, 300000) AS BIGINT) AS stop, {value} AS cov
FROM (SELECT *, unnest(generate_series(start // {span}, (stop - 1) // {span})) AS k FROM runs) GROUP BY tid, k"""


def _count_sql(name: str = "pooled", where: str = "true", meets: str = "k.start < g.stop AND g.start < k.stop") -> str:
    return _with(
        _kept(where),
        f"hit AS (SELECT g.{name} AS name, k.reverse FROM kept k JOIN reg g ON k.tid = g.tid AND {meets})",
        f"co AS (SELECT n.name, CAST(count(*) FILTER (WHERE NOT reverse) AS BIGINT) AS fwd, CAST(count(*) FILTER (WHERE reverse) AS BIGINT) AS rev, CAST(count(reverse) AS BIGINT) AS counts FROM (SELECT DISTINCT {name} AS name FROM reg) n LEFT JOIN hit USING (name) GROUP BY n.name)",
    )


_COMPAT = "((k.start > g.start AND k.start < g.stop) OR (k.stop > g.start AND k.stop < g.stop) OR (k.start < g.start AND k.stop > g.stop))"
_REFCO = "rc AS (SELECT s.sample, r.tid, r.name, CAST(count(k.tid) AS BIGINT) AS counts FROM refs r CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS sample) s LEFT JOIN (SELECT * FROM aln WHERE flag & 1796 = 0 AND mapq >= 10) k ON k.tid = r.tid AND k.sample = s.sample GROUP BY ALL)"


def _per_sample(value: str) -> str:
    return ", ".join(f"{value.format(s=s)} AS \"{s}\"" for s in SAMPLES)


_OWN = """kn AS (SELECT DISTINCT aln_id, chrom AS tid, start, least(stop, r.length) AS stop, flag & 16 <> 0 AS reverse FROM alignments a JOIN refs r ON a.chrom = r.tid
  WHERE flag & 1796 = 0 AND chrom >= 0 AND start IS NOT NULL AND stop IS NOT NULL AND start < least(stop, r.length))"""

SQL = {
    "coverage_runs": _RUNS,
    "coverage_tiled": _RUNS,
    "streamed_coverage": _RUNS,
    "coverage_stranded": _with(_kept(), _sweep("'all'", keep="df <> 0 OR dr <> 0")) + "SELECT tid, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, fwd, rev FROM runs",
    "coverage_quantized": _with(
        _kept(),
        _ALL,
        "lab AS (SELECT *, CASE WHEN cov >= 4 THEN '4-' WHEN cov >= 2 THEN '2-3' ELSE '0-1' END AS band FROM runs)",
        "isl AS (SELECT *, CASE WHEN band IS DISTINCT FROM lag(band) OVER (PARTITION BY tid ORDER BY start) THEN 1 ELSE 0 END AS fresh FROM lab)",
        "num AS (SELECT *, sum(fresh) OVER (PARTITION BY tid ORDER BY start) AS island FROM isl)",
    )
    + "SELECT tid, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop, any_value(band) AS band FROM num GROUP BY tid, island",
    "coverage_physical": _with(_kept("a.isize > 0", stop="a.start + a.isize"), _ALL) + "SELECT tid, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, cov FROM runs",
    "coverage_extended": _with(_kept(stop="a.start + 500"), _ALL) + "SELECT tid, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, cov FROM runs",
    "coverage_samples": _with(_kept(), _EACH) + "SELECT sample, tid, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, cov FROM runs",
    "coverage_in_regions": _with(_kept(), _ALL, _pieces("name")) + "SELECT tid, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, cov, name FROM pc",
    "region_stats_by_name": _with(_kept(), _ALL, _pieces("name")) + f"SELECT name, {_STAT['cov']}, {_LENGTH} FROM pc GROUP BY name",
    "region_stats_pooled_low": _with(_kept(), _ALL, _pieces("pooled")) + f"SELECT name, {_STAT['cov']}, {_LOWER}, {_LENGTH} FROM pc GROUP BY name",
    "region_stats_stranded": _with(_kept(), _sweep("'all'", keep="df <> 0 OR dr <> 0"), _pieces("pooled")) + f"SELECT name, {_STAT['cov']}, {_STAT['fwd']}, {_STAT['rev']}, {_LENGTH} FROM pc GROUP BY name",
    "reference_stats": _with(_kept(), _EACH) + f"SELECT sample, name, {_STAT['cov']}, {_LOWER}, {_LENGTH} FROM runs JOIN refs USING (tid) GROUP BY sample, name",
    "whole_reference_stats": _with(_kept(), _ALL) + f"SELECT name, {_STAT['cov']}, {_LENGTH} FROM runs JOIN refs USING (tid) GROUP BY name",
    "span_max": _span_sql("max", SPAN),
    "span_min": _span_sql("min", SPAN),
    "span_mean": _span_sql("mean", SPAN),
    "span_mean_partial": _span_sql("mean", 7000),
    "region_counts_stranded": _count_sql("name") + "SELECT * FROM co",
    "region_counts_strict": _count_sql(meets="g.start <= k.start AND k.stop <= g.stop") + "SELECT * FROM co",
    "region_counts_compat": _count_sql(meets=_COMPAT) + "SELECT * FROM co",
    "region_counts_paired": _count_sql(where="a.flag & 2 <> 0 AND a.flag & 128 = 0") + "SELECT * FROM co",
    "region_coords": _count_sql()
    + """SELECT co.name, counts, chrom, starts, stops, length FROM co JOIN (SELECT pooled AS name, string_agg(r.name, ';' ORDER BY g.tid, g.start, g.stop) AS chrom, string_agg(CAST(g.start AS VARCHAR), ';' ORDER BY g.tid, g.start, g.stop) AS starts,
  string_agg(CAST(g.stop AS VARCHAR), ';' ORDER BY g.tid, g.start, g.stop) AS stops, CAST(sum(g.stop - g.start) AS BIGINT) AS length FROM reg g JOIN refs r USING (tid) GROUP BY pooled) c USING (name)""",
    "region_rpkm": _count_sql()
    + """SELECT co.name, counts, CAST(counts AS DOUBLE) / ((SELECT count(*) FROM aln) / CAST(1e6 AS DOUBLE)) / (length / CAST(1e3 AS DOUBLE)) AS rpkm, CAST(counts AS DOUBLE) / CAST(length AS DOUBLE) AS per_position
FROM co JOIN (SELECT pooled AS name, sum(stop - start) AS length FROM reg GROUP BY pooled) c USING (name)""",
    "sample_counts_matrix": _with(_kept(), "hit AS (SELECT g.pooled AS name, k.sample FROM kept k JOIN reg g ON k.tid = g.tid AND k.start < g.stop AND g.start < k.stop)")
    + f"SELECT n.name, {_per_sample("CAST(count(*) FILTER (WHERE sample = '{s}') AS BIGINT)")} FROM (SELECT DISTINCT pooled AS name FROM reg) n LEFT JOIN hit USING (name) GROUP BY n.name",
    "ref_counts": _with(_REFCO) + "SELECT * FROM rc",
    "ref_counts_matrix": _with(_REFCO) + f"SELECT name, {_per_sample("CAST(sum(counts) FILTER (WHERE sample = '{s}') AS BIGINT)")} FROM rc GROUP BY name",
    "ref_cpm": _with(_REFCO, "mp AS (SELECT sample, count(*) AS total FROM aln WHERE flag & 4 = 0 GROUP BY sample)") + "SELECT rc.sample, name, CAST(counts AS DOUBLE) / (total / CAST(1e6 AS DOUBLE)) AS cpm FROM rc LEFT JOIN mp USING (sample)",
    "report_matrix": _with(_kept(), _EACH, _pieces("pooled"), f"st AS (SELECT sample, name, {_STAT['cov']}, {_LENGTH} FROM pc GROUP BY sample, name)")
    + "SELECT name, " + ", ".join(f"max({m}) FILTER (WHERE sample = '{s}') AS \"{s}_{m}\"" for s in SAMPLES for m in ("bases", "mean", "min", "max")) + ", max(length) AS length FROM st GROUP BY name",
    "mean_matrix_total": _with(_kept(), _EACH)
    + "SELECT coalesce(name, '#Total') AS name, " + ", ".join(f"CAST(sum(cov * (stop - start)) FILTER (WHERE sample = '{s}') AS DOUBLE) / CAST(sum(stop - start) FILTER (WHERE sample = '{s}') AS DOUBLE) AS \"{s}\"" for s in SAMPLES)
    + " FROM runs JOIN refs USING (tid) GROUP BY ROLLUP (name)",
    "mean_by_reference": _with(_kept(), _EACH) + f"SELECT sample, name, {_LENGTH}, CAST(sum(cov * (stop - start)) AS DOUBLE) / CAST(sum(stop - start) AS DOUBLE) AS mean FROM runs JOIN refs USING (tid) GROUP BY sample, name",
    "shared_low": _with(
        _kept(), _EACH,
        "lo AS (SELECT tid, start, stop FROM runs WHERE cov <= 1)",
        "le AS (SELECT tid, start AS pos, 1 AS d FROM lo UNION ALL SELECT tid, stop, -1 FROM lo)",
        "ln AS (SELECT tid, pos, sum(d) AS d FROM le GROUP BY ALL HAVING sum(d) <> 0)",
        "lr AS (SELECT tid, pos AS start, lead(pos) OVER w AS stop, sum(d) OVER w AS n FROM ln WINDOW w AS (PARTITION BY tid ORDER BY pos))",
    )
    + "SELECT tid, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CAST(n AS BIGINT) AS n FROM lr WHERE n >= 3",
    "shared_by_two": _with(
        _kept(), _EACH,
        "hv AS (SELECT sample, tid, start, stop FROM runs WHERE cov > 0)",
        "le AS (SELECT tid, start AS pos, 1 AS d FROM hv UNION ALL SELECT tid, stop, -1 FROM hv)",
        "ln AS (SELECT tid, pos, sum(d) AS d FROM le GROUP BY ALL HAVING sum(d) <> 0)",
        "lr AS (SELECT tid, pos AS start, lead(pos) OVER w AS stop, sum(d) OVER w AS n FROM ln WINDOW w AS (PARTITION BY tid ORDER BY pos))",
    )
    + "SELECT tid, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CAST(n AS BIGINT) AS n FROM lr WHERE n >= 2",
    "antitarget_gaps": _with(
        "mx AS (SELECT tid, start, stop, max(stop) OVER (PARTITION BY tid ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT tid, start, stop FROM reg UNION ALL SELECT tid, length, length FROM refs))",
    )
    + "SELECT tid, CAST(coalesce(reach, 0) AS BIGINT) AS start, CAST(start AS BIGINT) AS stop FROM mx WHERE coalesce(reach, 0) < start",
    "target_bases": _with(_kept(), _ALL)
    + """SELECT g.pooled AS name, CAST(sum(u.cov * (least(u.stop, g.stop) - greatest(u.start, g.start))) AS BIGINT) AS bases, any_value(l.length) AS length,
  CAST(sum(u.cov * (least(u.stop, g.stop) - greatest(u.start, g.start))) AS DOUBLE) / CAST(any_value(l.length) AS DOUBLE) AS per_position
FROM runs u JOIN reg g ON u.tid = g.tid AND u.start < g.stop AND g.start < u.stop JOIN (SELECT pooled, CAST(sum(stop - start) AS BIGINT) AS length FROM reg GROUP BY pooled) l ON l.pooled = g.pooled GROUP BY g.pooled""",
    "reads_in_target": _with(_kept()) + "SELECT tid, count(*) AS n FROM kept k WHERE EXISTS (SELECT 1 FROM reg g WHERE g.tid = k.tid AND k.start < g.stop AND g.start < k.stop) GROUP BY tid",
    "regions_from_attributes": "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, 'part_' || p_partkey AS gff_name, p_name AS gtf_name, 'chr' || p_partkey % 25 || ':' || p_partkey * 7919 % 250000 || '-' || (p_partkey * 7919 % 250000 + 200) AS made_name FROM part",
    "n50_lengths": _with(_kept(), "h AS (SELECT stop - start AS length, count(*) AS n FROM kept GROUP BY 1)", "c AS (SELECT *, sum(length * n) OVER (ORDER BY length DESC) AS cum, sum(length * n) OVER () AS total FROM h)")
    + "SELECT CAST(sum(n) AS BIGINT) AS n, CAST(any_value(total) AS BIGINT) AS total, max(length) AS longest, max(length) FILTER (WHERE 2 * cum > total) AS n50 FROM c",
    "cigar_lengths": """SELECT DISTINCT aln_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT))), CASE WHEN cigar IS NOT NULL THEN 0 END) AS BIGINT) AS reference_length,
  CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MIS=X]', 1), lambda x: CAST(x AS BIGINT))), CASE WHEN cigar IS NOT NULL THEN 0 END) AS BIGINT) AS query_length FROM alignments""",
    "flag_profile": "SELECT sample, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN flag & {b} <> 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS {k}" for k, b in {"paired": 1, "proper": 2, "unmapped": 4, "reverse": 16, "read1": 64, "read2": 128, "secondary": 256, "failed": 512, "duplicate": 1024}.items()) + " FROM alignments GROUP BY sample",
    "alignment_runs": f"""WITH {_OWN},
net AS (SELECT tid, pos, sum(d) AS d FROM (SELECT tid, greatest(start, 0) AS pos, 1 AS d FROM kn UNION ALL SELECT tid, stop, -1 FROM kn UNION ALL SELECT tid, 0, 0 FROM refs) GROUP BY ALL),
chg AS (SELECT n.*, length FROM net n JOIN refs USING (tid) WHERE pos < length AND (pos = 0 OR d <> 0))
SELECT tid, CAST(pos AS BIGINT) AS start, CAST(coalesce(lead(pos) OVER w, length) AS BIGINT) AS stop, CAST(sum(d) OVER w AS BIGINT) AS cov FROM chg WINDOW w AS (PARTITION BY tid ORDER BY pos)""",
    "alignment_region_counts": f"""WITH {_OWN},
tg AS (SELECT DISTINCT region_id, r.tid, start, stop FROM regions g JOIN refs r ON g.chrom = r.name WHERE start < stop)
SELECT region_id, count(*) AS counts FROM tg JOIN kn ON kn.tid = tg.tid AND kn.start < tg.stop AND tg.start < kn.stop GROUP BY region_id""",
    "events_coverage": """WITH iv AS (SELECT event_type AS sample, greatest(s, 0) AS start, least(s + 1 + CAST(floor(value) AS BIGINT), 100000000) AS stop FROM (SELECT *, CAST(floor((epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE) AS BIGINT) AS s FROM events)),
net AS (SELECT sample, pos, sum(d) AS d FROM (SELECT sample, start AS pos, 1 AS d FROM iv WHERE start < stop UNION ALL SELECT sample, stop, -1 FROM iv WHERE start < stop UNION ALL SELECT DISTINCT sample, 0, 0 FROM iv WHERE start < stop) GROUP BY ALL),
chg AS (SELECT * FROM net WHERE pos < 100000000 AND (pos = 0 OR d <> 0))
SELECT sample, CAST(pos AS BIGINT) AS start, CAST(lead(pos, 1, 100000000) OVER w AS BIGINT) AS stop, CAST(sum(d) OVER w AS BIGINT) AS cov FROM chg WINDOW w AS (PARTITION BY sample ORDER BY pos)""",
    "events_hourly": "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n, max(value) AS largest FROM events GROUP BY ALL",
    "compare_sample_counts": _with(_REFCO)
    + "SELECT a.name, a.counts AS left_value, b.counts AS right_value, b.counts - a.counts AS delta, CASE WHEN a.counts <> 0 THEN 100.0::DOUBLE * (b.counts - a.counts) / a.counts END AS percent FROM rc a JOIN rc b USING (name) WHERE a.sample = 'A' AND b.sample = 'R'",
}
