"""Queries of column functions, generators and streaming operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidespan import generate
from tidespan.durable import durable, scratch_folder
from tidespan.functions.alignments import flag_bits, has_flag, is_reverse, phred_text, phred_values, sample_name, sample_name_long, swap_strand
from tidespan.functions.regions import Bands, attribute, fixed, overlap, per_million, per_position, rpkm, size_in_bases
from tidespan.operators.alignments import read_intervals
from tidespan.operators.joins import interval_join
from tidespan.operators.sweep import coverage
from tidespan.plans import coverage as order
from tidespan.plans import hygiene, testdata
from tidespan.plans.testdata import REF_LENGTH, table
from tidespan.streaming.coverage import stream_coverage, stream_spans, stream_to_regions, with_sentinels
from tidespan.streaming.periods import stream_periods

SPAN = 5000


# functions


def fixed_precision(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "coverage").where("forward IS NOT NULL").select("run_id", "sample", "tid", "start", (F.col("forward") / 8).alias("x"))
    return rows.select("run_id", "sample", "tid", "start", fixed(F.col("x"), 3).alias("text"))


def sample_names(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat(F.lit("/data/run.1/"), F.regexp_replace("file_name", "_", "."))
    return table(spark, folder, "region_files").select("file_no", sample_name(path).alias("short"), sample_name_long(path).alias("long"))


def phred_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Letters and digits of the names read as base qualities."""
    rows = table(spark, folder, "alignments").select("qname").distinct()
    values = phred_values(F.col("qname"))
    return rows.select("qname", F.array_join(F.transform(values, lambda q: q.cast("string")), ",").alias("qualities"), phred_text(values).alias("text"))


def flag_words(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.col("flag")
    return table(spark, folder, "alignments").select("flag").distinct().select("flag", flag_bits(flag).alias("bits"), swap_strand(flag).alias("swapped"), is_reverse(flag).alias("reverse"), has_flag(flag, 4 | 1024).alias("left_out"))


def depth_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Breaks in any order and more than once."""
    return table(spark, folder, "coverage").where("forward >= 0").groupBy(Bands("50,5,1,5").label(F.col("forward")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def normalised_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "fc").select(F.trim("geneid").alias("geneid"), "sample", "counts", "length").distinct()
    total = F.lit(2_000_000).cast("bigint")
    return rows.select("sample", "geneid", "counts", "length", rpkm(F.col("counts"), total, F.col("length")).alias("rpkm"), per_million(F.col("counts"), total).alias("cpm"), per_position(F.col("counts"), F.col("length")).alias("per_position"))


def feature_parts_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Positions that each region shares with the first 50,000 of its reference."""
    rows = table(spark, folder, "regions").where("start IS NOT NULL AND stop IS NOT NULL")
    return rows.select("region_id", "start", "stop", overlap(F.col("start"), F.col("stop"), F.lit(0).cast("bigint"), F.lit(50_000).cast("bigint")).alias("shared"))


def attribute_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Exact keys, keys by prefix, other separators, quotes and blanks."""
    part = table(spark, folder, "part")
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit('Note=a b; IDX=x'), key, F.lit('; ID = "'), "p_name", F.lit('" ;Empty='))
    piped = F.concat(F.lit("Name "), "p_name", F.lit("|ID=p"), key)
    found = [attribute(text, "Note"), attribute(text, "ID", prefix=True), attribute(text, "Empty"), attribute(piped, "ID", "|"), attribute(piped, "Name", "|"), attribute(piped, "Missing", "|")]
    return part.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), *(c.alias(n) for c, n in zip(found, ("note", "by_prefix", "empty", "piped", "blank_key", "missing"))))


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes with suffixes; the texts are the query's own."""
    texts = ["7", "1.5k", "2M", "3G", "1T", " 20K "]
    return spark.createDataFrame([(t, size_in_bases(t)) for t in texts], "text string, bases bigint")


# generators


def _known(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "refs")


_SHAPE = ["qname", "flag", "tid", "start", "stop", "mapq", "cigar"]


def _bed_reads(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "regions").where("chrom IS NOT NULL AND start < stop")
    return rows.select("chrom", "start", "stop", (F.col("region_id") % 2 == 0).alias("reverse"))


def generated_from_bed(spark: SparkSession, folder: str) -> DataFrame:
    """A read for each region, on references as long as the regions need."""
    reads = _bed_reads(spark, folder)
    known = generate.refs_from_reads(reads, least=100_000)
    found = generate.reads_from_bed(reads, known)
    return found.join(known.select("tid", "name", "length"), "tid").select("tid", "name", "length", "flag", "start", "stop", "mapq", "cigar")


def generated_random(spark: SparkSession, folder: str) -> DataFrame:
    """Random long reads to a depth of 20, with random CIGARs: how many there are, and whether all are as they should be."""
    length = 2_000_000
    reads = generate.random_reads(spark, length, 20, shortest=500, longest=1500, clones=2, cigars=True)
    size = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MIS=X]"), F.lit(1)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    span = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    fine = size.between(500, 1500) & (F.col("start") >= 0) & (F.col("stop") <= length) & (F.col("stop") - F.col("start") == F.least(span, length - F.col("start")))
    depth = F.sum(F.col("stop") - F.col("start")) / length
    return reads.agg(F.count(F.lit(1)).alias("n"), F.min(fine).alias("all_fine"), depth.between(18, 22).alias("depth_reached"), (F.count_distinct("cigar") > 1000).alias("many_cigars"), (F.count_distinct(F.regexp_replace("cigar", r"\d+", "")) == 5).alias("all_kinds"))


def generated_targeted(spark: SparkSession, folder: str) -> DataFrame:
    """Three reads within every region of the panels: reads per reference, all of them within one."""
    bound = interval_regions(spark, folder)
    reads = generate.targeted_reads(bound, 3, size=80)
    pairs = interval_join(reads.select("qname", "tid", "start", "stop"), bound.select("tid", "start", "stop"), ["tid"]).where("right_start <= start AND stop <= right_stop")
    per = reads.groupBy("tid").agg(F.count(F.lit(1)).alias("reads"), F.max(F.col("stop") - F.col("start")).alias("longest"))
    return per.join(pairs.groupBy("tid").agg(F.count_distinct("qname").alias("within")), "tid")


def interval_regions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "regions").where("start < stop").select("chrom", "start", "stop").distinct()
    return rows.join(_known(spark, folder).select("tid", F.col("name").alias("chrom")), "chrom").select("tid", "start", "stop")


def generated_stacks(spark: SparkSession, folder: str) -> DataFrame:
    """Stacks of reads with noise: reads, and whether each stack begins within it."""
    reads = generate.stacked_reads(spark, 5_000_000, 200, 50, size=150, noise=5)
    stack = F.expr("cast(substring(qname, 6) as bigint) div 50")
    per = reads.groupBy(stack.alias("stack")).agg(F.count(F.lit(1)).alias("reads"), ((F.max("start") - F.min("start") <= 5) & (F.min("start") >= 0) & (F.max("stop") <= 5_000_000)).alias("within_noise"))
    return per


def generated_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return generate.tiling_reads(testdata.refs(spark, folder), 700).select("tid", "start", "stop", "flag", "cigar")


def generated_flags(spark: SparkSession, folder: str) -> DataFrame:
    """A read for each flag of twelve bits; those of pairs only with the bit of a pair."""
    return generate.flag_reads(spark, [f for f in range(4096) if f % 2 or not f & 0xEE]).select(*_SHAPE)


def every_hundredth(spark: SparkSession, folder: str) -> DataFrame:
    """Each hundredth distinct region of the panels in the order of their ids, the sampling operator itself."""
    rows = table(spark, folder, "regions").select("region_id", "panel_id", "chrom", "start", "stop").distinct()
    return generate.every_nth(rows, 100, ["region_id"])


# streams


def _fed(spark: SparkSession, reads: DataFrame, known: DataFrame, samples: list[str], parts: int, base: str) -> list[DataFrame]:
    """Reads in ``parts`` slices of the axis, and the ends of the references last."""
    bounds = [REF_LENGTH * i // parts for i in range(parts + 1)]
    slices = [reads.where(F.col("start").between(a, b - 1)) for a, b in zip(bounds, bounds[1:])]
    return [*slices, with_sentinels(reads.limit(0), known, samples)]


_INTERVAL = "sample string, tid int, start bigint, stop bigint, length bigint"
_RUN = "sample string, tid int, start bigint, stop bigint, cov bigint"


def _streamed_runs(spark: SparkSession, folder: str, base: str, *, late: str = "error", again: Column | None = None) -> str:
    """Runs by the streaming operator over the order tables; ``again``: reads that come once more in the end, late."""
    known = testdata.refs(spark, folder)
    reads = durable(read_intervals(testdata.alignments(spark, folder), known).select("sample", "tid", "start", "stop", "length"))
    batches = _fed(spark, reads, known, testdata.SAMPLES, 6, base)
    if again is not None:
        batches.insert(-1, reads.where(again))
    for batch in batches:
        batch.write.mode("append").parquet(f"{base}/in")
        stream = stream_coverage(spark.readStream.schema(_INTERVAL).parquet(f"{base}/in"), late=late)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return f"{base}/out"


def streamed_late(spark: SparkSession, folder: str) -> DataFrame:
    """Per sample; reads that come too late are left out."""
    base = scratch_folder(spark, "stream")
    early = F.col("start") < REF_LENGTH // 10
    return spark.read.schema(_RUN).parquet(_streamed_runs(spark, folder, base, late="drop", again=early)).select("sample", "tid", "start", "stop", "cov")


def _completed(stream: DataFrame, base: str) -> DataFrame:
    """The last whole result of a streaming aggregation."""
    out = f"{base}/result"
    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/result-state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out)


def _runs_stream(spark: SparkSession, folder: str, base: str) -> DataFrame:
    known = testdata.refs(spark, folder)
    found = read_intervals(testdata.alignments(spark, folder), known).withColumn("sample", F.lit("all"))
    coverage(found, known, samples=["all"]).select("sample", "tid", "start", "stop", "cov").repartition(4).write.parquet(f"{base}/runs")
    return spark.readStream.schema(_RUN).option("maxFilesPerTrigger", 2).parquet(f"{base}/runs")


def _streamed_spans(op: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        """Spans of a stream of runs; those that lie past the last run aren't listed."""
        base = scratch_folder(spark, "stream")
        return _completed(stream_spans(_runs_stream(spark, folder, base), SPAN, op), base).select("tid", "span", "cov")

    query.__name__ = f"streamed_span_{op}"
    return query


def streamed_target(spark: SparkSession, folder: str) -> DataFrame:
    """Bases per region name of a stream of runs."""
    base = scratch_folder(spark, "stream")
    return _completed(stream_to_regions(_runs_stream(spark, folder, base), testdata.regions(spark, folder, pooled=True)), base)


def streamed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Tumbling windows of an hour over the events' own time, as a stream of files with a watermark."""
    base = scratch_folder(spark, "stream")
    events = table(spark, folder, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.repartition(4).write.parquet(f"{base}/events")
    stream = spark.readStream.schema("event_type string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{base}/events")
    grouped = stream.withWatermark("ts", "3650 days").groupBy("event_type", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("largest"))
    return _completed(grouped, base).select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "largest")


def p3_streamed(spark: SparkSession, folder: str) -> DataFrame:
    """Periods and gaps by keyed state over a stream of regions in three batches: what the batches' changes add up to."""
    base = scratch_folder(spark, "stream")
    rows = table(spark, folder, "regions").select("panel_id", "chrom", "start", "stop")
    rows.repartition(3).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("panel_id bigint, chrom string, start bigint, stop bigint").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    changes = stream_periods(stream, ["panel_id", "chrom"])
    changes.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("panel_id bigint, chrom string, kind string, start bigint, stop bigint, change int").parquet(f"{base}/out")
    return found.groupBy("panel_id", "chrom", "kind", "start", "stop").agg(F.sum("change").alias("change")).where("change <> 0").select("panel_id", "chrom", "kind", "start", "stop")


QUERIES = {
    f.__name__: f
    for f in (
        fixed_precision, sample_names, phred_round_trip, flag_words, depth_bands, normalised_counts, feature_parts_overlap, attribute_spellings, sizes,
        generated_from_bed, generated_random, generated_targeted, generated_stacks, generated_tiles, generated_flags, every_hundredth,
        streamed_late, _streamed_spans("max"), _streamed_spans("min"), _streamed_spans("mean"), streamed_target, streamed_windows, p3_streamed,
    )
}

_KEPT = """kept AS (SELECT a.sample, a.tid, greatest(start, 0) AS start, least(stop, r.length) AS stop, a.flag & 16 <> 0 AS reverse FROM aln a JOIN refs r USING (tid) WHERE a.flag & 1796 = 0 AND start < least(stop, r.length))"""
_ALL = order._with(_KEPT, order._sweep("'all'"))


def _span_sql(value: str) -> str:
    return _ALL + f"SELECT tid, CAST(k AS BIGINT) AS span, {value} AS cov FROM (SELECT *, unnest(generate_series(start // {SPAN}, (stop - 1) // {SPAN})) AS k FROM runs) GROUP BY tid, k"


SQL = {
    "fixed_precision": "SELECT run_id, sample, tid, start, printf('%.3f', CAST(forward AS DOUBLE) / 8) AS text FROM coverage WHERE forward IS NOT NULL",
    "sample_names": "SELECT file_no, string_split(replace(file_name, '_', '.'), '.')[1] AS short, array_to_string(string_split(replace(file_name, '_', '.'), '.')[:-2], '') AS long FROM region_files",
    "phred_round_trip": "SELECT DISTINCT qname, array_to_string(list_transform(string_split(qname, ''), lambda c: CAST(ascii(c) - 33 AS VARCHAR)), ',') AS qualities, qname AS text FROM alignments",
    "flag_words": "SELECT DISTINCT flag, lpad(bin(flag), 12, '0') AS bits, CASE WHEN flag & 1 <> 0 THEN xor(xor(flag, 16), 32) ELSE xor(flag, 16) END AS swapped, flag & 16 <> 0 AS reverse, flag & 1028 <> 0 AS left_out FROM alignments",
    "depth_bands": "SELECT CASE WHEN forward >= 50 THEN '50-' WHEN forward >= 5 THEN '5-49' WHEN forward >= 1 THEN '1-4' ELSE '0-0' END AS band, count(*) AS n FROM coverage WHERE forward >= 0 GROUP BY band",
    "normalised_counts": """SELECT DISTINCT sample, trim(geneid) AS geneid, counts, length, CAST(counts AS DOUBLE) / CAST(2 AS DOUBLE) / nullif(CAST(length AS DOUBLE) / CAST(1000 AS DOUBLE), 0) AS rpkm,
  CAST(counts AS DOUBLE) / CAST(2 AS DOUBLE) AS cpm, CAST(counts AS DOUBLE) / nullif(CAST(length AS DOUBLE), 0) AS per_position FROM fc""",
    "feature_parts_overlap": "SELECT region_id, start, stop, greatest(0, least(stop, 50000) - greatest(start, 0)) AS shared FROM regions WHERE start IS NOT NULL AND stop IS NOT NULL",
    "attribute_spellings": "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, 'a b' AS note, 'x' || p_partkey AS by_prefix, CAST(NULL AS VARCHAR) AS empty, 'p' || p_partkey AS piped, p_name AS blank_key, CAST(NULL AS VARCHAR) AS missing FROM part",
    "sizes": "SELECT * FROM (VALUES ('7', CAST(7 AS BIGINT)), ('1.5k', 1500), ('2M', 2000000), ('3G', 3000000000), ('1T', 1000000000000), (' 20K ', 20000)) t(text, bases)",
    "generated_from_bed": """WITH b AS (SELECT chrom, start, stop, region_id FROM regions WHERE chrom IS NOT NULL AND start < stop),
k AS (SELECT chrom, CAST(row_number() OVER (ORDER BY chrom) - 1 AS INTEGER) AS tid, greatest(max(stop) + 100, 100000) AS length FROM b GROUP BY chrom)
SELECT tid, chrom AS name, CAST(length AS BIGINT) AS length, CASE WHEN region_id % 2 = 0 THEN 16 ELSE 0 END AS flag, start, stop, 60 AS mapq, (stop - start) || 'M' AS cigar FROM b JOIN k USING (chrom)""",
    "generated_random": "SELECT CAST(40000 AS BIGINT) AS n, true AS all_fine, true AS depth_reached, true AS many_cigars, true AS all_kinds",
    "generated_targeted": "WITH g AS (SELECT DISTINCT r.tid, start, stop FROM regions g JOIN refs r ON g.chrom = r.name WHERE start < stop) SELECT tid, 3 * count(*) AS reads, max(least(80, stop - start)) AS longest, 3 * count(*) AS within FROM g GROUP BY tid",
    "generated_stacks": "SELECT CAST(range AS BIGINT) AS stack, CAST(50 AS BIGINT) AS reads, true AS within_noise FROM range(200)",
    "generated_tiles": order._with() + "SELECT tid, CAST(700 * k AS BIGINT) AS start, CAST(700 * (k + 1) AS BIGINT) AS stop, 0 AS flag, '700M' AS cigar FROM (SELECT tid, unnest(generate_series(0, length // 700 - 1)) AS k FROM refs)",
    "generated_flags": "SELECT 'read_' || f AS qname, CAST(f AS INTEGER) AS flag, 0 AS tid, CAST(0 AS BIGINT) AS start, CAST('1' || f AS BIGINT) AS stop, 60 AS mapq, '1' || f || 'M' AS cigar FROM (SELECT range AS f FROM range(4096)) WHERE f % 2 = 1 OR f & 238 = 0",
    "every_hundredth": "SELECT region_id, panel_id, chrom, start, stop FROM (SELECT *, row_number() OVER (ORDER BY region_id) AS n FROM (SELECT DISTINCT region_id, panel_id, chrom, start, stop FROM regions)) WHERE n % 100 = 0",
    "streamed_late": order._with(_KEPT, order._sweep("sample", samples="SELECT unnest(['A', 'N', 'R']) AS sample")) + "SELECT sample, tid, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, cov FROM runs",
    "streamed_span_max": _span_sql("max(cov)"),
    "streamed_span_min": _span_sql("min(cov)"),
    "streamed_span_mean": _span_sql(f"CAST(sum(cov * (least(stop, (k + 1) * {SPAN}) - greatest(start, k * {SPAN}))) AS DOUBLE) / {SPAN}.0"),
    "streamed_target": order._with(_KEPT, order._sweep("'all'"), order._pieces("pooled")) + "SELECT name, CAST(sum(cov * (stop - start)) AS BIGINT) AS bases FROM pc GROUP BY name",
    "streamed_windows": order.SQL["events_hourly"],
    "p3_streamed": hygiene.SQL["p3_found"],
}
