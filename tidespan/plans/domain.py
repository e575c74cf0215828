"""Queries of the coverage operators over the domain tables, with all that is in them: skew, duplicates, null and overhanging bounds, reads on no reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidespan.operators.alignments import assert_sorted, keep_reads, read_intervals
from tidespan.operators.joins import bind_regions, interval_join
from tidespan.operators.lengths import length_stats, mean_depth_by_ref, rename_references, whole_references
from tidespan.operators.multisample import antitarget, band_label, compare_counts, fuse_runs, intersect_samples, missing_names, shared_low_coverage, total_delta, union_names
from tidespan.operators.spans import fill_spans, span_summary
from tidespan.operators.stats import clip_to_regions, count_reads, count_refs, coverage_to_target, mapped_reads, ref_stats, region_stats, total_reads
from tidespan.operators.sweep import coverage
from tidespan.options import COMPAT_COUNTS, InputOptions
from tidespan.plans.testdata import table

SPAN = 100_000


def _refs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "refs")


def _reads(spark: SparkSession, folder: str) -> DataFrame:
    """Each alignment once, as the relation that the operators take."""
    rows = table(spark, folder, "alignments").withColumnRenamed("chrom", "tid")
    return rows.dropDuplicates(["aln_id"]).select("aln_id", "sample", "flag", "tid", "start", "stop", "mapq", "isize")


def _intervals(spark: SparkSession, folder: str, options: InputOptions = InputOptions()) -> DataFrame:
    return read_intervals(_reads(spark, folder), _refs(spark, folder), options)


def _runs(spark: SparkSession, folder: str, options: InputOptions = InputOptions(), **how) -> DataFrame:
    return coverage(_intervals(spark, folder, options).withColumn("sample", F.lit("all")), _refs(spark, folder), samples=["all"], **how)


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    """Every region once, on the references; those without a reference or bounds fall out."""
    raw = table(spark, folder, "regions").where("start < stop").select("region_id", "chrom", "start", "stop", "name").distinct()
    return bind_regions(raw, _refs(spark, folder), unknown="drop")


# depth


def aln_stranded(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder, stranded=True).select("tid", "start", "stop", "fwd", "rev", "cov")


def aln_tiled(spark: SparkSession, folder: str) -> DataFrame:
    """``alignment_runs`` with short tiles."""
    return _runs(spark, folder, tile=1 << 16).select("tid", "start", "stop", "cov")


def aln_banded(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder, bands="1,5,20").select("tid", "start", "stop", "band")


def aln_banded_stranded(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder, stranded=True, bands="1,5").select("tid", "start", "stop", "band_fwd", "band_rev")


def aln_samples(spark: SparkSession, folder: str) -> DataFrame:
    return coverage(_intervals(spark, folder), _refs(spark, folder)).select("sample", "tid", "start", "stop", "cov")


def aln_physical(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder, InputOptions(physical=True)).select("tid", "start", "stop", "cov")


def aln_fragments(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder, InputOptions(min_mapq=20, fragment_length=300)).select("tid", "start", "stop", "cov")


def aln_every_flag(spark: SparkSession, folder: str) -> DataFrame:
    """No flag is masked."""
    return _runs(spark, folder, InputOptions(flag_mask=0)).select("tid", "start", "stop", "cov")


def aln_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """Depth with the check that reads come in order, over the tables' rows numbered by start."""
    rows = _reads(spark, folder).withColumn("place", F.struct("start", "aln_id"))
    checked = assert_sorted(rows.where("start IS NOT NULL"), "place")
    return coverage(read_intervals(checked, _refs(spark, folder)).withColumn("sample", F.lit("all")), _refs(spark, folder), samples=["all"]).select("tid", "start", "stop", "cov")


def _spans(op: str, partial: str = "nominal"):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        known = _refs(spark, folder)
        return fill_spans(span_summary(_runs(spark, folder), known, SPAN, op, partial=partial), known, SPAN, ["all"]).select("tid", "start", "stop", "cov")

    query.__name__ = f"aln_span_{op}" + ("_actual" if partial == "actual" else "")
    return query


def aln_span_stranded(spark: SparkSession, folder: str) -> DataFrame:
    known = _refs(spark, folder)
    found = span_summary(_runs(spark, folder, stranded=True), known, SPAN, "max", columns=["fwd", "rev"])
    return fill_spans(found, known, SPAN, ["all"]).select("tid", "start", "stop", "fwd", "rev")


# regions


def aln_in_regions(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of runs of depth 1 and more in every region."""
    return clip_to_regions(_runs(spark, folder).where("cov > 0"), _regions(spark, folder)).groupBy("name").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col("cov") * (F.col("stop") - F.col("start"))).alias("bases"))


def aln_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """The least and greatest depth of each name, contacts without a common position among them."""
    pieces = clip_to_regions(_runs(spark, folder), _regions(spark, folder), compat=True)
    return pieces.groupBy("name").agg(F.min("cov").alias("least"), F.max("cov").alias("greatest"), F.count(F.lit(1)).alias("contacts"))


def aln_region_stats(spark: SparkSession, folder: str) -> DataFrame:
    return region_stats(_runs(spark, folder, stranded=True), _regions(spark, folder), samples=["all"], stranded=True, low=5).drop("sample")


def aln_region_stats_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Per sample and name; samples and names without cover have zeros."""
    found = _intervals(spark, folder)
    samples = sorted(r["sample"] for r in table(spark, folder, "alignments").select("sample").distinct().collect())
    return region_stats(coverage(found, _refs(spark, folder), samples=samples), _regions(spark, folder), samples=samples)


def aln_reference_stats(spark: SparkSession, folder: str) -> DataFrame:
    return ref_stats(coverage(_intervals(spark, folder), _refs(spark, folder)), _refs(spark, folder), low=1)


def aln_whole_references(spark: SparkSession, folder: str) -> DataFrame:
    return region_stats(_runs(spark, folder), whole_references(_refs(spark, folder)), samples=["all"]).drop("sample")


def _counts(how: dict, options: InputOptions = InputOptions()):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return count_reads(_intervals(spark, folder, options), _regions(spark, folder), **how)

    return query


def aln_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _counts({})(spark, folder)


def aln_counts_strict(spark: SparkSession, folder: str) -> DataFrame:
    return _counts({"strict": True})(spark, folder)


def aln_counts_compat(spark: SparkSession, folder: str) -> DataFrame:
    """The older predicate, and no read of quality 0."""
    return _counts({"compat": True}, COMPAT_COUNTS)(spark, folder)


def aln_in_target(spark: SparkSession, folder: str) -> DataFrame:
    """Reads that meet a region, after a shuffle that has nothing to do with them."""
    reads = _intervals(spark, folder).repartition(7).select("sample", "tid", "start", "stop")
    return interval_join(reads, _regions(spark, folder), ["tid"], how="semi").groupBy("sample", "tid").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start"))


def aln_ref_counts(spark: SparkSession, folder: str) -> DataFrame:
    reads = _reads(spark, folder)
    samples = sorted(r["sample"] for r in table(spark, folder, "alignments").select("sample").distinct().collect())
    return count_refs(keep_reads(reads, InputOptions(min_mapq=1)), _refs(spark, folder), samples, mapped=mapped_reads(reads)).select("sample", "name", "counts", "cpm")


def aln_totals(spark: SparkSession, folder: str) -> DataFrame:
    """All records and the mapped ones of each sample."""
    reads = _reads(spark, folder)
    mapped = mapped_reads(reads).withColumnRenamed("total", "mapped")
    return total_reads(reads).join(mapped, "sample", "left").select("sample", "total", F.coalesce("mapped", F.lit(0)).alias("mapped"))


def aln_shared_low(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches with a depth of up to 1 in nine tenths of the samples, labelled."""
    known = _refs(spark, folder)
    n = table(spark, folder, "alignments").select("sample").distinct().count()
    found = shared_low_coverage(coverage(_intervals(spark, folder), known), known, 0, 1, n, 0.9)
    return found.select("tid", "start", "stop", "n", band_label(0, 1, F.lit(0.9)).alias("label"))


def aln_shared_by_three(spark: SparkSession, folder: str) -> DataFrame:
    return intersect_samples(_intervals(spark, folder), _refs(spark, folder), 3)


def panel_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """What no region of any panel covers."""
    return antitarget(_regions(spark, folder), _refs(spark, folder))


# the coverage table


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    """Each measured piece once: sample, tid, start, stop, cov."""
    return table(spark, folder, "coverage").where("forward >= 0").dropDuplicates(["run_id", "sample", "tid", "start", "stop"]).select("sample", "tid", "start", "stop", F.col("forward").alias("cov"))


def cov_to_target(spark: SparkSession, folder: str) -> DataFrame:
    return coverage_to_target(_measured(spark, folder), _regions(spark, folder), normalise=True)


def cov_to_first_target(spark: SparkSession, folder: str) -> DataFrame:
    """Each piece goes to the first region that it meets. Pieces with the same bounds and regions with the same start count as the operator says."""
    pieces = _measured(spark, folder).groupBy("tid", "start", "stop").agg(F.sum("cov").alias("cov"))
    target = _regions(spark, folder).groupBy("tid", "start", "stop").agg(F.min("name").alias("name"))
    return coverage_to_target(pieces, target, first_only=True)


def cov_means(spark: SparkSession, folder: str) -> DataFrame:
    return mean_depth_by_ref(_measured(spark, folder), _refs(spark, folder))


def cov_fused(spark: SparkSession, folder: str) -> DataFrame:
    """Adjacent pieces of one run with the same measured depths as one; the pieces of a run don't overlap."""
    pieces = table(spark, folder, "coverage").where("forward IS NOT NULL AND reverse IS NOT NULL").select(F.concat_ws("/", F.col("run_id").cast("string"), "sample").alias("sample"), "tid", "start", "stop", F.struct("forward", "reverse").alias("cov")).distinct()
    single = pieces.groupBy("sample", "tid", "start").agg(F.max(F.struct("stop", "cov")).alias("p")).select("sample", "tid", "start", "p.stop", "p.cov")
    return fuse_runs(single).select("sample", "tid", "start", "stop", F.col("cov.forward").alias("forward"), F.col("cov.reverse").alias("reverse"))


# the statistics table and the references


def reference_n50(spark: SparkSession, folder: str) -> DataFrame:
    return length_stats(_refs(spark, folder))


def stats_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return length_stats(table(spark, folder, "stats"), "bam_length")


def stats_names(spark: SparkSession, folder: str) -> DataFrame:
    """Every name that any sample reports, and whether the panels know it."""
    stats = table(spark, folder, "stats")
    known = table(spark, folder, "feature_coords").select("name").where("name IS NOT NULL").distinct()
    lacking = missing_names(stats, known).select("name", F.lit(True).alias("unknown"))
    return union_names(stats).join(lacking, "name", "left").select("name", F.coalesce("unknown", F.lit(False)).alias("unknown"))


def _sample_counts(spark: SparkSession, folder: str, name: str, value: str) -> DataFrame:
    rows = table(spark, folder, name).select(F.trim("geneid").alias("geneid"), F.coalesce(value, F.lit(0)).alias("n")).where("geneid IS NOT NULL")
    return rows.distinct().groupBy("geneid").agg(F.sum("n").alias("n"))


def counts_compared(spark: SparkSession, folder: str) -> DataFrame:
    """Summed counts of each gene in the two copies; genes that only one of them has are left out."""
    left, right = _sample_counts(spark, folder, "fc", "counts"), _sample_counts(spark, folder, "bamtocounts", "c1")
    return compare_counts(left.join(right, "geneid", "left_semi"), right.join(left, "geneid", "left_semi"), "geneid", "n")


def counts_compared_total(spark: SparkSession, folder: str) -> DataFrame:
    return total_delta(counts_compared(spark, folder))


def regions_renamed(spark: SparkSession, folder: str) -> DataFrame:
    """The regions' references under the names of the next reference in the header's order; the last keeps its own."""
    old = _refs(spark, folder).select(F.col("tid").alias("ord"), "name")
    new = _refs(spark, folder).where("tid > 0").select((F.col("tid") - 1).alias("ord"), "name")
    return rename_references(table(spark, folder, "regions").select("region_id", "chrom", "start", "stop"), old, new)


QUERIES = {
    f.__name__: f
    for f in (
        aln_stranded, aln_tiled, aln_banded, aln_banded_stranded, aln_samples, aln_physical, aln_fragments, aln_every_flag, aln_sorted, _spans("max"), _spans("min"), _spans("mean"), _spans("mean", "actual"), aln_span_stranded,
        aln_in_regions, aln_contacts, aln_region_stats, aln_region_stats_samples, aln_reference_stats, aln_whole_references, aln_counts, aln_counts_strict, aln_counts_compat, aln_in_target, aln_ref_counts, aln_totals,
        aln_shared_low, aln_shared_by_three, panel_gaps, cov_to_target, cov_to_first_target, cov_means, cov_fused, reference_n50, stats_lengths, stats_names, counts_compared, counts_compared_total, regions_renamed,
    )
}


def _kept(where: str = "flag & 1796 = 0", stop: str = "stop") -> str:
    """Reads that count, each once and clamped to its reference."""
    return f"""al AS (SELECT DISTINCT aln_id, sample, flag, chrom AS tid, start, stop, mapq, isize FROM alignments),
kn AS (SELECT aln_id, sample, tid, greatest(start, 0) AS start, least({stop}, r.length) AS stop, flag & 16 <> 0 AS reverse FROM al JOIN refs r USING (tid)
  WHERE {where} AND start IS NOT NULL AND {stop} IS NOT NULL AND greatest(start, 0) < least({stop}, r.length))"""


def _sweep(sample: str = "'all'", keep: str = "df + dr <> 0", source: str = "kn", samples: str = "SELECT 'all' AS sample") -> str:
    return f"""ev AS (SELECT {sample} AS sample, tid, start AS pos, CASE WHEN reverse THEN 0 ELSE 1 END AS df, CASE WHEN reverse THEN 1 ELSE 0 END AS dr FROM {source}
  UNION ALL SELECT {sample}, tid, stop, CASE WHEN reverse THEN 0 ELSE -1 END, CASE WHEN reverse THEN -1 ELSE 0 END FROM {source}
  UNION ALL SELECT s.sample, r.tid, 0, 0, 0 FROM refs r, ({samples}) s),
net AS (SELECT sample, tid, pos, sum(df) AS df, sum(dr) AS dr FROM ev GROUP BY ALL),
chg AS (SELECT n.*, length FROM net n JOIN refs USING (tid) WHERE pos < length AND (pos = 0 OR {keep})),
runs AS (SELECT sample, tid, CAST(pos AS BIGINT) AS start, CAST(coalesce(lead(pos) OVER w, length) AS BIGINT) AS stop, CAST(sum(df) OVER w AS BIGINT) AS fwd, CAST(sum(dr) OVER w AS BIGINT) AS rev, CAST(sum(df + dr) OVER w AS BIGINT) AS cov
  FROM chg WINDOW w AS (PARTITION BY sample, tid ORDER BY pos))"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_STRANDS, _EACH = _sweep(keep="df <> 0 OR dr <> 0"), _sweep("sample", samples="SELECT DISTINCT sample FROM alignments")
_RUNS = _with(_kept(), _sweep())
_DEPTH = "SELECT tid, start, stop, cov FROM runs"
_REG = "rg AS (SELECT DISTINCT region_id, r.tid, start, stop, coalesce(nullif(g.name, ''), chrom || ':' || start || '-' || stop) AS name FROM regions g JOIN refs r ON g.chrom = r.name WHERE start < stop)"
_PIECES = "pc AS (SELECT u.sample, g.name, u.tid, greatest(u.start, g.start) AS start, least(u.stop, g.stop) AS stop, cov, fwd, rev FROM runs u JOIN rg g ON u.tid = g.tid AND u.start < g.stop AND g.start < u.stop)"
_NAMES = "(SELECT DISTINCT name FROM rg)"


def _bands(breaks: list[int], column: str) -> str:
    lows = [0, *breaks]
    labels = [f"{a}-{b - 1}" for a, b in zip(lows, lows[1:])] + [f"{lows[-1]}-"]
    return "CASE " + " ".join(f"WHEN {column} >= {a} THEN '{x}'" for a, x in sorted(zip(lows, labels), reverse=True)) + " END"


def _banded(columns: dict[str, str]) -> str:
    labels, names = ", ".join(f"{e} AS {k}" for k, e in columns.items()), ", ".join(columns)
    fresh = " OR ".join(f"{k} IS DISTINCT FROM lag({k}) OVER w" for k in columns)
    return f""", lab AS (SELECT tid, start, stop, {labels} FROM runs),
isl AS (SELECT *, CASE WHEN {fresh} THEN 1 ELSE 0 END AS fresh FROM lab WINDOW w AS (PARTITION BY tid ORDER BY start)),
num AS (SELECT *, sum(fresh) OVER (PARTITION BY tid ORDER BY start) AS island FROM isl)
SELECT tid, min(start) AS start, max(stop) AS stop, {", ".join(f"any_value({k}) AS {k}" for k in columns)} FROM num GROUP BY tid, island"""


def _span_sql(value: str, columns: str = "cov") -> str:
    return f""", sp AS (SELECT *, unnest(generate_series(start // {SPAN}, (stop - 1) // {SPAN})) AS k FROM runs)
SELECT tid, CAST(k * {SPAN} AS BIGINT) AS start, CAST(least((k + 1) * {SPAN}, any_value(length)) AS BIGINT) AS stop, {value} FROM sp JOIN refs USING (tid) GROUP BY tid, k"""


_SUM = f"CAST(sum(cov * (least(stop, (k + 1) * {SPAN}) - greatest(start, k * {SPAN}))) AS DOUBLE)"


def _stats(suffix: str = "", column: str = "cov", low: int | None = None) -> str:
    span = "(stop - start)"
    out = f"coalesce(CAST(sum({column} * {span}) AS BIGINT), 0) AS bases{suffix}, coalesce(CAST(sum({column} * {span}) AS DOUBLE) / CAST(sum({span}) AS DOUBLE), 0) AS mean{suffix}, coalesce(min({column}), 0) AS min{suffix}, coalesce(max({column}), 0) AS max{suffix}"
    return out if low is None else f"{out}, coalesce(CAST(sum(CASE WHEN {column} < {low} THEN {span} ELSE 0 END) AS BIGINT), 0) AS low{suffix}"


_LENGTH = "coalesce(CAST(sum(stop - start) AS BIGINT), 0) AS length"
_COMPAT = "((k.start > g.start AND k.start < g.stop) OR (k.stop > g.start AND k.stop < g.stop) OR (k.start < g.start AND k.stop > g.stop))"


def _count_sql(meets: str = "k.start < g.stop AND g.start < k.stop", where: str = "flag & 1796 = 0") -> str:
    return _with(_kept(where), _REG) + f"""SELECT k.sample, g.name, CAST(count(*) FILTER (WHERE NOT reverse) AS BIGINT) AS fwd, CAST(count(*) FILTER (WHERE reverse) AS BIGINT) AS rev, count(*) AS counts
FROM kn k JOIN rg g ON k.tid = g.tid AND {meets} GROUP BY k.sample, g.name"""


_LEVELS = """le AS (SELECT tid, start AS pos, 1 AS d FROM hv UNION ALL SELECT tid, stop, -1 FROM hv),
ln AS (SELECT tid, pos, sum(d) AS d FROM le GROUP BY ALL HAVING sum(d) <> 0),
lr AS (SELECT tid, CAST(pos AS BIGINT) AS start, CAST(lead(pos) OVER w AS BIGINT) AS stop, CAST(sum(d) OVER w AS BIGINT) AS n FROM ln WINDOW w AS (PARTITION BY tid ORDER BY pos))"""
_MEASURED = "cv AS (SELECT DISTINCT ON (run_id, sample, tid, start, stop) sample, tid, start, stop, forward AS cov FROM coverage WHERE forward >= 0 ORDER BY ALL)"
_GENES = """a AS (SELECT geneid, CAST(sum(n) AS BIGINT) AS n FROM (SELECT DISTINCT trim(geneid) AS geneid, coalesce(counts, 0) AS n FROM fc WHERE geneid IS NOT NULL) GROUP BY geneid),
b AS (SELECT geneid, CAST(sum(n) AS BIGINT) AS n FROM (SELECT DISTINCT trim(geneid) AS geneid, coalesce(c1, 0) AS n FROM bamtocounts WHERE geneid IS NOT NULL) GROUP BY geneid)"""


def _n50(source: str) -> str:
    return f"""WITH h AS (SELECT length, count(*) AS n FROM ({source}) WHERE length >= 0 GROUP BY 1), c AS (SELECT *, sum(length * n) OVER (ORDER BY length DESC) AS cum, sum(length * n) OVER () AS total FROM h)
SELECT CAST(sum(n) AS BIGINT) AS n, CAST(any_value(total) AS BIGINT) AS total, max(length) AS longest, max(length) FILTER (WHERE 2 * cum > total) AS n50 FROM c"""


SQL = {
    "aln_stranded": _with(_kept(), _STRANDS) + "SELECT tid, start, stop, fwd, rev, cov FROM runs",
    "aln_tiled": _RUNS + _DEPTH,
    "aln_banded": _RUNS.rstrip() + _banded({"band": _bands([1, 5, 20], "cov")}),
    "aln_banded_stranded": _with(_kept(), _STRANDS).rstrip() + _banded({"band_fwd": _bands([1, 5], "fwd"), "band_rev": _bands([1, 5], "rev")}),
    "aln_samples": _with(_kept(), _sweep("sample", samples="SELECT DISTINCT sample FROM kn")) + "SELECT sample, tid, start, stop, cov FROM runs",
    "aln_physical": _with(_kept("flag & 1796 = 0 AND isize > 0", "start + isize"), _sweep()) + _DEPTH,
    "aln_fragments": _with(_kept("flag & 1796 = 0 AND mapq >= 20", "start + 300"), _sweep()) + _DEPTH,
    "aln_every_flag": _with(_kept("true"), _sweep()) + _DEPTH,
    "aln_sorted": _RUNS + _DEPTH,
    "aln_span_max": _RUNS.rstrip() + _span_sql("max(cov) AS cov"),
    "aln_span_min": _RUNS.rstrip() + _span_sql("min(cov) AS cov"),
    "aln_span_mean": _RUNS.rstrip() + _span_sql(f"{_SUM} / {SPAN} AS cov"),
    "aln_span_mean_actual": _RUNS.rstrip() + _span_sql(f"{_SUM} / CAST(least((k + 1) * {SPAN}, any_value(length)) - k * {SPAN} AS DOUBLE) AS cov"),
    "aln_span_stranded": _with(_kept(), _STRANDS).rstrip() + _span_sql("max(fwd) AS fwd, max(rev) AS rev"),
    "aln_in_regions": _with(_kept(), _sweep(), _REG, _PIECES) + "SELECT name, count(*) AS pieces, CAST(sum(cov * (stop - start)) AS BIGINT) AS bases FROM pc WHERE cov > 0 GROUP BY name",
    "aln_contacts": _with(_kept(), _sweep(), _REG) + "SELECT name, min(cov) AS least, max(cov) AS greatest, count(*) AS contacts FROM runs u JOIN rg g ON u.tid = g.tid AND u.start <= g.stop AND g.start <= u.stop GROUP BY name",
    "aln_region_stats": _with(_kept(), _STRANDS, _REG, _PIECES) + f"SELECT n.name, {_stats(low=5)}, {_stats('_forward', 'fwd', 5)}, {_stats('_reverse', 'rev', 5)}, {_LENGTH} FROM {_NAMES} n LEFT JOIN pc USING (name) GROUP BY n.name",
    "aln_region_stats_samples": _with(_kept(), _EACH, _REG, _PIECES) + f"SELECT s.sample, n.name, {_stats()}, {_LENGTH} FROM {_NAMES} n CROSS JOIN (SELECT DISTINCT sample FROM alignments) s LEFT JOIN pc ON pc.name = n.name AND pc.sample = s.sample GROUP BY s.sample, n.name",
    "aln_reference_stats": _with(_kept(), _sweep("sample", samples="SELECT DISTINCT sample FROM kn")) + f"SELECT sample, name, {_stats(low=1)}, {_LENGTH} FROM runs JOIN refs USING (tid) GROUP BY sample, name",
    "aln_whole_references": _RUNS + f"SELECT name, {_stats()}, {_LENGTH} FROM runs JOIN refs USING (tid) GROUP BY name",
    "aln_counts": _count_sql(),
    "aln_counts_strict": _count_sql("g.start <= k.start AND k.stop <= g.stop"),
    "aln_counts_compat": _count_sql(_COMPAT, "flag & 1796 = 0 AND mapq <> 0"),
    "aln_in_target": _with(_kept(), _REG) + "SELECT sample, tid, count(*) AS n, CAST(sum(start) AS BIGINT) AS sum_start FROM kn k WHERE EXISTS (SELECT 1 FROM rg g WHERE g.tid = k.tid AND k.start < g.stop AND g.start < k.stop) GROUP BY sample, tid",
    "aln_ref_counts": _with(_kept(), "mp AS (SELECT sample, count(*) AS total FROM al WHERE flag & 4 = 0 GROUP BY sample)", "co AS (SELECT sample, tid, count(*) AS n FROM al WHERE tid >= 0 AND flag & 1796 = 0 AND mapq >= 1 GROUP BY ALL)")
    + "SELECT s.sample, r.name, coalesce(n, 0) AS counts, CAST(coalesce(n, 0) AS DOUBLE) / (total / CAST(1e6 AS DOUBLE)) AS cpm FROM refs r CROSS JOIN (SELECT DISTINCT sample FROM alignments) s LEFT JOIN co ON co.tid = r.tid AND co.sample = s.sample LEFT JOIN mp ON mp.sample = s.sample",
    "aln_totals": _with(_kept()) + "SELECT sample, count(*) AS total, CAST(count(*) FILTER (WHERE flag & 4 = 0) AS BIGINT) AS mapped FROM al GROUP BY sample",
    "aln_shared_low": _with(_kept(), _EACH, "hv AS (SELECT tid, start, stop FROM runs WHERE cov <= 1)", _LEVELS) + "SELECT tid, start, stop, n, '0X-1X,90%' AS label FROM lr WHERE n >= ceil(0.9 * (SELECT count(DISTINCT sample) FROM alignments) - 1e-9)",
    "aln_shared_by_three": _with(_kept(), _EACH, "hv AS (SELECT tid, start, stop FROM runs WHERE cov > 0)", _LEVELS) + "SELECT tid, start, stop, n FROM lr WHERE n >= 3",
    "panel_gaps": _with(_REG, "mx AS (SELECT tid, start, max(stop) OVER (PARTITION BY tid ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT tid, start, stop FROM rg UNION ALL SELECT tid, length, length FROM refs))")
    + "SELECT m.tid, CAST(coalesce(reach, 0) AS BIGINT) AS start, CAST(least(start, length) AS BIGINT) AS stop FROM mx m JOIN refs USING (tid) WHERE coalesce(reach, 0) < least(start, length)",
    "cov_to_target": _with(_MEASURED, _REG, "ln AS (SELECT name, sum(stop - start) AS length FROM rg GROUP BY name)", "bs AS (SELECT g.name, sum(cov * (least(c.stop, g.stop) - greatest(c.start, g.start))) AS bases FROM cv c JOIN rg g ON c.tid = g.tid AND c.start < g.stop AND g.start < c.stop GROUP BY g.name)")
    + "SELECT name, coalesce(CAST(bases AS BIGINT), 0) AS bases, CAST(length AS BIGINT) AS length, coalesce(CAST(bases AS DOUBLE), 0) / CAST(length AS DOUBLE) AS per_position FROM ln LEFT JOIN bs USING (name)",
    "cov_to_first_target": _with(
        _MEASURED, _REG, "pi AS (SELECT tid, start, stop, sum(cov) AS cov FROM cv GROUP BY ALL)", "rt AS (SELECT tid, start, stop, min(name) AS name FROM rg GROUP BY ALL)",
        "hi AS (SELECT p.start, p.stop, p.cov, g.start AS gs, g.stop AS ge, g.name FROM pi p JOIN rt g ON p.tid = g.tid AND p.start < g.stop AND g.start < p.stop QUALIFY row_number() OVER (PARTITION BY p.tid, p.start, p.stop ORDER BY g.start, g.stop, g.name) = 1)",
        "bs AS (SELECT name, sum(cov * (least(stop, ge) - greatest(start, gs))) AS bases FROM hi GROUP BY name)",
    )
    + "SELECT name, coalesce(CAST(any_value(bases) AS BIGINT), 0) AS bases, CAST(sum(stop - start) AS BIGINT) AS length FROM rt LEFT JOIN bs USING (name) GROUP BY name",
    "cov_means": _with(_MEASURED) + "SELECT sample, name, CAST(sum(stop - start) AS BIGINT) AS length, CAST(sum(cov * (stop - start)) AS DOUBLE) / CAST(sum(stop - start) AS DOUBLE) AS mean FROM cv JOIN refs USING (tid) GROUP BY sample, name",
    "cov_fused": """WITH p AS (SELECT run_id || '/' || sample AS sample, tid, start, max((stop, forward, reverse)) AS m FROM coverage WHERE forward IS NOT NULL AND reverse IS NOT NULL GROUP BY ALL),
q AS (SELECT sample, tid, start, m[1] AS stop, m[2] AS forward, m[3] AS reverse FROM p),
i AS (SELECT *, CASE WHEN lag(stop) OVER w = start AND lag(forward) OVER w = forward AND lag(reverse) OVER w = reverse THEN 0 ELSE 1 END AS fresh FROM q WINDOW w AS (PARTITION BY sample, tid ORDER BY start)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY sample, tid ORDER BY start) AS island FROM i)
SELECT sample, tid, min(start) AS start, max(stop) AS stop, any_value(forward) AS forward, any_value(reverse) AS reverse FROM n GROUP BY sample, tid, island""",
    "reference_n50": _n50("SELECT length FROM refs"),
    "stats_lengths": _n50("SELECT bam_length AS length FROM stats"),
    "stats_names": "SELECT DISTINCT s.name, NOT EXISTS (SELECT 1 FROM feature_coords f WHERE f.name = s.name) AS unknown FROM stats s",
    "counts_compared": _with(_GENES) + "SELECT geneid, a.n AS left_value, b.n AS right_value, b.n - a.n AS delta, CASE WHEN a.n <> 0 THEN 100.0::DOUBLE * (b.n - a.n) / a.n END AS percent FROM a JOIN b USING (geneid)",
    "counts_compared_total": _with(_GENES) + "SELECT CAST(sum(b.n - a.n) AS BIGINT) AS delta, CAST(sum(abs(b.n - a.n)) AS BIGINT) AS amount FROM a JOIN b USING (geneid)",
    "regions_renamed": "SELECT region_id, coalesce(n.name, g.chrom) AS chrom, start, stop FROM regions g LEFT JOIN refs o ON o.name = g.chrom LEFT JOIN refs n ON n.tid = o.tid + 1",
}
