"""Queries of the table-hygiene operators over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidespan.operators.dense import dense_aggregate, heavy_keys
from tidespan.operators.differences import Field, difference_rows, differences
from tidespan.operators.packed import NAMES, NUMBERS, split_packed
from tidespan.operators.periods import merge_intervals
from tidespan.plans.testdata import table as _table
from tidespan.sources.rejects import parse_region_lines, rejected_lines, valid_regions

#: A chrom with at least one row in so many counts as found.
HEAVY = 20


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(_table(spark, folder, "alignments"), "chrom", HEAVY).where("chrom >= 0").select("chrom")


def p1_chrom_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, bases, extent and mapping quality of every chrom, -1 and null included."""
    alignments = _table(spark, folder, "alignments")
    known = F.when(F.col("mapq") != 255, F.col("mapq"))
    return dense_aggregate(
        alignments,
        "chrom",
        sums={"bases": F.col("stop") - F.col("start"), "mapq_sum": known},
        mins={"first_start": F.col("start"), "least_mapq": known},
        maxs={"last_stop": F.col("stop")},
    )


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return parse_region_lines(_table(spark, folder, "region_lines"), _table(spark, folder, "region_files"), _table(spark, folder, "refs"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejected_lines(_parsed(spark, folder)).select("line_id")


def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return valid_regions(_parsed(spark, folder)).select("line_id", "chrom", "start", "stop", "name", "score", "strand")


def p2_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected lines with their reasons."""
    return rejected_lines(_parsed(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return merge_intervals(_table(spark, folder, "regions"), ["panel_id", "chrom"])


def p3_tiled(spark: SparkSession, folder: str) -> DataFrame:
    """``p3_found`` with tiles so small that the entities of these tables are cut too."""
    return merge_intervals(_table(spark, folder, "regions"), ["panel_id", "chrom"], tile_rows=20)


_COUNT_FIELDS = [Field("chrom"), Field("strand"), Field("length"), Field("c1", "counts", "c1"), Field("rpkm", within=0.0005)]


def _count_differences(spark: SparkSession, folder: str) -> DataFrame:
    keys = {"sample": F.col("sample"), "geneid": F.trim("geneid")}
    return differences(_table(spark, folder, "fc"), _table(spark, folder, "bamtocounts"), keys, _COUNT_FIELDS, "loaded_at", left_name="fc", right_name="bamtocounts")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return difference_rows(_count_differences(spark, folder), ["sample", "geneid"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    genes = split_packed(_table(spark, folder, "regions"), "region_id", "gene_id", NAMES)
    starts = split_packed(_table(spark, folder, "feature_coords"), "coord_id", "starts", NUMBERS)
    several = lambda df, name: df.where("n_items >= 2").select(F.lit(name).alias("field_name"), "row_id", "pos", "item")
    return several(genes, "gene_id").unionByName(several(starts, "starts"))


QUERIES = {f.__name__: f for f in (p1_found, p1_chrom_profile, p2_found, p2_loaded, p2_rejects, p3_found, p3_tiled, p4_found, p5_found)}

_LINES = r"""
WITH l AS (SELECT line_id, n_cols, regexp_replace(regexp_replace(line, '^\x{FEFF}', ''), '\r\z', '') AS line FROM region_lines JOIN region_files USING (file_no)),
d AS (SELECT * FROM l WHERE NOT (regexp_full_match(line, '[ \t\r]*') OR starts_with(line, '#') OR starts_with(line, 'track ') OR starts_with(line, 'browser '))),
f AS (SELECT line_id, n_cols, regexp_full_match(line, '(?s)("([^"]|"")*"|[^"\t]*)(\t("([^"]|"")*"|[^"\t]*))*') AS quoted,
  list_transform(regexp_extract_all(chr(9) || line, '(?s)\t("(?:[^"]|"")*"|[^"\t]*)', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM d),
c AS (SELECT line_id, n_cols, v, coalesce(quoted AND len(v) = n_cols AND refs.name IS NOT NULL
  AND regexp_full_match(v[2], ' *[0-9]{1,18} *') AND regexp_full_match(v[3], ' *[0-9]{1,18} *')
  AND TRY_CAST(trim(v[2]) AS BIGINT) < TRY_CAST(trim(v[3]) AS BIGINT) AND TRY_CAST(trim(v[3]) AS BIGINT) <= refs.length
  AND (n_cols < 4 OR (length(v[4]) <= 80 AND NOT regexp_matches(v[4], '[\x00-\x08\x0a-\x1f\x7f\x{FFFD}]')))
  AND (n_cols < 5 OR v[5] = '.' OR (regexp_full_match(v[5], '[0-9]+') AND TRY_CAST(v[5] AS HUGEINT) <= 1000))
  AND (n_cols < 6 OR v[6] IN ('+', '-', '.')), false) AS valid FROM f LEFT JOIN refs ON refs.name = v[1])
"""

_PERIODS = """
WITH m AS (SELECT panel_id, chrom, start, stop, max(stop) OVER (PARTITION BY panel_id, chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM (SELECT DISTINCT panel_id, chrom, start, stop FROM regions WHERE panel_id IS NOT NULL AND chrom IS NOT NULL AND start < stop)),
i AS (SELECT *, count(*) FILTER (WHERE reach IS NULL OR start > reach) OVER (PARTITION BY panel_id, chrom ORDER BY start, stop) AS island FROM m),
p AS (SELECT panel_id, chrom, min(start) AS start, max(stop) AS stop FROM i GROUP BY panel_id, chrom, island),
n AS (SELECT *, lead(start) OVER (PARTITION BY panel_id, chrom ORDER BY start) AS next_start FROM p)
SELECT panel_id, chrom, 'period' AS kind, start, stop FROM p UNION ALL SELECT panel_id, chrom, 'gap', stop, next_start FROM n WHERE next_start IS NOT NULL"""

SQL = {
    "p1_found": "SELECT chrom FROM alignments WHERE chrom >= 0 GROUP BY chrom HAVING count(*) * 20 >= (SELECT count(*) FROM alignments)",
    "p1_chrom_profile": """
SELECT chrom, count(*) AS n, CAST(sum(stop - start) AS BIGINT) AS bases, CAST(sum(mapq) FILTER (WHERE mapq <> 255) AS BIGINT) AS mapq_sum,
  min(start) AS first_start, CAST(min(mapq) FILTER (WHERE mapq <> 255) AS BIGINT) AS least_mapq, max(stop) AS last_stop
FROM alignments GROUP BY chrom""",
    "p2_found": _LINES + "SELECT line_id FROM c WHERE NOT valid",
    "p2_loaded": _LINES
    + """SELECT line_id, v[1] AS chrom, CAST(trim(v[2]) AS BIGINT) AS start, CAST(trim(v[3]) AS BIGINT) AS stop,
  CASE WHEN n_cols >= 4 THEN v[4] END AS name, CASE WHEN n_cols >= 5 THEN v[5] END AS score, CASE WHEN n_cols >= 6 THEN v[6] END AS strand FROM c WHERE valid""",
    "p3_found": _PERIODS,
    "p3_tiled": _PERIODS,
    "p4_found": """
WITH a AS (SELECT sample, trim(geneid) AS geneid, chrom, strand, length, counts AS c1, rpkm, 1 AS there FROM fc
  QUALIFY row_number() OVER (PARTITION BY sample, trim(geneid) ORDER BY loaded_at DESC NULLS LAST, chrom DESC NULLS LAST, strand DESC NULLS LAST, length DESC NULLS LAST, counts DESC NULLS LAST, rpkm DESC NULLS LAST) = 1),
b AS (SELECT sample, trim(geneid) AS geneid, chrom, strand, length, c1, rpkm, 1 AS there FROM bamtocounts
  QUALIFY row_number() OVER (PARTITION BY sample, trim(geneid) ORDER BY loaded_at DESC NULLS LAST, chrom DESC NULLS LAST, strand DESC NULLS LAST, length DESC NULLS LAST, c1 DESC NULLS LAST, rpkm DESC NULLS LAST) = 1),
j AS (SELECT coalesce(a.sample, b.sample) AS sample, coalesce(a.geneid, b.geneid) AS geneid,
  CASE WHEN a.there IS NULL THEN ['missing_in_fc'] WHEN b.there IS NULL THEN ['missing_in_bamtocounts'] ELSE list_filter([
    CASE WHEN a.chrom IS DISTINCT FROM b.chrom THEN 'chrom' END, CASE WHEN a.strand IS DISTINCT FROM b.strand THEN 'strand' END,
    CASE WHEN a.length IS DISTINCT FROM b.length THEN 'length' END, CASE WHEN a.c1 IS DISTINCT FROM b.c1 THEN 'c1' END,
    CASE WHEN (a.rpkm IS NULL) <> (b.rpkm IS NULL) OR coalesce(CASE WHEN isnan(a.rpkm) OR isnan(b.rpkm) THEN isnan(a.rpkm) <> isnan(b.rpkm)
      WHEN a.rpkm = b.rpkm THEN false ELSE abs(a.rpkm - b.rpkm) > 0.0005 END, false) THEN 'rpkm' END], lambda x: x IS NOT NULL) END AS diffs
  FROM a FULL JOIN b ON a.sample IS NOT DISTINCT FROM b.sample AND a.geneid IS NOT DISTINCT FROM b.geneid)
SELECT sample, geneid, unnest(diffs) AS diff FROM j""",
    "p5_found": r"""
WITH g AS (SELECT DISTINCT region_id, regexp_extract_all(gene_id, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[A-Za-z0-9._-]+') AS v FROM regions WHERE gene_id IS NOT NULL),
s AS (SELECT DISTINCT coord_id, regexp_extract_all(starts, '[0-9]+') AS v FROM feature_coords WHERE starts IS NOT NULL),
e AS (SELECT 'gene_id' AS field_name, region_id AS row_id, unnest(v) AS raw, CAST(generate_subscripts(v, 1) AS BIGINT) AS pos FROM g WHERE len(v) >= 2
  UNION ALL SELECT 'starts', coord_id, unnest(v), CAST(generate_subscripts(v, 1) AS BIGINT) FROM s WHERE len(v) >= 2)
SELECT field_name, row_id, pos, CASE WHEN raw[1] = '"' THEN replace(raw[2:-2], '""', '"') WHEN raw[1] = '''' THEN replace(raw[2:-2], '''''', '''') ELSE raw END AS item FROM e""",
}
