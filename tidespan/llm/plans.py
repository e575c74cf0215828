"""Queries of this package over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidespan.llm.containers import fill_containers
from tidespan.llm.quantiles import percentiles, rank_error, read_percentiles, sketch_groups
from tidespan.llm.tokens import encode_texts, token_counts
from tidespan.llm.truncation import cut_shares, cut_texts

#: Tokens of a container.
CAPACITY = 2048
SHARES = {"p01": 0.01, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
_LOW, _HIGH = {k: q for k, q in SHARES.items() if q < 0.5}, {k: q for k, q in SHARES.items() if q >= 0.5}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _labelled(found: DataFrame, field: str, name: str) -> DataFrame:
    return found.select(F.lit(field).alias("field_name"), "sample", F.col(name).cast("string").alias("name"), "n", "least", *SHARES, "greatest", F.lit(rank_error()).alias("rank_error"))


def _measured(column: str) -> Column:
    """-1 stands for what wasn't measured."""
    return F.when(F.col(column) != -1, F.col(column))


def _both_tails(groups: list[str], read: Callable[[dict[str, float], bool], DataFrame]) -> DataFrame:
    """The shares below 0.5 from sketches that protect the smallest values, the others from those that protect the largest."""
    low = read(_LOW, False).select(*(F.col(g).alias(f"low_{g}") for g in groups), *_LOW)
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"low_{g}")) for g in groups))
    return read(_HIGH, True).join(low, same)


def p6_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of bam_mean per sample and name and of forward per sample and tid, over all rows."""
    stats, pieces = _table(spark, folder, "stats"), _table(spark, folder, "coverage")
    means = _both_tails(["sample", "name"], lambda shares, high: percentiles(stats, ["sample", "name"], _measured("bam_mean"), shares, high=high))
    depths = _both_tails(["sample", "tid"], lambda shares, high: percentiles(pieces, ["sample", "tid"], _measured("forward"), shares, high=high))
    return _labelled(means, "bam_mean", "name").unionByName(_labelled(depths, "forward", "tid"))


def p6_from_days(spark: SparkSession, folder: str) -> DataFrame:
    """The same for forward, from the sketches of single run_days."""
    pieces = _table(spark, folder, "coverage")
    days = {high: sketch_groups(pieces, ["run_day", "sample", "tid"], _measured("forward"), high=high) for high in (False, True)}
    return _labelled(_both_tails(["sample", "tid"], lambda shares, high: read_percentiles(days[high], ["sample", "tid"], shares, high=high)), "forward", "tid")


def p6_within_bound(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each percentile of forward, per sample and tid and per sample, keeps the bound against exact ranks.

    The stated bound is three standard deviations; a few of thousands of ranks may pass it, none should pass five.
    """
    pieces = _table(spark, folder, "coverage")
    parts = []
    for groups in (["sample", "tid"], ["sample"]):
        found = _both_tails(groups, lambda shares, high, g=groups: percentiles(pieces, g, _measured("forward"), shares, high=high))
        values = pieces.select(*(F.col(g).alias(f"of_{g}") for g in groups), _measured("forward").cast("double").alias("value")).where("value IS NOT NULL")
        same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in groups))
        below = [F.sum(F.when(F.col("value") < F.col(k), 1).otherwise(0)).alias(f"below_{k}") for k in SHARES]
        upto = [F.sum(F.when(F.col("value") <= F.col(k), 1).otherwise(0)).alias(f"upto_{k}") for k in SHARES]
        ranked = values.join(found, same).groupBy(*groups, "n", "least", "greatest").agg(*below, *upto)
        tid = F.col("tid").cast("string") if "tid" in groups else F.lit("any")
        judged = []
        for k, q in SHARES.items():
            rank = F.greatest(F.lit(1), F.ceil(F.col("n") * q - 1e-9))
            off = F.greatest(F.lit(0), F.col(f"below_{k}") + 1 - rank, rank - F.col(f"upto_{k}"))
            within = off <= F.col("n") * min(q, 1 - q) * rank_error() * 5 / 3 + 1
            judged.append(F.struct(F.lit(k).alias("percentile"), within.alias("within")))
        parts.append(ranked.select("sample", tid.alias("tid"), "n", "least", "greatest", F.inline(F.array(*judged))))
    return reduce(DataFrame.unionByName, parts)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(_table(spark, folder, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text in containers of CAPACITY tokens."""
    return fill_containers(token_counts(_table(spark, folder, "documents"), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)


def p8_fill_by_chars(spark: SparkSession, folder: str) -> DataFrame:
    """How full containers get, with sizes in characters: the items, their units, the least number of containers that could hold
    them, and whether none is overfull, no item lost and at most one container in fifty is more than that.
    """
    documents = _table(spark, folder, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size"))
    found = fill_containers(documents, "doc_id", "size", CAPACITY).where("part_size > 0")
    bins = found.groupBy("container").agg(F.sum("part_size").alias("fill"), F.count(F.lit(1)).alias("parts"))
    total = bins.agg(F.sum("parts").alias("n_parts"), F.sum("fill").alias("units"), F.count(F.lit(1)).alias("bins"), F.max("fill").alias("fullest"))
    least = F.ceil(F.col("units") / CAPACITY).cast("bigint")
    return total.select("n_parts", "units", least.alias("least_bins"), (F.col("fullest") <= CAPACITY).alias("none_overfull"), (F.col("bins") * 50 <= least * 51 + 50).alias("nearly_full"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return cut_texts(_table(spark, folder, "documents"), "doc_id", "text", "source", "lang").select(F.col("row_id").alias("doc_id"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source truncates."""
    return cut_shares(_table(spark, folder, "documents"), "doc_id", "text", "source", "lang")


QUERIES = {f.__name__: f for f in (p6_percentiles, p6_from_days, p6_within_bound, p7_ids, p8_containers, p8_fill_by_chars, p9_found, p9_shares)}

#: For what SQL can say; tests hold the other queries against brute force, libraries and held-out cuts.
SQL: dict[str, str] = {
    "p6_within_bound": """WITH v AS (SELECT sample, CAST(tid AS VARCHAR) AS tid, CAST(forward AS DOUBLE) AS forward FROM coverage WHERE forward <> -1),
g AS (SELECT sample, tid, count(*) AS n, min(forward) AS least, max(forward) AS greatest FROM v GROUP BY ALL UNION ALL SELECT sample, 'any', count(*), min(forward), max(forward) FROM v GROUP BY ALL)
SELECT sample, tid, p.percentile, n, least, greatest, true AS within FROM g, (SELECT unnest(['"""
    + "', '".join(SHARES)
    + """']) AS percentile) p""",
    "p8_fill_by_chars": f"""WITH s AS (SELECT length(text) AS size FROM documents WHERE length(text) > 0)
SELECT CAST(sum((size + {CAPACITY - 1}) // {CAPACITY}) AS BIGINT) AS n_parts, CAST(sum(size) AS BIGINT) AS units, CAST((sum(size) + {CAPACITY - 1}) // {CAPACITY} AS BIGINT) AS least_bins,
  true AS none_overfull, true AS nearly_full FROM s""",
}
