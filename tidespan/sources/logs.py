"""Benchmark logs: one small file for each run, its name telling the dataset and the tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """``dataset, tool, seconds, kilobytes`` of files named ``mem.DATASET.TOOL.txt`` in a folder.

    Lines are ``elapsed time:<tab>SECONDS`` and ``peak rss:<tab>KILOBYTES``; others are passed over,
    and -1 stands for what a file lacks. Parts of the name between the dataset and the last dot
    make the tool, joined by ``-``.
    """
    files = spark.read.option("pathGlobFilter", "mem.*").text(path, wholetext=True)
    parts = F.split(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.")
    found = lambda key, kind: F.coalesce(F.nullif(F.regexp_extract("value", rf"(?m)^\s*{key}:\t\s*([0-9.]+)\s*$", 1), F.lit("")).try_cast(kind), F.lit(-1).cast(kind))
    return files.select(
        F.get(parts, 1).alias("dataset"),
        F.array_join(F.slice(parts, F.lit(3), F.size(parts) - 3), "-").alias("tool"),
        found("elapsed time", "double").alias("seconds"),
        found("peak rss", "bigint").alias("kilobytes"),
    )


def benchmark_matrix(runs: DataFrame, value: str, tools: list[str]) -> DataFrame:
    """One row per dataset, one column per tool; null where a tool has no run of a dataset."""
    return runs.groupBy("dataset").agg(*(F.max(F.when(F.col("tool") == t, F.col(value))).alias(t) for t in tools))
