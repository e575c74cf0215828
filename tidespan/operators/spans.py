"""Depth over fixed spans of each reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidespan.options import SPAN_FUNCTIONS

#: Spans that one run is spread over at a time.
_CUT = 4096


def span_summary(runs: DataFrame, refs: DataFrame, span: int, op: str = "max", *, columns: list[str] | None = None, partial: str = "nominal") -> DataFrame:
    """``sample, tid, span, start, stop`` and the ``op`` of each depth column over spans of ``span`` positions.

    A mean divides by ``span`` even where the reference ends within it (``partial="actual"``
    divides by what is there). A run is spread over at most the spans it touches, by stretches
    of ``_CUT`` of them, so that no run becomes one long array; runs of zero depth only over
    the first and last, as the spans between hold nothing else and are zero. Spans that only
    zero runs touch are thus not listed unless a run begins or ends there; ``fill_spans``
    lists them.
    """
    if op not in SPAN_FUNCTIONS:
        raise ValueError(f"op is one of {', '.join(SPAN_FUNCTIONS)}")
    if span < 1:
        raise ValueError("a span has at least one position")
    columns = columns or ["cov"]
    first, last = F.expr(f"start div {span}"), F.expr(f"(stop - 1) div {span}")
    silent = F.lit(True)
    for c in columns:
        silent = silent & (F.col(c) == 0)
    inside = runs.where(F.col("start") < F.col("stop")).select("sample", "tid", "start", "stop", *columns, silent.alias("silent"), first.alias("first"), last.alias("last"))
    spread = spread_spans(inside, F.col("silent"))
    low, high = F.greatest("start", F.col("span") * span), F.least("stop", (F.col("span") + 1) * span)
    known = refs.groupBy("tid").agg(F.max("length").alias("length"))
    if op == "mean":
        parts = [F.sum(F.col(c) * (high - low)).alias(c) for c in columns]
    else:
        parts = [(F.max if op == "max" else F.min)(c).alias(c) for c in columns]
    out = spread.groupBy("sample", "tid", "span").agg(*parts).join(known, "tid")
    start, stop = F.col("span") * span, F.least((F.col("span") + 1) * span, F.col("length"))
    out = out.select("sample", "tid", "span", start.alias("start"), stop.alias("stop"), *columns)
    if op == "mean":
        size = F.lit(float(span)) if partial == "nominal" else (F.col("stop") - F.col("start")).cast("double")
        out = out.select("sample", "tid", "span", "start", "stop", *((F.col(c).cast("double") / size).alias(c) for c in columns))
    return out


def spread_spans(runs: DataFrame, ends_only: Column | None = None) -> DataFrame:
    """A row for each ``span`` from ``first`` to ``last``, or for these two alone where ``ends_only``."""
    cuts = F.sequence(F.col("first"), F.col("last"), F.lit(_CUT).cast("bigint"))
    within = F.sequence(F.col("cut"), F.least(F.col("last"), F.col("cut") + _CUT - 1))
    if ends_only is not None:
        cuts = F.when(ends_only, F.array_distinct(F.array("first", "last"))).otherwise(cuts)
        within = F.when(ends_only, F.array("cut")).otherwise(within)
    return runs.withColumn("cut", F.explode(cuts)).withColumn("span", F.explode(within)).drop("cut", "first", "last")


def fill_spans(summary: DataFrame, refs: DataFrame, span: int, samples: list[str]) -> DataFrame:
    """``span_summary`` with every span of every reference, zeros where none was listed."""
    columns = [c for c in summary.columns if c not in ("sample", "tid", "span", "start", "stop")]
    every = refs.where(F.col("length") > 0).select("tid", "length", F.explode(F.array(*(F.lit(s).cast("string") for s in samples))).alias("sample"))
    every = spread_spans(every.select("sample", "tid", "length", F.lit(0).cast("bigint").alias("first"), F.expr(f"(length - 1) div {span}").alias("last")))
    start, stop = F.col("span") * span, F.least((F.col("span") + 1) * span, F.col("length"))
    filled = every.join(summary.select("sample", "tid", "span", *columns), ["sample", "tid", "span"], "left")
    return filled.select("sample", "tid", "span", start.alias("start"), stop.alias("stop"), *(F.coalesce(c, F.lit(0).cast(summary.schema[c].dataType)).alias(c) for c in columns))
