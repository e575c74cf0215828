"""Depth of a stream of intervals that comes in order, with state in proportion to the depth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidespan.operators.spans import spread_spans
from tidespan.options import SPAN_FUNCTIONS

_RESULT = "sample string, tid int, start bigint, stop bigint, cov bigint"
_STATE = "position bigint, run_start bigint, depth bigint, pending bigint, ends array<bigint>"


def stream_coverage(intervals: DataFrame, *, late: str = "error") -> DataFrame:
    """Maximal runs of depth from a streaming ``sample, tid, start, stop, length``, in append mode.

    Intervals of a (sample, tid) come in order of start across batches; within a batch any
    order will do. A run is given out as soon as a start beyond it was seen. An interval that
    starts before an earlier batch's last start raises, or is left out with ``late="drop"``.
    A sentinel with start = stop = length ends a reference: it flushes the last runs, and
    alone gives an empty reference its run of zero. State: the last start, how many intervals
    begin there, the open run, and the ends of the open intervals. Of a batch, a task holds two
    numbers an interval of its key; ``maxFilesPerTrigger`` of the source bounds them.
    """
    if late not in ("error", "drop"):
        raise ValueError("late is error or drop")

    def sweep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, run_start, depth, pending, ends = state.get if state.exists else (0, 0, 0, 0, [])
        taken = [(rows["start"].to_numpy(np.int64), rows["stop"].to_numpy(np.int64), int(rows["length"].iloc[0])) for rows in batches if len(rows)]
        starts, stops, length = np.concatenate([t[0] for t in taken]), np.concatenate([t[1] for t in taken]), taken[0][2]
        if len(late_starts := starts[starts < before]) and late == "error":
            raise ValueError(f"coverage went backwards on {key}: {late_starts[0]} after {before}")
        stops, starts = stops[starts >= before], starts[starts >= before]
        position = int(starts.max()) if len(starts) else before
        real = starts < stops
        begins = np.concatenate([np.full(pending, before), starts[real]])
        ends = np.concatenate([np.array(ends, np.int64), np.minimum(stops[real], length)])
        # what lies at the last start may still change with the next batch
        done, over = begins < position, ends < position
        at, inverse = np.unique(np.concatenate([begins[done], ends[over]]), return_inverse=True)
        change = np.bincount(inverse, weights=np.concatenate([np.ones(done.sum()), -np.ones(over.sum())]), minlength=len(at)).astype(np.int64)
        at, change = at[change != 0], change[change != 0]
        levels = depth + np.concatenate([[0], np.cumsum(change)])
        edges = np.concatenate([[run_start], at])
        if position == length:
            edges, levels = np.append(edges, length), np.append(levels, 0)
        whole = edges[1:] > edges[:-1]
        state.update((position, int(edges[-1]), int(levels[-1]), int((~done).sum()), [int(e) for e in ends[~over]]))
        yield pd.DataFrame({"sample": key[0], "tid": key[1], "start": edges[:-1][whole], "stop": edges[1:][whole], "cov": levels[:-1][whole]}, columns=["sample", "tid", "start", "stop", "cov"])

    return intervals.groupBy("sample", "tid").applyInPandasWithState(sweep, _RESULT, _STATE, "append", GroupStateTimeout.NoTimeout)


def with_sentinels(intervals: DataFrame, refs: DataFrame, samples: list[str]) -> DataFrame:
    """Intervals and the sentinels that end every reference of every sample."""
    ends = refs.select(F.explode(F.array(*(F.lit(s).cast("string") for s in samples))).alias("sample"), "tid", F.col("length").alias("start"), F.col("length").alias("stop"), "length")
    return intervals.select("sample", "tid", "start", "stop", "length").unionByName(ends)


def stream_spans(runs: DataFrame, span: int, op: str = "max") -> DataFrame:
    """Depth per span of a stream of runs (an aggregation for update or complete mode): sample, tid, span, cov.

    ``op`` is ``max``, ``min`` or ``mean``; a mean divides by ``span``.
    """
    if op not in SPAN_FUNCTIONS:
        raise ValueError(f"op is one of {', '.join(SPAN_FUNCTIONS)}")
    spread = spread_spans(runs.where(F.col("start") < F.col("stop")).select("sample", "tid", "start", "stop", "cov", F.expr(f"start div {span}").alias("first"), F.expr(f"(stop - 1) div {span}").alias("last")))
    part = F.least("stop", (F.col("span") + 1) * span) - F.greatest("start", F.col("span") * span)
    depth = {"max": F.max("cov"), "min": F.min("cov"), "mean": F.sum(F.col("cov") * part).cast("double") / float(span)}[op]
    return spread.groupBy("sample", "tid", "span").agg(depth.alias("cov"))


def stream_to_regions(runs: DataFrame, regions: DataFrame) -> DataFrame:
    """Bases per region name of a stream of runs, joined to a static table of regions."""
    from tidespan.operators.joins import interval_join

    pairs = interval_join(runs.select("tid", "start", "stop", "cov"), regions.select("tid", "start", "stop", "name"), ["tid"])
    meet = F.least("stop", "right_stop") - F.greatest("start", "right_start")
    return pairs.groupBy("name").agg(F.sum(F.col("cov") * meet).alias("bases"))
