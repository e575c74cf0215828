"""Continuous periods of a stream of intervals, kept as an ordered disjoint map per entity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidespan.operators.periods import IntervalMap


def stream_periods(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Changes to the periods and gaps per entity ``keys`` of a streaming ``start, stop``.

    Each batch gives, for the entities it touches, the rows that vanished (``change`` -1)
    and those that are new (1): keys, kind, start, stop, change. Summed over batches they
    are the result of ``merge_intervals``. Rows in any order; nulls and empty intervals
    cover nothing. State: the disjoint intervals of each entity.
    """
    kinds = [intervals.schema[k] for k in keys]
    result = T.StructType([*kinds, T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("change", T.IntegerType())])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, changes = IntervalMap(*state.get) if state.exists else IntervalMap(), Counter()
        for rows in batches:
            for a, b in zip(rows["start"].tolist(), rows["stop"].tolist()):
                held.insert(int(a), int(b), changes)
        state.update((held.starts, held.stops))
        yield pd.DataFrame([(*key, *row, change) for row, change in sorted(changes.items()) if change], columns=result.names)

    slim = intervals.select(*keys, F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop")).where(F.col("start").isNotNull() & F.col("stop").isNotNull() & (F.col("start") < F.col("stop")))
    for k in keys:
        slim = slim.where(F.col(k).isNotNull())
    return slim.groupBy(*keys).applyInPandasWithState(run, result, "starts array<bigint>, stops array<bigint>", "append", GroupStateTimeout.NoTimeout)
