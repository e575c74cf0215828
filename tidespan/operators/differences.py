"""Field-by-field differences between two copies of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A field to compare. ``left`` and ``right``: the columns (default: ``name``); ``within``: numbers no further apart are equal."""

    name: str
    left: str | None = None
    right: str | None = None
    within: float | None = None


def differences(left: DataFrame, right: DataFrame, keys: dict[str, Column], fields: list[Field], latest: str, *, left_name: str = "left", right_name: str = "right") -> DataFrame:
    """The keys on one side only and those whose values differ.

    ``keys``: name -> normalised expression, the same for both sides. Where a side holds a
    key more than once, its row with the latest ``latest`` counts; among equals (null is
    earliest) the row with the greatest compared values. Result: the keys, ``missing``
    (``missing_in_<side>`` or null) and ``diffs``, an array of (field, left_value,
    right_value), values as strings; rows without a difference aren't listed.

    Defined cases: a null key value matches a null; a null field equals only a null; a NaN
    equals only a NaN; an empty table on one side lists every key of the other; further
    columns are ignored, whatever their names.

    Each side is reduced to a row per key before and after its one shuffle, and joined
    where that shuffle put it.
    """
    names = list(keys)
    one, two = _current(left, keys, [f.left or f.name for f in fields], latest), _current(right, keys, [f.right or f.name for f in fields], latest)
    # plain equality on the padded keys keeps each side's partitioning; null-safe equality would not
    on = [F.col(f"one.{c}") == F.col(f"two.{c}") for i in range(len(names)) for c in (f"k{i}", f"k{i}_null")]
    both = one.alias("one").join(two.alias("two"), on, "full_outer")
    found = []
    for i, f in enumerate(fields):
        a, b = F.col(f"one.row.v{i}"), F.col(f"two.row.v{i}")
        found.append(F.when(_differs(a, b, f.within), F.struct(F.lit(f.name).alias("field"), a.cast("string").alias("left_value"), b.cast("string").alias("right_value"))))
    lacks_left, lacks_right = F.col("one.row").isNull(), F.col("two.row").isNull()
    kind = "array<struct<field:string,left_value:string,right_value:string>>"
    return (
        both.select(
            *(F.when(~F.coalesce(F.col(f"one.k{i}_null"), F.col(f"two.k{i}_null")), F.coalesce(F.col(f"one.k{i}"), F.col(f"two.k{i}"))).alias(k) for i, k in enumerate(names)),
            F.when(lacks_left, f"missing_in_{left_name}").when(lacks_right, f"missing_in_{right_name}").alias("missing"),
            F.when(lacks_left | lacks_right, F.array().cast(kind)).otherwise(F.array_compact(F.array(*found)).cast(kind)).alias("diffs"),
        )
        .where(F.col("missing").isNotNull() | (F.size("diffs") > 0))
    )


def difference_rows(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row per difference of ``differences``: the keys and ``diff``, the side that lacks the key or the field."""
    names = F.when(F.col("missing").isNotNull(), F.array("missing")).otherwise(F.transform("diffs", lambda d: d["field"]))
    return found.select(*keys, F.explode(names).alias("diff"))


def _current(df: DataFrame, keys: dict[str, Column], values: list[str], latest: str) -> DataFrame:
    slim = df.select(*(e.alias(f"key{i}") for i, e in enumerate(keys.values())), F.col(latest).alias("latest"), F.struct(*(F.col(c).alias(f"v{i}") for i, c in enumerate(values))).alias("row"))
    padded = []
    for i in range(len(keys)):
        key = F.col(f"key{i}")
        padded += [F.coalesce(key, _zero(slim.schema[f"key{i}"].dataType)).alias(f"k{i}"), key.isNull().alias(f"k{i}_null")]
    best = F.max(F.struct("latest", "row")).getField("row").alias("row")
    return slim.select(*padded, "latest", "row").groupBy(*(c for i in range(len(keys)) for c in (f"k{i}", f"k{i}_null"))).agg(best)


def _zero(kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit("").cast(kind)
    return (F.lit(0) if isinstance(kind, (T.NumericType, T.BooleanType)) else F.lit("1970-01-01")).cast(kind)


def _differs(a: Column, b: Column, within: float | None) -> Column:
    if within is None:
        return ~a.eqNullSafe(b)
    apart = F.when(F.isnan(a) | F.isnan(b), ~(F.isnan(a) & F.isnan(b))).when(a == b, F.lit(False)).otherwise(F.abs(a - b) > within)
    return F.when(a.isNull() | b.isNull(), ~(a.isNull() & b.isNull())).otherwise(apart)
