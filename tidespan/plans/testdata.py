"""The order tables read as alignments, references and regions, by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REF_LENGTH = 300_000

_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the test data; its schema is looked up once, which is a job of its own."""
    path = f"{folder}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


_table = table


def refs(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "nation").select(F.col("n_nationkey").cast("int").alias("tid"), F.col("n_name").alias("name"), F.lit(REF_LENGTH).cast("bigint").alias("length"))


def alignments(spark: SparkSession, folder: str) -> DataFrame:
    supplier = _table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").cast("int").alias("tid"))
    days = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("bigint")
    order, line, part, supp = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    odd_line = line % 2 == 1
    flag = (
        F.when(order % 2 == 0, F.lit(1) + F.when(order % 4 == 0, 2).otherwise(0) + F.when(odd_line, 64).otherwise(128)).otherwise(0)
        + F.when(F.col("l_linestatus") == "F", 16).otherwise(0)
        + F.when(part % 29 == 0, 4).otherwise(0)
        + F.when(part % 17 == 0, 256).otherwise(0)
        + F.when(part % 19 == 0, 512).otherwise(0)
        + F.when(part % 23 == 0, 1024).otherwise(0)
    )
    start = days * 100 + order % 100
    isize = F.when(order % 2 == 0, (F.lit(200) + supp % 300) * F.when(odd_line, 1).otherwise(-1)).otherwise(0)
    rows = _table(spark, folder, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.col("l_returnflag").alias("sample"),
        flag.cast("int").alias("flag"),
        "tid",
        start.alias("start"),
        (start + 50 + part % 101).cast("bigint").alias("stop"),
        ((order * 7 + line) % 61).cast("int").alias("mapq"),
        isize.cast("bigint").alias("isize"),
    )


def regions(spark: SparkSession, folder: str, *, pooled: bool = False) -> DataFrame:
    key = F.col("p_partkey").cast("bigint")
    start = key * 7919 % 250_000
    name = F.col("p_name") if pooled else F.concat(F.lit("part_"), key.cast("string"))
    return _table(spark, folder, "part").select((key % 25).cast("int").alias("tid"), start.alias("start"), (start + 200 + F.col("p_size") * 10).cast("bigint").alias("stop"), name.alias("name"))


SAMPLES = ["A", "N", "R"]

#: The same relations in SQL, to put before a query.
SQL = """refs AS (SELECT CAST(n_nationkey AS INTEGER) AS tid, n_name AS name, CAST(300000 AS BIGINT) AS length FROM nation),
base AS (SELECT l_returnflag AS sample, CAST(s_nationkey AS INTEGER) AS tid, l_orderkey AS o, l_linenumber AS ln, l_partkey AS p, l_suppkey AS su, l_linestatus AS ls,
  CAST(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) AS BIGINT) * 100 + l_orderkey % 100 AS start FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
aln AS (SELECT sample, tid, start, CAST(start + 50 + p % 101 AS BIGINT) AS stop, CAST((o * 7 + ln) % 61 AS INTEGER) AS mapq,
  CAST(CASE WHEN o % 2 = 0 THEN 1 + CASE WHEN o % 4 = 0 THEN 2 ELSE 0 END + CASE WHEN ln % 2 = 1 THEN 64 ELSE 128 END ELSE 0 END
    + CASE WHEN ls = 'F' THEN 16 ELSE 0 END + CASE WHEN p % 29 = 0 THEN 4 ELSE 0 END + CASE WHEN p % 17 = 0 THEN 256 ELSE 0 END
    + CASE WHEN p % 19 = 0 THEN 512 ELSE 0 END + CASE WHEN p % 23 = 0 THEN 1024 ELSE 0 END AS INTEGER) AS flag,
  CAST(CASE WHEN o % 2 = 0 THEN (200 + su % 300) * CASE WHEN ln % 2 = 1 THEN 1 ELSE -1 END ELSE 0 END AS BIGINT) AS isize FROM base),
reg AS (SELECT CAST(p_partkey % 25 AS INTEGER) AS tid, CAST(p_partkey * 7919 % 250000 AS BIGINT) AS start,
  CAST(p_partkey * 7919 % 250000 + 200 + p_size * 10 AS BIGINT) AS stop, 'part_' || p_partkey AS name, p_name AS pooled FROM part)"""
