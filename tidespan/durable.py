"""Cutting lineage in storage that every executor shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` eagerly into the shared folder, so that a lost executor loses none of it.

    The folder is the session's ``spark.checkpoint.dir``. Only where no folder is set
    and the master is a plain local one (tests) is a temporary folder used.
    """
    _ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared one, for files of one query; it goes when the application's JVM ends."""
    _ensure_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(place)
    store.deleteOnExit(place)
    return folder


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``df`` with a number from 0 in the order of ``order``, without bringing it to one task; ties are numbered in any order."""
    columns = [F.asc_nulls_first(c) for c in order]
    placed = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    # ranges are drawn from samples, so they must stay as they were counted
    kept = durable(placed.withColumn("__row", F.col("__row").bitwiseAND((1 << 33) - 1)))
    sizes = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    # one row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return kept.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__row") + F.col("__before")).drop("__part", "__row", "__before")


def _ensure_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidespan-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
