"""Readers of region, coverage and annotation text files.

Lines are parsed by column expressions. What can't be parsed is left out; ``corrupt`` of the
readers gives those lines instead.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidespan.functions.regions import attribute, default_name
from tidespan.sources.feature_types import FEATURE_TYPES

#: Feature types and keys that name a region, by default.
GFF_TYPE, GFF_ID = "CDS", "ID"
GTF_TYPE, GTF_ID = "exon", "gene_id"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``line``, ``file``, and ``place``, which orders the lines of a file."""
    raw = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return raw.select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), place.alias("place"))


def _number(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^\d{1,18}$"), F.trim(text).cast("bigint"))


def _split_bad(parsed: DataFrame, corrupt: bool, columns: list[str]) -> DataFrame:
    bad = F.col("chrom").isNull() | (F.col("chrom") == "") | F.col("start").isNull() | F.col("stop").isNull() | (F.col("start") > F.col("stop"))
    return parsed.where(bad).select("file", "line") if corrupt else parsed.where(~bad).select(*columns)


def read_bed(spark: SparkSession, path: str, *, corrupt: bool = False) -> DataFrame:
    """``chrom, start, stop, name, score, strand`` of BED files of three or more columns; ``name`` is filled in where empty."""
    data = _lines(spark, path).where(~(F.col("line").rlike(r"^\s*$") | F.col("line").startswith("#") | F.col("line").startswith("track ") | F.col("line").startswith("browser ")))
    f = F.split("line", "\t")
    parsed = data.select("file", "line", F.get(f, 0).alias("chrom"), _number(F.get(f, 1)).alias("start"), _number(F.get(f, 2)).alias("stop"), F.get(f, 3).alias("name"), F.get(f, 4).alias("score"), F.get(f, 5).alias("strand"))
    parsed = parsed.withColumn("name", default_name(F.col("name"), F.col("chrom"), F.col("start"), F.col("stop")))
    return _split_bad(parsed, corrupt, ["chrom", "start", "stop", "name", "score", "strand"])


def _read_annotation(spark: SparkSession, path: str, feature: str | None, key: str, separator: str, prefix: bool, corrupt: bool) -> DataFrame:
    lines = _lines(spark, path)
    # all that follows ##FASTA in a file is sequence
    cut = lines.where(F.col("line").startswith("##FASTA")).groupBy("file").agg(F.min("place").alias("cut"))
    data = lines.join(cut, "file", "left").where(F.col("cut").isNull() | (F.col("place") < F.col("cut"))).where(~(F.col("line").rlike(r"^\s*$") | F.col("line").startswith("#")))
    f = F.split("line", "\t")
    parsed = data.select(
        "file", "line", F.get(f, 0).alias("chrom"), F.get(f, 1).alias("source"), F.get(f, 2).alias("type"), (_number(F.get(f, 3)) - 1).alias("start"), _number(F.get(f, 4)).alias("stop"),
        F.get(f, 5).alias("score"), F.get(f, 6).alias("strand"), F.get(f, 7).alias("phase"), F.coalesce(F.get(f, 8), F.lit("")).alias("attributes"),
    )
    if feature is not None:
        parsed = parsed.where(F.col("type") == feature)
    parsed = parsed.withColumn("name", default_name(attribute(F.col("attributes"), key, separator, prefix=prefix), F.col("chrom"), F.col("start"), F.col("stop")))
    return _split_bad(parsed, corrupt, ["chrom", "start", "stop", "name", "type", "source", "score", "strand", "phase", "attributes"])


def read_gff(spark: SparkSession, path: str, *, feature: str | None = GFF_TYPE, key: str = GFF_ID, separator: str = ";", prefix: bool = False, corrupt: bool = False) -> DataFrame:
    """Features of GFF3 files; ``feature`` None takes every type. Starts are 0-based in the result."""
    return _read_annotation(spark, path, feature, key, separator, prefix, corrupt)


def read_gtf(spark: SparkSession, path: str, *, feature: str | None = GTF_TYPE, key: str = GTF_ID, separator: str = ";", prefix: bool = False, corrupt: bool = False) -> DataFrame:
    """Features of GTF files."""
    return _read_annotation(spark, path, feature, key, separator, prefix, corrupt)


def read_gff_strict(spark: SparkSession, path: str, *, key: str = GFF_ID, known_types: list[str] | None = None) -> DataFrame:
    """Every line of data of GFF3 files with its ``faults``: file, line, chrom, type, start, stop, strand, phase, name, faults.

    Faults: ``header`` (no ``##gff-version`` or ``##sequence-region`` line before it in its file),
    ``columns`` (not nine), ``type`` (none of ``known_types``, default FEATURE_TYPES, nor an ``SO:``
    number), ``bounds`` (no whole numbers, or the start after the end), ``strand``, ``phase``,
    ``attributes`` (a part that isn't one ``key=value``) and ``name`` (no ``key``, or an empty one). Rows without
    faults are the file's features; starts are 0-based. What follows ``##FASTA`` isn't read.
    """
    known = FEATURE_TYPES if known_types is None else known_types
    lines = _lines(spark, path)
    first = lambda *starts: F.min(F.when(reduce(lambda a, b: a | b, (F.col("line").startswith(s) for s in starts)), F.col("place")))
    marks = lines.groupBy("file").agg(first("##FASTA").alias("cut"), first("##gff-version", "##sequence-region").alias("head"))
    data = lines.join(marks, "file").where(F.col("cut").isNull() | (F.col("place") < F.col("cut"))).where(~(F.col("line").rlike(r"^\s*$") | F.col("line").startswith("#")))
    f = F.split("line", "\t")
    field = lambda i: F.coalesce(F.get(f, i), F.lit(""))
    parts = F.split(F.regexp_replace(field(8), ";+$", ""), ";")
    values = F.transform(F.filter(parts, lambda x: x.startswith(f"{key}=")), lambda x: F.substring(x, len(key) + 2, 1 << 30))
    rows = data.select(
        "file", "line", field(0).alias("chrom"), field(2).alias("type"), (_number(field(3)) - 1).alias("start"), _number(field(4)).alias("stop"), field(6).alias("strand"), field(7).alias("phase"),
        F.nullif(F.get(values, 0), F.lit("")).alias("name"), F.size(f).alias("fields"), (F.col("head").isNotNull() & (F.col("head") < F.col("place"))).alias("headed"), F.forall(parts, lambda x: x.rlike("^[^=]*=[^=]*$")).alias("paired"),
    )
    faults = F.array_compact(
        F.array(
            F.when(~F.col("headed"), "header"),
            F.when(F.col("fields") != 9, "columns"),
            F.when(~(F.col("type").isin(known) | F.col("type").startswith("SO:")), "type"),
            F.when(F.col("start").isNull() | F.col("stop").isNull() | (F.col("start") >= F.col("stop")), "bounds"),
            F.when(~F.col("strand").isin("+", "-", "."), "strand"),
            F.when(~F.col("phase").isin("0", "1", "2", "."), "phase"),
            F.when(~F.col("paired"), "attributes"),
            F.when(F.col("name").isNull(), "name"),
        )
    )
    return rows.select("file", "line", "chrom", "type", "start", "stop", "strand", "phase", "name", faults.alias("faults"))


def region_format(path: str, format: str | None = None) -> str:
    """``bed``, ``gff`` or ``gtf`` from a file's name, unless it is given."""
    if format is not None:
        if format not in ("bed", "gff", "gtf"):
            raise ValueError("a region file is bed, gff or gtf")
        return format
    name = os.path.basename(path).lower()
    found = [x for x in ("gff", "gtf") if f".{x}" in name]
    if len(found) > 1:
        raise ValueError(f"say whether {path} is gff or gtf")
    return found[0] if found else "bed"


def read_regions(spark: SparkSession, path: str, format: str | None = None, *, feature: str | None = GFF_TYPE, key: str = GFF_ID, separator: str = ";", prefix: bool = False) -> DataFrame:
    """``chrom, start, stop, name`` of a region file of any format."""
    kind = region_format(path, format)
    if kind == "bed":
        return read_bed(spark, path).select("chrom", "start", "stop", "name")
    read = read_gff if kind == "gff" else read_gtf
    return read(spark, path, feature=feature, key=key, separator=separator, prefix=prefix).select("chrom", "start", "stop", "name")


def read_coverage_bed(spark: SparkSession, path: str, *, corrupt: bool = False) -> DataFrame:
    """``chrom, start, stop, cov`` of coverage text; with ``corrupt`` the lines that aren't four such columns."""
    data = _lines(spark, path).where(~(F.col("line").rlike(r"^\s*$") | F.col("line").startswith("#") | F.col("line").startswith("track ") | F.col("line").startswith("browser ")))
    f = F.split("line", "\t")
    parsed = data.select("file", "line", F.get(f, 0).alias("chrom"), _number(F.get(f, 1)).alias("start"), _number(F.get(f, 2)).alias("stop"), _number(F.get(f, 3)).alias("cov"))
    good = (F.col("chrom") != "") & (F.col("start") <= F.col("stop")) & F.col("cov").isNotNull()
    good = F.coalesce(good, F.lit(False))
    return parsed.where(~good).select("file", "line") if corrupt else parsed.where(good).select("chrom", "start", "stop", "cov")


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """``tid, name, length`` of a table of names and lengths, numbered in the file's order."""
    lines = _lines(spark, path)
    f = F.split("line", r"\s+")
    rows = lines.where(F.size(f) >= 2).select(F.get(f, 0).alias("name"), _number(F.get(f, 1)).alias("length"), "place").where("length is not null")
    return _numbered(rows)


def _numbered(rows: DataFrame) -> DataFrame:
    """A reference dictionary, which one task can number."""
    from pyspark.sql import Window

    return rows.select((F.row_number().over(Window.orderBy("place")) - 1).cast("int").alias("tid"), "name", "length")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``name, description, sequence`` of FASTA files.

    A record begins with a ``>`` that is first in its line; others belong to the header they
    stand in. A sequence is one string, of up to 2**31 - 1 bases.
    """
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"\A\s*>", "").alias("value")).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"\A([^\r\n]*)", 1)
    return records.select(
        F.regexp_extract(head, r"^(\S*)", 1).alias("name"),
        F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"),
        F.regexp_replace(F.regexp_replace("value", r"\A[^\r\n]*", ""), r"\s", "").alias("sequence"),
    )


def read_read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Reads from text with 1-based inclusive bounds and a strand in the fourth column (tabs or blanks): chrom, start, stop, reverse."""
    f = F.split(F.trim("line"), r"\s+")
    data = _lines(spark, path).where(~(F.col("line").rlike(r"^\s*$") | F.col("line").startswith("#")))
    parsed = data.select(F.get(f, 0).alias("chrom"), (_number(F.get(f, 1)) - 1).alias("start"), _number(F.get(f, 2)).alias("stop"), (F.coalesce(F.get(f, 3), F.lit("+")) == "-").alias("reverse"))
    return parsed.where("start is not null and stop is not null and start < stop")
