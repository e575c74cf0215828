"""Expressions on regions: names, attributes, overlap, normalised counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def default_name(name: Column, chrom: Column, start: Column, stop: Column) -> Column:
    """The name, or ``chrom:start-stop`` where it is null or empty."""
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), stop.cast("string")))


def attribute(attributes: Column, key: str, separator: str = ";", *, prefix: bool = False) -> Column:
    """The value of ``key`` among GFF3 (``key=value``) or GTF (``key "value"``) attributes; null if it isn't there.

    ``prefix``: any attribute that begins with ``key`` matches, the first wins.
    """
    parts = F.transform(F.split(attributes, _literal(separator)), lambda x: F.trim(F.regexp_replace(x, "[\"']", "")))
    if prefix:
        hit = F.filter(parts, lambda x: x.startswith(key))
        return F.nullif(F.trim(F.regexp_extract(F.get(hit, 0), r"^[^=\s]*[=\s]\s*(.*)$", 1)), F.lit(""))
    hit = F.filter(parts, lambda x: x.startswith(f"{key}=") | x.startswith(f"{key} "))
    return F.nullif(F.trim(F.substring(F.get(hit, 0), len(key) + 2, 1 << 30)), F.lit(""))


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in text)


def overlap(start: Column, stop: Column, other_start: Column, other_stop: Column) -> Column:
    """Positions in both intervals, 0 if they don't meet."""
    return F.greatest(F.lit(0), F.least(stop, other_stop) - F.greatest(start, other_start))


def rpkm(counts: Column, total_reads: Column, length: Column) -> Column:
    """Counts per million reads and thousand positions; null over an empty length or without reads."""
    return counts.cast("double") / F.nullif(total_reads / F.lit(1e6), F.lit(0.0)) / F.nullif(length / F.lit(1e3), F.lit(0.0))


def per_million(counts: Column, mapped_reads: Column) -> Column:
    return counts.cast("double") / F.nullif(mapped_reads / F.lit(1e6), F.lit(0.0))


def per_position(counts: Column, length: Column) -> Column:
    return counts.cast("double") / F.nullif(length.cast("double"), F.lit(0.0))


def fixed(value: Column, precision: int = 3) -> Column:
    """A number as text with ``precision`` decimals."""
    return F.format_string(f"%.{int(precision)}f", value.cast("double"))


def size_in_bases(text: str) -> int:
    """A size with an optional suffix K, M, G or T, in thousands."""
    text = text.strip().upper()
    factor = {"K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12}.get(text[-1:], 1)
    return int(float(text.rstrip("KMGT")) * factor)


class Bands:
    """Labelled bands of depth from breaks such as ``"2,4"``: 0-1, 2-3, 4-."""

    def __init__(self, breaks: str):
        try:
            found = {int(x) for x in breaks.split(",")}
        except ValueError:
            raise ValueError(f"breaks are whole numbers, not {breaks!r}") from None
        if any(x < 0 for x in found):
            raise ValueError("breaks aren't negative")
        self.lows = sorted(found | {0})
        self.labels = [f"{a}-{b - 1}" for a, b in zip(self.lows, self.lows[1:])] + [f"{self.lows[-1]}-"]

    def label(self, depth: Column) -> Column:
        out = F.lit(self.labels[0])
        for low, label in zip(self.lows[1:], self.labels[1:]):
            out = F.when(depth >= low, label).otherwise(out)
        return out
