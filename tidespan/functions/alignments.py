"""Expressions on alignments: flag bits, CIGAR lengths, names, base qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a SAM flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2, SECONDARY, FAILED, DUPLICATE, SUPPLEMENTARY = (1 << i for i in range(12))


def has_flag(flag: Column, bits: int) -> Column:
    """Whether any of ``bits`` is set."""
    return flag.bitwiseAND(bits) != 0


def is_reverse(flag: Column) -> Column:
    return has_flag(flag, REVERSE)


def _cigar_length(cigar: Column, operations: str) -> Column:
    lengths = F.regexp_extract_all(cigar, F.lit(f"(\\d+)[{operations}]"), F.lit(1))
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda total, x: total + x.cast("bigint"))


def reference_length(cigar: Column) -> Column:
    """Reference positions that an alignment spans; deletions and skips count. Null for null, 0 for ``*``."""
    return _cigar_length(cigar, "MDN=X")


def query_length(cigar: Column) -> Column:
    """Bases of the read that a CIGAR holds."""
    return _cigar_length(cigar, "MIS=X")


def sample_name(path: Column) -> Column:
    """A file's name up to its first dot."""
    return F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"\."), 1)


def sample_name_long(path: Column) -> Column:
    """A file's name without its last dot-part, the other parts joined without dots."""
    parts = F.split(F.element_at(F.split(path, "/"), -1), r"\.")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "")).otherwise(parts[0])


def phred_values(quality: Column) -> Column:
    """Base qualities as an array of numbers from their printable form."""
    return F.transform(F.regexp_extract_all(quality, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c) - 33)


def phred_text(values: Column) -> Column:
    """The printable form of an array of base qualities."""
    return F.array_join(F.transform(values, lambda q: F.char(q + 33)), "")


def swap_strand(flag: Column) -> Column:
    """The flag with the strands of the read and, if paired, of its mate exchanged."""
    turned = flag.bitwiseXOR(REVERSE)
    return F.when(has_flag(flag, PAIRED), turned.bitwiseXOR(MATE_REVERSE)).otherwise(turned)


def flag_bits(flag: Column) -> Column:
    """The twelve bits of a flag as text, highest first."""
    return F.lpad(F.bin(flag), 12, "0")
