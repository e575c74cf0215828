"""Relations of the engine. Coordinates are 0-based and half-open."""

from __future__ import annotations

REFS = "tid int, name string, length bigint"
ALIGNMENTS = "sample string, qname string, flag int, tid int, start bigint, stop bigint, mapq int, cigar string, mate_tid int, mate_pos bigint, isize bigint, seq string, qual string"
RAW_REGIONS = "chrom string, start bigint, stop bigint, name string"
REGIONS = "tid int, start bigint, stop bigint, name string"
COVERAGE = "sample string, tid int, start bigint, stop bigint, fwd bigint, rev bigint"
