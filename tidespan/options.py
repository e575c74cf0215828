"""Options of the reading and writing side, checked where they are given."""

from __future__ import annotations

from dataclasses import dataclass

#: Unmapped, secondary, failed quality control, duplicate.
DEFAULT_FLAG_MASK = 4 | 256 | 512 | 1024
SPAN_FUNCTIONS = ("max", "min", "mean")


@dataclass(frozen=True)
class InputOptions:
    """Which alignments count and what interval each covers.

    ``physical``: the fragment of a pair instead of the read; ``fragment_length``: the end is
    start plus this many positions, whatever the read's own length (0: the read's end);
    ``overhang``: ``clamp`` cuts reads at the reference's end, ``error`` raises on them;
    ``require_sorted``: the column that holds the table's order; raise on a read that counts and
    starts before its predecessor in it.
    """

    min_mapq: int = 0
    flag_mask: int = DEFAULT_FLAG_MASK
    physical: bool = False
    fragment_length: int = 0
    overhang: str = "clamp"
    require_sorted: str | None = None

    def __post_init__(self):
        if not 0 <= self.min_mapq <= 255:
            raise ValueError("min_mapq is 0 to 255")
        if not 0 <= self.flag_mask <= 65535:
            raise ValueError("flag_mask is 0 to 65535")
        if self.fragment_length < 0:
            raise ValueError("fragment_length is not negative")
        if self.overhang not in ("clamp", "error"):
            raise ValueError("overhang is clamp or error")


#: What the older counting tool lets through: the threshold is not looked at, and quality 0 never counts.
COMPAT_COUNTS = InputOptions(min_mapq=1)


@dataclass(frozen=True)
class OutputOptions:
    """How depth is written: ``span`` 0 gives runs, else one ``op`` value a span."""

    stranded: bool = False
    quantize: str | None = None
    span: int = 0
    op: str = "max"
    report_low: int | None = None

    def __post_init__(self):
        if self.span < 0:
            raise ValueError("a span is not negative")
        if self.op not in SPAN_FUNCTIONS:
            raise ValueError(f"op is one of {', '.join(SPAN_FUNCTIONS)}")
        if self.quantize is not None and self.span:
            raise ValueError("spans aren't quantised")
