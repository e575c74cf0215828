"""Splitting strings that pack several values, each by its cheapest dialect.

A dialect is a delimiter and a set of quotes. Every candidate dialect of a string is
parsed and scored by minimum description length: the bits of its values under codes
learned from the whole column, plus the bits of its separators. The codes are counts of
value shapes in ``BUCKETS`` hashed buckets, gathered over every row by a distributed sum,
so the model has a fixed size whatever the data.

With a ``Grammar`` a dialect must read a string as values of that grammar, so dialects that
parse agree on the values and the cheapest only names how they are packed. Without one
(``FREE``) any piece between two delimiters is a value, and the codes alone decide where a
string is cut.

What a dialect costs depends on a string's shape (``shape_of``) up to a term that all its
dialects share, so each split scores a shape once, and parses a string once, in its cheapest
dialect.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 4096
DELIMITERS = ";,|/\t "
#: The dialect in which anything between two values separates them.
ANY = "any"
#: Bits of a delimiter, of a padding blank, of another separator and of a dialect's name.
_DELIMITER_BITS, _BLANK_BITS, _OTHER_BITS, _NAME_BITS = 1.0, 2.0, 5.0, math.log2(len(DELIMITERS) + 2)


@dataclass(frozen=True)
class Grammar:
    """What a value may be: a run of ``chars`` (a regex class), or, in one of ``quotes``, anything with that quote doubled."""

    chars: str
    quotes: str = ""

    @property
    def scanner(self) -> re.Pattern:
        return _scanner(self)

    @property
    def run(self) -> re.Pattern:
        return _run(self)


NAMES = Grammar("A-Za-z0-9._-", "\"'")
NUMBERS = Grammar("0-9")
#: Any text between delimiters is a value, blanks around it aside; double quotes protect delimiters.
FREE = Grammar("", "\"")
#: Shapes whose scores a split keeps.
_KEPT = 1 << 14


@lru_cache
def _scanner(g: Grammar) -> re.Pattern:
    return re.compile("|".join([*(f"{q}(?:[^{q}]|{q}{q})*{q}" for q in g.quotes), f"[{g.chars}]+"]))


@lru_cache
def _alike(g: Grammar) -> list[tuple[re.Pattern, str]]:
    """Runs of characters that no dialect tells apart, and what stands for them."""
    classes = (("A-Za-z", "A"), ("0-9", "9"))
    return [(re.compile(f"[{c}]+"), x) for c, x in classes if g == FREE or re.fullmatch(f"[{g.chars}]+", x)]


def shape_of(text: str, g: Grammar) -> str:
    """``text`` with each run of letters or digits that the grammar allows in a value as one character."""
    for pattern, x in _alike(g):
        text = pattern.sub(x, text)
    return text


@lru_cache
def _run(g: Grammar) -> re.Pattern:
    return re.compile(f"[{g.chars}]+")


@lru_cache
def _edges(g: Grammar) -> re.Pattern:
    """What may surround a value in a piece: neither part of a value nor a quote."""
    return re.compile(f"[^{g.quotes}{g.chars}]*")


@lru_cache
def _cutter(delimiter: str, quotes: str) -> re.Pattern:
    quoted = "".join(f"{q}(?:[^{q}]|{q}{q})*{q}|" for q in quotes)
    return re.compile(rf"(?:{quoted}[^{re.escape(delimiter)}])+")


def _unquote(value: str, quotes: str) -> str:
    q = value[:1]
    return value[1:-1].replace(q + q, q) if q and q in quotes else value


def parse(text: str, delimiter: str, quotes: str, grammar: Grammar) -> tuple[list[str], float] | None:
    """The values of ``text`` in a dialect and the bits of its separators; None if a piece is no value.

    ``delimiter``: one of DELIMITERS, "" for a single value, or ANY.
    """
    if grammar == FREE:
        return _parse_free(text, delimiter, quotes)
    if delimiter == ANY:
        found = grammar.scanner.findall(text)
        rest = len(text) - sum(map(len, found))
        return [_unquote(v, grammar.quotes) for v in found], rest * _OTHER_BITS
    if not delimiter:
        pieces = [text]
    elif any(q in text for q in quotes):
        pieces = _cutter(delimiter, quotes).findall(text)
    else:
        pieces = text.split(delimiter)
    values, bits = [], max(0, len(pieces) - 1) * _DELIMITER_BITS
    edges, run, scanner = _edges(grammar), grammar.run, grammar.scanner
    for piece in pieces:
        if run.fullmatch(piece):
            values.append(piece)
            continue
        low = edges.match(piece).end()
        core = piece[low : len(piece) - edges.match(piece[::-1]).end()] if low < len(piece) else ""
        blanks = min(len(piece) - len(piece.strip()), len(piece) - len(core))
        bits += blanks * _BLANK_BITS + (len(piece) - len(core) - blanks) * _OTHER_BITS
        if not core:
            bits += _OTHER_BITS
        elif run.fullmatch(core):
            values.append(core)
        elif core[0] in quotes and (m := scanner.match(core)) and m.end() == len(core):
            values.append(_unquote(core, quotes))
        else:
            return None
    return values, bits


def _parse_free(text: str, delimiter: str, quotes: str) -> tuple[list[str], float] | None:
    if delimiter == ANY:
        return None
    pieces = [text] if not delimiter else _free_pieces(text, delimiter, quotes)
    values, bits = [], (len(pieces) - 1) * _DELIMITER_BITS
    for piece in pieces:
        core = piece.strip()
        bits += (len(piece) - len(core)) * _BLANK_BITS
        if not core:
            bits += _OTHER_BITS
            continue
        q = core[0]
        if q in quotes and (len(core) < 2 or core[-1] != q or core[1:-1].replace(q + q, "").count(q)):
            return None
        values.append(_unquote(core, quotes))
    return values, bits


def _free_pieces(text: str, delimiter: str, quotes: str) -> list[str]:
    """``text`` cut at the delimiters that stand outside quotes; empty pieces too."""
    if not quotes:
        return text.split(delimiter)
    pieces, at, inside = [], 0, ""
    for i, c in enumerate(text):
        if inside:
            inside = "" if c == inside else inside
        elif c in quotes:
            inside = c
        elif c == delimiter:
            pieces.append(text[at:i])
            at = i + 1
    return [*pieces, text[at:]]


def dialects(text: str, grammar: Grammar) -> list[tuple[str, str]]:
    """The candidate dialects of ``text``: (delimiter, quotes)."""
    used = "".join(q for q in grammar.quotes if q in text)
    quotes = [""] + ([used] if used else []) + (list(used) if len(used) > 1 else [])
    return [(d, q) for d in ("", *(d for d in DELIMITERS if d in text)) for q in quotes] + [(ANY, grammar.quotes)]


@lru_cache(maxsize=1 << 16)
def _bucket(shape: str) -> int:
    return crc32(shape.encode()) % BUCKETS


_DIGITS, _LETTERS = re.compile("[0-9]+"), re.compile("[A-Za-z]+")


def _shape(value: str) -> tuple[int, float]:
    """The bucket of a value's shape, and the bits of its characters given the shape."""
    shape = _LETTERS.sub("A", _DIGITS.sub("9", value))
    return _bucket(shape), 5.0 * len(value)


def candidates(text: str, grammar: Grammar) -> list[tuple[str, list[str], float]]:
    """Each dialect that parses ``text``: its name, its values, the bits of all but the value shapes."""
    return [c[:3] for c in _candidates(text, grammar)]


def _candidates(text: str, grammar: Grammar) -> list[tuple[str, list[str], float, str, str]]:
    out = []
    for delimiter, quotes in dialects(text, grammar):
        if (got := parse(text, delimiter, quotes, grammar)) is not None:
            name = {"": "single", "\t": "tab", " ": "blank"}.get(delimiter, delimiter) + (f" quote {quotes}" if quotes and delimiter != ANY else "")
            out.append((name, got[0], got[1] + _NAME_BITS + len(quotes), delimiter, quotes))
    return out


def learn(df: DataFrame, column: str, grammar: Grammar) -> np.ndarray:
    """Bits of each shape bucket, from the values of every row in every dialect that parses it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, shapes = np.zeros(BUCKETS), Counter()

        def settle() -> None:
            for shape, n in shapes.items():
                found = candidates(shape, grammar)
                for _, values, _ in found:
                    for v in values:
                        weight[_shape(v)[0]] += n / len(found)
            shapes.clear()

        for batch in batches:
            shapes.update(shape_of(text, grammar) for text in batch.column(0).to_pylist())
            if len(shapes) > _KEPT:
                settle()
        settle()
        at = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(weight[at])], names=["bucket", "weight"])

    rows = df.select(column).where(F.col(column).isNotNull()).mapInArrow(count, "bucket int, weight double").groupBy("bucket").agg(F.sum("weight").alias("weight")).collect()
    total = np.full(BUCKETS, 0.5)
    for r in rows:
        total[r["bucket"]] += r["weight"]
    return -np.log2(total / total.sum())


def cheapest(shape: str, grammar: Grammar, bits: list[float]) -> tuple[str, str, str] | None:
    """The dialect of least cost for strings of a shape: its name, delimiter and quotes; None if none parses them.

    The bits of a value's characters count all but what a dialect leaves out, which is the
    same for each string of the shape.
    """
    best, least = None, math.inf
    for name, values, cost, delimiter, quotes in _candidates(shape, grammar):
        for v in values:
            bucket, own = _shape(v)
            cost += bits[bucket] + own
        if cost < least:
            best, least = (name, delimiter, quotes), cost
    return best


def split_packed(df: DataFrame, row_id: str, column: str, grammar: Grammar) -> DataFrame:
    """One row per value of each string: ``row_id``, ``pos`` (from 1), ``item``, ``n_items``, ``dialect``.

    Defined cases: repeated rows (same id and string) count once; a null, empty or blank
    string, or one without a value, gives no rows; an unclosed quote separates like any
    other character (with ``FREE`` it belongs to its value); a value in quotes is given without them and may be empty; strings may
    be of any length; an empty table gives no rows; further columns are ignored.

    Of dialects that cost the same, the first of ``dialects`` is taken.
    """
    code = learn(df, column, grammar)
    kind = df.schema[row_id].dataType
    schema = T.StructType([T.StructField("row_id", kind), T.StructField("pos", T.LongType()), T.StructField("item", T.StringType()), T.StructField("n_items", T.LongType()), T.StructField("dialect", T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = code.tolist()
        best = lru_cache(_KEPT)(lambda shape: cheapest(shape, grammar, bits))
        for batch in batches:
            take, pos, items, n, names = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = best(shape_of(text, grammar))
                if found is None:
                    continue
                name, delimiter, quotes = found
                values, _ = parse(text, delimiter, quotes, grammar)
                take.extend([i] * len(values))
                pos.extend(range(1, len(values) + 1))
                items.extend(values)
                n.extend([len(values)] * len(values))
                names.extend([name] * len(values))
                if len(items) > 50_000:
                    yield _result(batch, take, pos, items, n, names)
                    take, pos, items, n, names = [], [], [], [], []
            yield _result(batch, take, pos, items, n, names)

    strings = df.select(F.col(row_id).alias("row_id"), F.col(column).alias("text")).where(F.col("text").isNotNull()).distinct()
    return strings.mapInArrow(rows, schema)


def _result(batch: pa.RecordBatch, take: list, pos: list, items: list, n: list, names: list) -> pa.RecordBatch:
    ids = batch.column(0).take(pa.array(take, pa.int64()))
    return pa.RecordBatch.from_arrays([ids, pa.array(pos, pa.int64()), pa.array(items, pa.string()), pa.array(n, pa.int64()), pa.array(names, pa.string())], names=["row_id", "pos", "item", "n_items", "dialect"])
