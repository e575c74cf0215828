"""Finding texts that were cut by a field limit or broke off in transfer.

A backward character n-gram model says, for the characters before any position, how often a
sentence or text ends there and how often it goes on. A text without a final mark is judged
by its own last characters: the log-odds of an end against a continuation, from the longest
contexts that were seen down to the shortest. The log-odds are held against a threshold that
belongs to the text's language and column (how often anything ends there at all) and to its
group: the source, what was appended, and whether the text is as long as its source allows.
The share of cut texts of a group, and with it the threshold, is estimated from the scores
themselves. Length limits are read off the sources' length histograms.

The model is counted over every position of every text. Only the contexts that some text
ends in are kept: a bitmap tells the splits which. A longer context is only looked up where the
shorter one was there, so false hits of a bitmap that is half full don't add up. Beyond
``BITMAP`` bits the contexts are split into blocks by their shortest part, with a bitmap and a
pass over the texts for each. The counts stay in distributed tables.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidespan.durable import durable

#: Lengths of the contexts, in characters.
ORDERS = (2, 3, 4, 6, 9, *range(12, 33, 2))
#: Weight of a shorter context's estimate, in occurrences.
BACKOFF = 1.5
#: Weight of an end without a final mark, which may be a cut, against one with it.
WITNESS = 0.2
#: log2 of the bits of a bitmap of contexts, at most, and bits for each context.
BITMAP, BITS_EACH = 28, 1.5
#: Occurrences by which a group's share of cut texts leans on that of the wider group.
LEAN = 4.0
#: Log-odds beyond which no context counts, and those under which a text is cut whatever its group.
SURE, LEAST = 11.0, -9.5
#: Share of a context's occurrences from which a longer one is the same evidence.
SAME = 0.8
#: A length is a limit if so many texts have it, so many times the mean of the lengths below.
LIMIT_COUNT, LIMIT_TIMES = 5, 6

_FINAL = ".!?。！？．"
_CLOSING = "\"'”’»›）)]」』】"
_BASE = 0x9E3779B97F4A7C15
_PAD = 2

_ENDED = re.compile(rf"[{re.escape(_FINAL)}][{re.escape(_CLOSING)}]*\Z")
#: Pieces that may follow the end of a text, or a cut: blanks, control and format characters, symbols, dashes.
_SYMBOLS = re.compile(r"(?:[^\w.,;:!?。、，；：！？．()（）「」『』【】\[\]<>\"'“”‘’«»‹›&%/@*+=]|[+*=])+\Z")
_DOTS = re.compile(r"(?:\.{3,}|…+)\s*\Z")
_MORE = re.compile(r"(?:\.{3,}|…)\s*[(\[<]?\s*\w{1,12}(?:\s\w{1,12})?\s*[)\]>]?\Z")
_NOTE = re.compile(r"\s*(?:\[[^\[\]]{0,40}\]|<[^<>\s][^<>]{0,40}>|[\[<({])\Z|\s[~#|\\^$][\w;]{0,12}\Z|&#?\w{0,8}\Z|</?\w{0,12}\Z|\n[A-Z][A-Z0-9 ]{2,30}\Z")
#: A last token that is no word, after a finished sentence.
_TOKEN = re.compile(rf"(?<=[{re.escape(_FINAL + _CLOSING)}])\s*(?:\([^()]{{0,20}}\)|#\S*|\w+://\S*)\Z")


#: Tokens of a learned tail at most, and its characters.
_TAIL_TOKENS, _TAIL_CHARS = 4, 60
#: Different texts that a learned tail must end after a finished sentence, and one in how many rows; the second bounds how
#: many tails there can be.
TAIL_TEXTS, TAIL_SHARE = 5, 20_000
_START = re.compile(rf"[{re.escape(_FINAL)}][{re.escape(_CLOSING)}]*\s+")


def _alike(text: str) -> str:
    """Numbers are alike, and so are blanks."""
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", text))


def _last_tokens(text: str) -> Iterator[tuple[str, str]]:
    """What the text's last one to _TAIL_TOKENS tokens are, and what stands before them."""
    part = text[-_TAIL_CHARS:].rstrip()
    for m in reversed(list(re.finditer(r"\s+\S+", part))[-_TAIL_TOKENS:]):
        yield _alike(part[m.start() :].strip()), text[: len(text) - len(text[-_TAIL_CHARS:]) + m.start()]


def learn_tails(df: DataFrame, text: str) -> frozenset[str]:
    """Endings that are appended to texts, finished ones too, whatever they are about.

    A candidate is a run of last tokens that follows a finished sentence, in TAIL_TEXTS different texts
    and one of TAIL_SHARE. A sentence that was cut after its first word looks the same; but a
    candidate that sentences begin with more often than texts end with it is that.
    """

    def endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails, sames = [], []
            for value, same in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = value.rstrip()
                if whole and not _ENDED.search(whole, max(0, len(whole) - 20)):
                    for tail, before in _last_tokens(whole):
                        if _ENDED.search(before, max(0, len(before) - 20)):
                            tails.append(tail)
                            sames.append(same)
            yield pa.RecordBatch.from_arrays([pa.array(tails, pa.string()), pa.array(sames, pa.int64())], names=["tail", "same"])

    slim = df.where(F.length(text) > 0).select(F.col(text).alias("text"), F.xxhash64(text).alias("same"))
    least = max(TAIL_TEXTS, df.count() // TAIL_SHARE)
    found = slim.mapInArrow(endings, "tail string, same bigint").groupBy("tail").agg(F.count_distinct("same").alias("n")).where(F.col("n") >= least)
    ends = {r["tail"]: r["n"] for r in found.collect()}  # at most _TAIL_TOKENS * TAIL_SHARE
    if not ends:
        return frozenset()
    shipped = df.sparkSession.sparkContext.broadcast(frozenset(ends))

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails, counts = shipped.value, Counter()
        heads, lengths = {t[:1] for t in tails}, sorted({len(t) for t in tails})
        for batch in batches:
            for value in batch.column(0).to_pylist():
                last = len(value.rstrip())
                for m in _START.finditer(value):
                    at = m.end()
                    if at < last and ("0" if value[at].isdigit() else value[at]) in heads:
                        start = _alike(value[at : at + 2 * _TAIL_CHARS])
                        # a tail at the end of its own text is no beginning
                        whole = start.rstrip() if at + 2 * _TAIL_CHARS >= last else None
                        for n in lengths:
                            if (t := start[:n]) in tails and t != whole:
                                counts[t] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["tail", "n"])

    inside = {r["tail"]: r["n"] for r in slim.select("text").mapInArrow(beginnings, "tail string, n bigint").groupBy("tail").agg(F.sum("n").alias("n")).collect()}
    return frozenset(t for t, n in ends.items() if n > inside.get(t, 0))


def final_part(text: str, tails: frozenset[str] = frozenset()) -> tuple[str, str]:
    """A text without what was appended to it, and what that was: forms that no sentence ends in, and learned ``tails``."""
    core = text
    while True:
        if tails:
            before = next((b for tail, b in _last_tokens(core) if tail in tails and b.strip()), None)
            if before is not None:
                core = before
                continue
        for pattern in (_SYMBOLS, _MORE, _DOTS, _NOTE, _TOKEN):
            m = pattern.search(core, max(0, len(core) - 120))
            if m and m.start() < len(core):
                core = core[: m.start()]
                break
        else:
            return core, text[len(core) :]


def tail_kind(tail: str) -> str:
    """What was appended, without the words and numbers in it."""
    kind = re.sub(r"\s+", " ", re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "0", tail)))
    return re.sub(r"(.)\1+", r"\1", kind)[:12]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts, each after a pad as long as the longest context; where they start and end."""
    pad = chr(_PAD) * ORDERS[-1]
    joined = "".join(pad + t for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + ORDERS[-1]) - lengths
    return codes, starts, starts + lengths


def _normal(codes: np.ndarray) -> np.ndarray:
    """Digits are alike, and so are ASCII capitals."""
    out = codes.astype(np.uint64)
    out[(codes >= 48) & (codes <= 57)] = 48
    out[(codes >= 65) & (codes <= 90)] = 65
    return out


def _hashes(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each of ORDERS the hash of the context that ends at each position."""
    total = np.zeros(len(codes), np.uint64)
    for back in range(ORDERS[-1]):
        total[back:] += (codes[: len(codes) - back] + np.uint64(1)) * np.uint64(pow(_BASE, back, 1 << 64))
        if back + 1 in ORDERS:
            yield _mixed(total, back + 1)


def _mixed(total: np.ndarray, order: int) -> np.ndarray:
    mixed = total ^ np.uint64(order * 0x1000193)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def _known_contexts(codes: np.ndarray, at: np.ndarray, wanted: np.ndarray, block: int, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of ORDERS the hashes of the contexts at positions ``at`` that ``wanted`` may hold, and which of ``at`` they are."""
    shift = np.uint64(64 - (len(wanted) * 64).bit_length() + 1)
    total, index = np.zeros(len(at), np.uint64), np.arange(len(at))
    for back in range(ORDERS[-1]):
        total += (codes[at - back] + np.uint64(1)) * np.uint64(pow(_BASE, back, 1 << 64))
        if back + 1 in ORDERS:
            h = _mixed(total, back + 1)
            bit = h >> shift
            hit = (wanted[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
            if blocks > 1 and back + 1 == ORDERS[0]:
                hit &= h.view(np.int64) % blocks == block
            at, total, index = at[hit], total[hit], index[hit]
            yield h[hit], index
            if not len(at):
                return


def open_ends(df: DataFrame, row_id: str, text: str, source: str, lang: str) -> DataFrame:
    """The texts that end without a final mark: what they end in, and what was appended (``learn_tails``, ``final_part``).

    Columns: row_id, source, language, tail, contexts (a hash for each of ORDERS), same (a
    hash of the text), chars, bytes (their lengths without replacement characters at the end),
    core_chars, core_bytes (without what was appended).
    """
    schema = T.StructType(
        [
            T.StructField("row_id", df.schema[row_id].dataType),
            *(T.StructField(c, T.StringType()) for c in ("source", "language", "tail")),
            T.StructField("contexts", T.ArrayType(T.LongType())),
            *(T.StructField(c, T.LongType()) for c in ("same", "chars", "bytes", "core_chars", "core_bytes")),
        ]
    )

    known = learn_tails(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cores, tails, sizes = [], [], [], []
            for i, value in enumerate(batch.column(3).to_pylist()):
                core, tail = final_part(value, known)
                if core and not _ENDED.search(core, max(0, len(core) - 20)):
                    at.append(i)
                    cores.append(core[-2 * ORDERS[-1] :])
                    tails.append(tail_kind(tail))
                    whole = value.rstrip("�")
                    sizes.append((len(whole), len(whole.encode("utf-8", "replace")), len(core), len(core.encode("utf-8", "replace"))))
            if not at:
                continue
            # a core that was shortened here is longer than any context, so its pad isn't reached
            codes, _, ends = _codes(cores)
            last = np.stack([h[ends - 1] for h in _hashes(_normal(codes))], axis=1).view(np.int64)
            contexts = pa.ListArray.from_arrays(pa.array(np.arange(0, last.size + 1, len(ORDERS), dtype=np.int32)), pa.array(last.ravel()))
            take = pa.array(at)
            ids, sources, languages, sames = (batch.column(c).take(take) for c in (0, 1, 2, 4))
            yield pa.RecordBatch.from_arrays([ids, sources, languages, pa.array(tails), contexts, sames, *(pa.array(x) for x in np.array(sizes, np.int64).T)], names=[f.name for f in schema])

    slim = df.where(F.col(text).isNotNull()).select(F.col(row_id).alias("row_id"), F.col(source).cast("string").alias("source"), language(F.col(lang)).alias("language"), F.col(text).alias("text"), F.xxhash64(text).alias("same"))
    return slim.mapInArrow(run, schema)


def language(lang: Column) -> Column:
    """A language code without region and script; ``und`` for null."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(lang, "^[A-Za-z]{2,3}", 0)), F.lit("")), F.lit("und"))


def _bitmap(opens: DataFrame, bits: int, block: int, blocks: int) -> np.ndarray:
    """The contexts of a block as a bitmap of 2**``bits`` bits."""
    hashed = opens.where(F.pmod(F.col("contexts")[0], F.lit(blocks)) == block).select(F.explode("contexts").alias("h"))
    word, bit = F.shiftrightunsigned("h", 64 - bits + 6), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 AS int))")
    # at most 2 ** (bits - 6) rows
    words = hashed.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bitmap.view(np.uint64)


def _count_contexts(df: DataFrame, text: str, lang: str, opens: DataFrame, most: int = BITMAP) -> tuple[DataFrame, DataFrame]:
    """How often each context of ``opens`` ends before a final mark and how often it goes on; both in total by language."""
    contexts = opens.select(F.explode("contexts").alias("h")).agg(F.approx_count_distinct("h")).first()[0]
    bits = min(most, max(16, math.ceil(math.log2(BITS_EACH * contexts + 1)) + 3))
    blocks = max(1, math.ceil(BITS_EACH * contexts / (1 << bits)))
    slim = df.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(text).alias("text"), language(F.col(lang)).alias("language"))
    parts = [slim.mapInArrow(_counter(slim, _bitmap(opens, bits, b, blocks), b, blocks), "h bigint, ends bigint, goes_on bigint, language string") for b in range(blocks)]
    counted = durable(reduce(DataFrame.unionByName, parts).groupBy("h", "language").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on")))
    return counted.where("h IS NOT NULL").drop("language"), counted.where("h IS NULL").drop("h")


class _Held:
    """Counts by context of what a split has seen since it last gave them out."""

    def __init__(self):
        self.keys, self.ends, self.total = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def rows(self) -> int:
        return len(self.keys)

    def add(self, h: np.ndarray, ends: np.ndarray, total: np.ndarray) -> None:
        own, keys = pd.factorize(np.concatenate([self.keys, h]))
        sums = [np.bincount(own, weights=np.concatenate([a, b]), minlength=len(keys)).astype(np.int64) for a, b in ((self.ends, ends), (self.total, total))]
        self.keys, self.ends, self.total = keys, *sums

    def batch(self) -> pa.RecordBatch:
        """What is held, which is let go."""
        out = pa.RecordBatch.from_arrays([pa.array(self.keys.view(np.int64)), pa.array(self.ends), pa.array(self.total - self.ends), pa.nulls(self.rows, pa.string())], names=["h", "ends", "goes_on", "language"])
        self.__init__()
        return out


#: Bits of a character's class: final mark, closing mark, blank, final mark without a blank after it, not to be judged, point.
_MARK, _CLOSE, _BLANK, _WIDE, _LOST, _POINT = (np.uint8(1 << i) for i in range(6))


def _classes() -> np.ndarray:
    out = np.zeros(1 << 16, np.uint8)
    for chars, bit in ((_FINAL, _MARK), (_CLOSING, _CLOSE), ("\u3000\u00a0", _BLANK), ([c for c in _FINAL if ord(c) > 0x3000], _WIDE), ("\u2026\ufffd", _LOST), (".", _POINT)):
        for c in chars:
            out[ord(c)] |= bit
    out[:33] |= _BLANK
    out[-1] = 0  # stands for all beyond
    return out


def _counter(df: DataFrame, bitmap: np.ndarray, block: int, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shipped = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, classes, held = shipped.value, _classes(), _Held()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            low, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t) + ORDERS[-1]
                if size > 250_000 or i + 1 == len(texts):
                    yield from count(texts[low : i + 1], batch.column(1).slice(low, i + 1 - low).to_pylist(), wanted, classes, held)
                    low, size = i + 1, 0
        yield held.batch()

    def count(texts: list[str], languages: list[str], wanted: np.ndarray, classes: np.ndarray, held: _Held) -> Iterator[pa.RecordBatch]:
        codes, starts, ends = _codes(texts)
        n = len(codes)
        kind = classes[np.minimum(codes, len(classes) - 1)]
        after, then = np.append(kind[1:], np.uint8(0)), np.append(kind[2:], np.zeros(2, np.uint8))[:n]
        ended = (after & _MARK > 0) & ((then & (_BLANK | _CLOSE) > 0) | (after & _WIDE > 0))
        closed = (kind & _MARK > 0) | ((kind & _CLOSE > 0) & np.append(False, (kind & (_MARK | _CLOSE) > 0)[:-1]))
        unclear = (after & _LOST > 0) | ((after & then & _POINT) > 0) | closed
        inside = np.zeros(n + 1, np.int32)
        np.add.at(inside, starts, 1)
        np.add.at(inside, np.maximum(ends - 1, starts), -1)  # what a text's last character means isn't known
        valid = (np.cumsum(inside)[:n] > 0) & ~unclear & (codes > 32)
        at = np.flatnonzero(valid)
        ends_here = ended[at]
        found = list(_known_contexts(_normal(codes), at, wanted, block, blocks))
        h, ends_at = np.concatenate([h for h, _ in found]), ends_here[np.concatenate([i for _, i in found])]
        held.add(h, ends_at.astype(np.int64), np.ones(len(h), np.int64))
        if held.rows > 1_000_000:
            yield held.batch()
        if block == 0:
            own, names = pd.factorize(np.array(languages, object))
            of = own[np.searchsorted(starts, at, "right") - 1]
            total = np.bincount(of, minlength=len(names))
            stop = np.bincount(of, weights=ends_here, minlength=len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(names), pa.int64()), pa.array(stop), pa.array(total - stop), pa.array(list(names), pa.string())], names=["h", "ends", "goes_on", "language"])

    return run


def length_limits(df: DataFrame, text: str, source: str) -> DataFrame:
    """The length limits that the sources' histograms show: source, unit (``chars`` or ``bytes``), limit, n, by_chance.

    A limit is a length of at least LIMIT_COUNT texts, LIMIT_TIMES as many as the mean of the
    20 lengths below, with at most a quarter as many longer texts. Copies of a text in a source
    count as one.
    """
    whole = F.regexp_replace(F.col(text), "�+$", "")
    different = df.where(F.length(text) > 1).groupBy(F.col(source).cast("string").alias("source"), F.xxhash64(text).alias("same")).agg(F.first(F.length(whole)).alias("chars"), F.first(F.octet_length(whole)).alias("bytes"))
    lengths = different.select("source", F.explode(F.create_map(F.lit("chars"), "chars", F.lit("bytes"), "bytes")).alias("unit", "size"))
    by = Window.partitionBy("source", "unit").orderBy("size")
    counts = lengths.groupBy("source", "unit", "size").agg(F.count(F.lit(1)).alias("n"))
    near = counts.withColumn("below", F.coalesce(F.sum("n").over(by.rangeBetween(-20, -1)), F.lit(0)) / 20).withColumn("above", F.coalesce(F.sum("n").over(Window.partitionBy("source", "unit").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    enough = (F.col("n") >= LIMIT_COUNT) & (F.col("n") >= LIMIT_TIMES * F.greatest("below", F.lit(0.2))) & (F.col("above") <= F.col("n") / 4)
    return near.where(enough).select("source", "unit", F.col("size").cast("bigint").alias("limit"), "n", F.col("below").alias("by_chance"))


def _shares(scored: DataFrame, keys: list[str], prior: Column) -> DataFrame:
    """The share of cut texts in each group of ``keys``, by expectation-maximisation over a histogram of the scores; copies of a text count as one."""
    binned = scored.groupBy(*keys, F.round(F.col("against") * 4).cast("int").alias("bin")).agg(F.count_distinct("same").alias("n"), F.first(prior).alias("prior"))
    fields = [binned.schema[k] for k in keys]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        odds = np.exp(group["bin"].to_numpy() / 4)
        n, lean = group["n"].to_numpy(), float(group["prior"].iloc[0])
        share = lean
        for _ in range(60):
            cut = share * odds / (share * odds + 1 - share)
            share = min(max(((cut * n).sum() + LEAN * lean) / (n.sum() + LEAN), 1e-4), 1 - 1e-4)
        return group.head(1)[keys].assign(share=share)

    return binned.groupBy(*keys).applyInPandas(fit, T.StructType([*fields, T.StructField("share", T.DoubleType())]))


def score_ends(df: DataFrame, row_id: str, text: str, source: str, lang: str) -> DataFrame:
    """Every text without a final mark: row_id, source, language, tail, at_limit, log_odds (of an end), threshold, cut.

    ``log_odds`` is that of an end against a continuation in the text's last context; the
    text is ``cut`` where it lies under ``threshold``. Texts not listed ended properly, or
    hold nothing. See ``cut_texts`` for the defined cases.
    """
    opens = durable(open_ends(df, row_id, text, source, lang))
    counted, by_language = _count_contexts(df, text, lang, opens)

    overall = by_language.agg(F.log((F.sum("ends") + 1) / (F.sum("goes_on") + 50)).alias("usual")).first()["usual"] or -4.0
    # few languages; one of few positions leans on all
    usual = by_language.groupBy("language").agg(F.log((F.sum("ends") + 50 * math.exp(overall)) / (F.sum("goes_on") + 50)).alias("usual"))
    unmarked = opens.count() / max(1, df.count())
    known = durable(
        opens.join(usual, "language", "left")
        .join(_limits_by_source(df, text, source, unmarked), "source", "left")
        .select("row_id", "source", F.coalesce("source", F.lit("")).alias("source_key"), "language", "tail", "same", "chars", "contexts", F.coalesce("usual", F.lit(overall)).alias("usual"), F.coalesce(_pile_up(), F.lit(0.0)).alias("pile_up"))
        .withColumn("at_limit", F.col("pile_up") > 0)
    )
    # texts that were cut are no witnesses of an end: what the first round finds weighs less in the second
    first = _round(known.withColumn("weight", F.lit(1.0)), counted)
    # by text, as ids may be null or repeated
    whole = first.groupBy("same").agg(F.avg(1 - F.col("probability")).alias("weight"))
    second = _round(durable(known.join(whole, "same").select(*known.columns, "weight")), counted)
    return second.select("row_id", "source", "language", "tail", "at_limit", "log_odds", "threshold", (F.col("log_odds") < F.col("threshold")).alias("cut"))


def _limits_by_source(df: DataFrame, text: str, source: str, unmarked: float) -> DataFrame:
    """For each source its limits of either unit, and how many of the unmarked texts as long as that are there by the limit."""
    limits = length_limits(df, text, source)
    beyond = F.col("n") - F.col("by_chance")
    share = beyond / (beyond + unmarked * F.greatest("by_chance", F.lit(0.2)))
    entry = F.struct(F.col("limit"), share.alias("share"))
    return limits.groupBy("source").agg(F.collect_list(F.when(F.col("unit") == "chars", entry)).alias("chars_limits"), F.collect_list(F.when(F.col("unit") == "bytes", entry)).alias("bytes_limits"))


def _pile_up() -> Column:
    """The greatest share of a limit that a text reaches; a character that was cut in two shortens it by up to three bytes."""
    chars = F.filter("chars_limits", lambda x: (x["limit"] == F.col("chars")) | (x["limit"] == F.col("core_chars")))
    width = lambda c, x: F.col(c).between(x["limit"] - 3, x["limit"])
    size = F.filter("bytes_limits", lambda x: width("bytes", x) | width("core_bytes", x))
    return F.array_max(F.transform(F.concat(chars, size), lambda x: x["share"]))


def _round(known: DataFrame, counted: DataFrame) -> DataFrame:
    """One round of scores: row_id, same, source, language, tail, at_limit, log_odds, threshold, probability (of a cut)."""
    # all copies of a text are one witness, as it may have been cut once and copied then; a text no longer than a context
    # (a title, say) is one for each source that has it, at any number of copies; a text is none for itself
    texts = known.groupBy("same").agg(F.first("contexts").alias("contexts"), F.count_distinct("source_key").alias("sources"), F.first("chars").alias("chars"), F.avg("weight").alias("weight"))
    witnesses = F.when(F.col("chars") <= ORDERS[-1], F.col("sources")).otherwise(1) * F.col("weight")
    own = texts.select(F.explode("contexts").alias("h"), witnesses.alias("n")).groupBy("h").agg((WITNESS * F.greatest(F.lit(0.0), F.sum("n") - 1)).alias("others"))
    model = own.join(counted, "h", "left").select("h", (F.col("others") + F.coalesce("ends", F.lit(0))).alias("ends"), F.coalesce("goes_on", F.lit(0)).cast("double").alias("goes_on"))
    last = F.col("contexts")[len(ORDERS) - 1]
    distinct = known.select(last.alias("context"), "contexts").dropDuplicates(["context"])
    seen = distinct.select("context", F.posexplode("contexts").alias("order", "h")).join(model, "h")
    chain = F.array_sort(F.collect_list(F.struct("order", "ends", "goes_on")))

    def step(state: Column, x: Column) -> Column:
        # a longer context that was seen nearly as often says the same again: it takes the shorter one's place
        total = x["ends"] + x["goes_on"]
        base = F.when(total >= SAME * state["total"], state["base"]).otherwise(state["p"])
        return F.struct(((x["ends"] + BACKOFF * base) / (total + BACKOFF)).alias("p"), base.alias("base"), total.alias("total"))

    start = F.struct(F.lit(0.02).alias("p"), F.lit(0.02).alias("base"), F.lit(1e18).alias("total"))
    rare = 1 / (1 + math.exp(SURE))
    p = F.greatest(F.lit(rare), F.least(F.lit(1 - rare), F.aggregate(chain, start, step)["p"]))
    log_odds = seen.groupBy("context").agg(F.log(p / (1 - p)).alias("log_odds"))

    scored = durable(known.withColumn("context", last).join(log_odds, "context").drop("contexts", "context", "chars").withColumn("against", F.col("usual") - F.col("log_odds")))
    free = scored.where(~F.col("at_limit"))
    wide = _shares(free.withColumn("all", F.lit(0)), ["all"], F.lit(0.3)).first()
    kind = _shares(free, ["tail"], F.lit(wide["share"] if wide else 0.3)).withColumnRenamed("share", "wide")
    group = _shares(free.join(kind, "tail"), ["source_key", "tail"], F.col("wide"))
    # where a limit is reached, the histogram of lengths says how many are cut
    share = F.when(F.col("at_limit"), F.greatest(F.lit(0.5), F.least(F.lit(1 - 1e-4), F.col("pile_up")))).otherwise(F.col("share"))
    prior = F.log(share / (1 - share))
    odds = F.exp(F.col("against") + prior)
    return scored.join(group, ["source_key", "tail"], "left").select("row_id", "same", "source", "language", "tail", "at_limit", "log_odds", F.greatest(F.col("usual") + prior, F.lit(LEAST)).alias("threshold"), (odds / (1 + odds)).alias("probability"))


def cut_texts(df: DataFrame, row_id: str, text: str, source: str, lang: str) -> DataFrame:
    """The rows whose text was cut within a word or sentence: row_id, source.

    Defined cases: null, empty and blank texts are no cases, nor are texts of symbols alone;
    repeated texts are judged alike, each row listed; a null source or language is one of its
    own; texts may be of any length; an empty table gives no rows; further columns are ignored.
    """
    return score_ends(df, row_id, text, source, lang).where("cut").select("row_id", "source")


def cut_shares(df: DataFrame, row_id: str, text: str, source: str, lang: str) -> DataFrame:
    """How often each source truncates: source, n_texts (all rows), n_cut, share."""
    cut = cut_texts(df, row_id, text, source, lang).groupBy("source").agg(F.count(F.lit(1)).alias("n_cut"))
    every = df.groupBy(F.col(source).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n_texts"))
    n_cut = F.coalesce(F.col("cut.n_cut"), F.lit(0))
    return every.alias("every").join(cut.alias("cut"), F.col("every.source").eqNullSafe(F.col("cut.source")), "left").select("every.source", "n_texts", n_cut.alias("n_cut"), (n_cut / F.col("n_texts")).alias("share"))
