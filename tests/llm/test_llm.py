"""Encoding, percentiles, containers and truncation against brute force, libraries and held-out cuts."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tidespan.llm import plans
from tidespan.llm.containers import fill_containers, fullest, plan_bins
from tidespan.llm.quantiles import Sketch, merge_sketches, percentiles, rank_error, read_percentiles, sketch_groups
from tidespan.llm.tokens import VOCABULARIES, Encoder, RankQueue, encode_texts, load_vocabulary, token_counts
from tidespan.llm.truncation import _count_contexts, cut_shares, cut_texts, final_part, learn_tails, length_limits, open_ends, score_ends, tail_kind

# encoding


@pytest.fixture(scope="module")
def encoder():
    return Encoder(load_vocabulary())


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    found = tokenizers.Tokenizer.from_file(os.path.join(VOCABULARIES, "byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text(alphabet="ab c'\n\t1é漢😀", max_size=60)))
def test_encoding_equals_the_library(encoder, library, text):
    assert list(encoder.encode(text)) == library(text)


def test_long_words_and_special_strings(encoder, library):
    rng = random.Random(1)
    for text in ("a" * 5000, "ab" * 4000, "".join(rng.choice("etaoinshr") for _ in range(20_000)), "漢字" * 900, " " * 3000 + "x", "<|endoftext|> <|endoftext|>", "\x00�﻿"):
        assert list(encoder.encode(text)) == library(text)


def test_rank_queue_pops_in_order():
    rng = random.Random(2)
    queue, held = RankQueue(50_000), Counter()
    for _ in range(2000):
        rank, place = rng.choice([0, 63, 64, 4095, 4096, 49_999, rng.randrange(50_000)]), rng.randrange(100)
        queue.push(rank, place)
        held[rank] += 1
    ranks = []
    while queue.top:
        rank, places = queue.pop()
        ranks.append(rank)
        assert places == sorted(places) and len(places) == held[rank]
    assert ranks == sorted(held)


def test_encode_table(spark, library):
    texts = ["Hello world", "", None, "  ", "Hello world", "x" * 300_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    want = [(i, library(t) if t else []) for i, t in enumerate(texts)]
    assert rows(encode_texts(df, "doc_id", "text")) == sorted(want, key=repr)
    assert rows(token_counts(df, "doc_id", "text")) == sorted([(i, len(x)) for i, x in want], key=repr)
    assert encode_texts(df.limit(0), "doc_id", "text").collect() == []


# percentiles


def _error(values, share, found):
    low, high = np.searchsorted(values, found, "left") + 1, np.searchsorted(values, found, "right")
    rank = max(1, math.ceil(share * len(values)))
    return 0 if low <= rank <= high else min(abs(low - rank), abs(high - rank))


@pytest.mark.parametrize("high", [True, False])
@pytest.mark.parametrize("kind", ["heavy", "sorted", "reversed", "ties"])
def test_rank_error_is_relative_to_the_tail(kind, high):
    rng = np.random.default_rng(4)
    n = 200_000
    values = {"heavy": rng.lognormal(0, 4, n), "sorted": np.arange(n) * 1.0, "reversed": np.arange(n)[::-1] * 1.0, "ties": rng.integers(0, 30, n) * 1.0}[kind]
    total = None
    for i, part in enumerate(np.array_split(values, 13)):
        s = Sketch(high=high, seed=i)
        s.update(part)
        s = Sketch.from_bytes(s.to_bytes())
        if total is None:
            total = s
        else:
            total.merge(s)
    assert total.n == n and sum(len(c.values) << h for h, c in enumerate(total.levels)) == n
    assert sum(len(c.values) for c in total.levels) < 6000
    ordered = np.sort(values)
    shares = [0.0001, 0.001, 0.01, 0.1, 0.5, 0.9, 0.99, 0.999, 0.9999]
    for share, found in zip(shares, total.quantiles(shares)):
        beyond = (1 - share if high else share) * n
        assert _error(ordered, share, found) <= rank_error() * beyond + 1
    assert total.quantiles([0.0, 1.0]) == [ordered[0], ordered[-1]]


def test_small_groups_are_exact_and_parts_combine(spark):
    rng = random.Random(6)
    data = [(rng.choice(["a", "b", None]), rng.randrange(4), rng.choice([None, float("nan"), -1.0, *[float(rng.randrange(50))] * 8]), "x") for _ in range(900)] + [("none", 0, None, "x")]
    df = spark.createDataFrame(data, "g string, day int, v double, raw string").repartition(3)
    value = F.when(F.col("v") != -1, F.col("v"))
    shares = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    want = []
    for g in ("a", "b", None):
        x = sorted(v for k, _, v, _ in data if k == g and v is not None and not math.isnan(v) and v != -1)
        at = lambda q: x[max(1, math.ceil(q * len(x))) - 1]  # noqa: B023, E731
        want.append((g, len(x), x[0], at(0.1), at(0.5), at(0.99), x[-1]))
    if all(w[1] < 190 for w in want):
        assert rows(percentiles(df, ["g"], value, shares)) == sorted(want, key=repr)
    days = sketch_groups(df, ["g", "day"], value)
    merged = {r["g"]: r for r in read_percentiles(days, ["g"], shares).collect()}
    for g, n, *_, last in want:
        assert (merged[g]["n"], merged[g]["greatest"]) == (n, last)
    assert {r["g"]: r["n"] for r in merge_sketches(days, ["g"]).collect()} == {w[0]: w[1] for w in want}
    assert percentiles(df.limit(0), ["g"], value, shares).collect() == []


def test_order_of_sketches_does_not_matter(spark):
    df = spark.range(60_000, numPartitions=8).select(F.lit("g").alias("g"), (F.col("id") % 8).alias("day"), (F.col("id") * 7919 % 60_000).cast("double").alias("v"))
    days = spark.createDataFrame(sketch_groups(df, ["g", "day"], F.col("v")).collect(), "g string, day bigint, n bigint, sketch binary")
    shares = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    orders = [days.orderBy("day").coalesce(1), days.orderBy(F.desc("day")).coalesce(1), days.repartition(5, "day")]
    assert len({tuple(read_percentiles(o, ["g"], shares).first()) for o in orders}) == 1


def test_hot_group_in_many_splits(spark):
    df = spark.range(300_000, numPartitions=70).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), F.col("id").cast("double").alias("v"))
    found = {r["g"]: r for r in percentiles(df, ["g"], F.col("v"), {"p50": 0.5, "p999": 0.999}).collect()}
    assert found["hot"]["n"] == 100_000 and abs(found["hot"]["p50"] - 150_000) < 300_000 * rank_error() * 0.5 and abs(found["hot"]["p999"] - 299_700) < 10


def test_both_tails_of_the_queries_keep_the_bound(spark, monkeypatch):
    n = 200_000
    value = F.col("id") * 7919 % n
    data = spark.range(n, numPartitions=4).select(F.lit(None).cast("string").alias("sample"), F.lit("x").alias("name"), F.lit(1).alias("tid"), (F.col("id") % 3).alias("run_day"), value.cast("double").alias("bam_mean"), value.alias("forward"))
    monkeypatch.setattr(plans, "_table", lambda spark, folder, name: data)
    found = plans.p6_percentiles(spark, "").collect() + plans.p6_from_days(spark, "").collect()
    assert len(found) == 3
    for r in found:
        assert (r["n"], r["least"], r["greatest"]) == (n, 0, n - 1)
        for k, share in plans.SHARES.items():
            assert abs(r[k] - (share * n - 1)) <= rank_error() * min(share, 1 - share) * n + 1


# containers


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 5), min_size=1, max_size=6))
def test_fullest_combination(histogram):
    lengths, capacity = sorted(histogram, reverse=True), 20
    chosen = fullest(lengths[0], lengths, histogram, capacity)
    reach = {lengths[0]}
    for length, n in histogram.items():
        for _ in range(n - (length == lengths[0])):
            reach |= {r + length for r in reach}
    assert sum(k * v for k, v in chosen.items()) == max(r for r in reach if r <= capacity)
    assert all(v <= histogram[k] for k, v in chosen.items())


def test_plan_uses_every_item_once():
    rng = random.Random(7)
    histogram = dict(Counter(rng.choice([1, 5, 700, rng.randrange(1, 1001)]) for _ in range(5000)))
    slots, bins = plan_bins(histogram, 1000)
    fill, used = Counter(), Counter()
    for s in slots:
        for i in range(s.first, s.last):
            fill[s.bin + (i - s.first) // s.each] += s.length
            used[s.length] += 1
    assert used == Counter(histogram) and max(fill.values()) <= 1000 and set(fill) == set(range(bins))
    least = max(sum(k * v for k, v in histogram.items()) / 1000, sum(v for k, v in histogram.items() if k > 500))
    assert bins <= 1.02 * least + 1


@pytest.mark.parametrize("ranked", [None, 7])
def test_fill_containers(spark, monkeypatch, ranked):
    if ranked:
        monkeypatch.setattr("tidespan.llm.containers._RANKED", ranked)
    rng = random.Random(8)
    sizes = [rng.choice([None, 0, -3, 100, 250, 33, rng.randrange(1, 101)]) for _ in range(700)]
    df = spark.createDataFrame([(i, s, 5) for i, s in enumerate(sizes)], "id bigint, size_of bigint, part int").repartition(3)
    found = fill_containers(df, "id", "size_of", 100).collect()
    parts, fill = Counter(), Counter()
    for r in found:
        parts[r["id"]] += r["part_size"]
        fill[r["container"]] += r["part_size"]
        assert r["part_start"] == 100 * r["part"] and (sizes[r["id"]] or 0) > 100 or r["part"] == 0
    assert set(parts) == set(range(700)) and all(parts[i] == max(0, s or 0) for i, s in enumerate(sizes))
    assert max(fill.values()) <= 100 and len(fill) == max(fill) + 1 <= sum(fill.values()) / 100 * 1.02 + 1
    assert len({(r["id"], r["part"]) for r in found}) == len(found)


def test_containers_of_nothing(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "id bigint, n bigint")
    assert {r["container"] for r in fill_containers(df, "id", "n", 10).collect()} == {0}
    assert fill_containers(df.limit(0), "id", "n", 10).collect() == []
    with pytest.raises(ValueError):
        fill_containers(df, "id", "n", 0)


# truncation

_SUBJECTS = ["The night shift", "A careful clerk", "Our field team", "The river station", "The old pump", "The green alga"]
_VERBS = ["records", "replaces", "covers", "finds", "moves"]
_OBJECTS = ["the small filter", "the weather mast", "the frozen cells", "the empty crates", "the depth report", "the blue notebook"]
_PLACES = ["on the upper floor", "with great patience", "after heavy rain", "in the cold room", "at the end of the month"]


def _sentence(rng):
    return f"{rng.choice(_SUBJECTS)} {rng.choice(_VERBS)} {rng.choice(_OBJECTS)} {rng.choice(_PLACES)}"


def _corpus(n, seed):
    """Texts with the kind of their end: whole, unmarked, title or cut."""
    rng, out = random.Random(seed), []
    for i in range(n):
        text = ". ".join(_sentence(rng) for _ in range(rng.choice([1, 2, 3])))
        kind = rng.choice(["whole"] * 12 + ["unmarked", "title", "cut", "limit"])
        source = f"s{i % 4}"
        if kind == "whole":
            text += rng.choice([".", "!", ". ", ". [3]", ".”"])
        elif kind == "unmarked":
            text += rng.choice(["", "…", " "])
        elif kind == "title":
            text = f"{rng.choice(_OBJECTS).capitalize()}: {rng.choice(_SUBJECTS).lower()}"
        elif kind == "cut":
            text = text[: len(text) - rng.randrange(2, 40)].rstrip() + rng.choice(["", "…", "\x00\x00", " <lost>", "�"])
        else:
            source, text = "limited", ". ".join(_sentence(rng) for _ in range(8))[:200]
        out.append((i, text, source, "en", kind))
    return out


def test_held_out_cuts_are_found(spark):
    data = _corpus(4000, 9)
    df = spark.createDataFrame(data, "id bigint, text string, source string, lang string, kind string").repartition(4)
    limits = rows(length_limits(df, "text", "source"))
    assert ("limited", "chars", 200) in [x[:3] for x in limits]
    found = {r["row_id"] for r in cut_texts(df, "id", "text", "source", "lang").collect()}
    by = {k: [i for i, _, _, _, kind in data if kind == k] for k in ("whole", "unmarked", "title", "cut", "limit")}
    share = {k: sum(i in found for i in v) / len(v) for k, v in by.items()}
    assert share["whole"] == 0 and share["unmarked"] < 0.03 and share["title"] < 0.05 and share["cut"] > 0.9 and share["limit"] > 0.85
    shares = {r["source"]: r for r in cut_shares(df, "id", "text", "source", "lang").collect()}
    assert shares["limited"]["share"] > 0.85 and sum(r["n_texts"] for r in shares.values()) == 4000


@pytest.mark.parametrize("copies", [1, 10, 1000])
def test_copies_of_a_cut_text_are_no_witnesses(spark, copies):
    data = _corpus(2000, 12)
    cuts = {"long": "The river station records the small filter with gre", "short": "Our field team rec"}
    # a short text in several sources may be a title
    data += [(f"{k} {i}", text, f"s{i % 4}" if k == "long" else "s1", "en", "copy") for k, text in cuts.items() for i in range(copies)]
    df = spark.createDataFrame([(str(i), *rest) for i, *rest in data], "id string, text string, source string, lang string, kind string").repartition(4)
    found = {r["row_id"] for r in cut_texts(df, "id", "text", "source", "lang").collect()}
    assert {i for i in found if " " in i} == {f"{k} {i}" for k in cuts for i in range(copies)}
    # nor do they make others cut
    by = {k: [str(i) for i, _, _, _, kind in data if kind == k] for k in ("whole", "unmarked", "title", "cut")}
    share = {k: sum(i in found for i in v) / len(v) for k, v in by.items()}
    assert share["whole"] == 0 and share["unmarked"] < 0.03 and share["title"] < 0.05 and share["cut"] > 0.9


def test_null_and_repeated_ids_are_listed_as_often_as_they_come(spark):
    rest = [(i, f"The old pump moves the empty crates {_sentence(random.Random(i))}.", "s", "en") for i in range(40)]
    cut = "The night shift records the small fil"
    data = [*rest, *[(50, cut, "s", "en")] * 3, (None, cut, "s", "en"), (None, "A careful clerk covers the fro", "t", "en")]
    df = spark.createDataFrame(data, "id bigint, text string, source string, lang string")
    assert rows(score_ends(df, "id", "text", "source", "lang"), "row_id", "source") == sorted([(50, "s")] * 3 + [(None, "s"), (None, "t")], key=repr)
    assert all(r["n_cut"] <= r["n_texts"] for r in cut_shares(df, "id", "text", "source", "lang").collect())


def test_unseen_tails_are_learned(spark):
    rng = random.Random(21)
    data = []
    for i, text, source, lang, kind in _corpus(4000, 20):
        # words that no pattern knows, after finished texts and after cut ones
        if kind in ("whole", "cut") and rng.random() < 0.3:
            text, kind = text.rstrip("…\x00� ").removesuffix(" <lost>") + rng.choice([" relayed by gate 7", " fin 81", "\nstop record"]), f"{kind} with tail"
        data.append((i, text, source, lang, kind))
    df = spark.createDataFrame(data, "id bigint, text string, source string, lang string, kind string").repartition(4)
    assert {"relayed by gate 0", "fin 0", "stop record"} <= learn_tails(df, "text")
    found = {r["row_id"] for r in cut_texts(df, "id", "text", "source", "lang").collect()}
    by = {k: [i for i, _, _, _, kind in data if kind == k] for k in {d[4] for d in data}}
    share = {k: sum(i in found for i in v) / len(v) for k, v in by.items()}
    assert share["whole with tail"] < 0.02 and share["cut with tail"] > 0.9 and share["cut"] > 0.9 and share["title"] < 0.05


def test_first_words_of_cut_sentences_are_no_tails(spark):
    texts = [f"{_sentence(random.Random(i))}. {_sentence(random.Random(i + 1))}." for i in range(300)] + [f"{_sentence(random.Random(i))}. {w}" for i in range(40) for w in ("The", "Th", "Our field")]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert learn_tails(df, "text") == frozenset() and learn_tails(df.limit(0), "text") == frozenset()


def test_blocks_of_contexts_count_alike(spark):
    df = spark.createDataFrame(_corpus(400, 3), "id bigint, text string, source string, lang string, kind string").repartition(3)
    opens = open_ends(df, "id", "text", "source", "lang").cache()
    wanted = {h for r in opens.collect() for h in r["contexts"]}
    counts = [{r["h"]: r[1:] for r in _count_contexts(df, "text", "lang", opens, most)[0].select("h", "ends", "goes_on").collect() if r["h"] in wanted} for most in (28, 9)]
    assert counts[0] == counts[1] and len(counts[0]) > 500
    totals = [rows(_count_contexts(df, "text", "lang", opens, most)[1]) for most in (28, 9)]
    assert totals[0] == totals[1]


def test_copies_make_no_limit(spark):
    df = spark.createDataFrame([("s", "A title")] * 1000 + [("s", f"{'x' * (i % 20)} {i % 7}") for i in range(60)], "source string, text string")
    assert length_limits(df, "text", "source").collect() == []


def test_odd_texts(spark):
    texts = [None, "", "  \n", "…", "\x00", "Done.", "Done.", "12.5", "x" * 100_000, "（完）。", "A cut te", "A cut te"]
    df = spark.createDataFrame([(i, t, None if i % 2 else "s", None, "x") for i, t in enumerate(texts)], "id bigint, text string, source string, lang string, tail string")
    found = {r["row_id"]: r for r in score_ends(df, "id", "text", "source", "lang").collect()}
    assert set(found) == {7, 8, 10, 11}
    assert found[10]["log_odds"] == found[11]["log_odds"]
    assert cut_texts(df.limit(0), "id", "text", "source", "lang").collect() == []
    assert cut_texts(df.where("id < 5"), "id", "text", "source", "lang").collect() == []


def test_what_was_appended():
    cases = {"It ends… more": "It ends", "a b [...]": "a b", "a b\x00\x00": "a b", "a b \n--": "a b", "a b <connection closed>": "a b", "Done. (ok)": "Done.", "Done. #run7": "Done.", "the (x)": "the (x)", "a 75.48": "a 75.48", "a b...": "a b", "✔": "", "a, b,": "a, b,", "a b &am": "a b", "a b ~EOT": "a b", "a b, and\nEND OF BLOCK 7": "a b, and", "a (": "a"}
    assert {k: final_part(k)[0] for k in cases} == cases
    assert tail_kind(" [read 12 more]") == " [a 0 a]" and tail_kind("\x00\x00\x00") == "\x00"
