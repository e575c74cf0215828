"""The table-hygiene operators against brute force and on their defined cases."""

import datetime
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tidespan.operators.dense import dense_aggregate, heavy_keys
from tidespan.operators.differences import Field, difference_rows, differences
from tidespan.operators import packed
from tidespan.operators.packed import FREE, NAMES, NUMBERS, candidates, cheapest, shape_of, split_packed
from tidespan.operators.periods import IntervalMap, merge_intervals
from tidespan.sources.rejects import parse_region_lines, rejected_lines, valid_regions

# dense aggregation


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    data = [(rng.choice([7, 7, 7, 7, 2, -1, None, 10**12]), rng.choice([None, -5, 3, 2**60 // 1000]), "x") for _ in range(3000)]
    return data, spark.createDataFrame(data, "key bigint, v bigint, k string").repartition(5)


@pytest.mark.parametrize("most", [100, 2])
def test_dense_equals_grouping(skewed, most):
    data, df = skewed
    got = {r["key"]: tuple(r)[1:] for r in dense_aggregate(df, "key", {"s": F.col("v")}, {"a": F.col("v")}, {"b": F.col("v")}, max_dictionary=most).collect()}
    groups = defaultdict(list)
    for key, v, _ in data:
        groups[key].append(v)
    want = {}
    for key, values in groups.items():
        known = [v for v in values if v is not None]
        want[key] = (len(values), sum(known), min(known), max(known))
    assert got == want


def test_dense_strings_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 4)], "key string, v bigint")
    assert rows(dense_aggregate(df, "key", {"s": F.col("v")})) == rows(spark.createDataFrame([("a", 2, None), (None, 1, 4)], "key string, n bigint, s bigint"))
    assert dense_aggregate(df.limit(0), "key", {"s": F.col("v")}).collect() == []
    assert dense_aggregate(df.limit(0), "key", max_dictionary=0).collect() == []
    with pytest.raises(ValueError):
        dense_aggregate(df, "key", {"n": F.col("v")})


def test_heavy_keys_count_all_rows(spark):
    df = spark.createDataFrame([(1,)] * 5 + [(2,)] * 4 + [(None,)] * 91, "key int")
    assert rows(heavy_keys(df, "key", 20)) == [(1, 5)]
    assert heavy_keys(df.limit(0), "key", 20).collect() == []


# reject loading

LINES = {
    "chr1\t0\t5": [],
    "﻿chr1\t 0 \t5 \r": [],
    "chr1\t5\t5": ["stop:not_after_start"],
    "chr1\t+1\t5": ["start:invalid_value"],
    "chr1\t1e1\t50": ["start:invalid_value"],
    "chr1\t1\t2.0": ["stop:invalid_value"],
    "chr1\tx\t5": ["start:invalid_value"],
    "chr9\t1\t5": ["chrom:unknown_reference"],
    "chr1\t1\t101": ["stop:beyond_reference"],
    "chr1\t1": ["missing_columns"],
    "chr1\t1\t5\tx": ["too_many_columns"],
    '"chr1"\t"1"\t5': [],
    'chr1"\t1\t5': ["broken_quoting"],
    'chr1\t"1\t5': ["broken_quoting"],
    "chr1\t1\t5\x00": ["control_character"],
    "\t1\t5": ["chrom:unknown_reference"],
    "chr1\t1000000000000000000\t5": ["start:invalid_value", "stop:not_after_start"],
}
SIX = {
    'chr1\t1\t5\t"a ""b""\tc"\t.\t+': [],
    "chr1\t1\t5\t\t01000\t-": [],
    "chr1\t1\t5\t\t1001\t-": ["score:invalid_value"],
    "chr1\t1\t5\t\t\t*": ["score:invalid_value", "strand:invalid_value"],
    "chr1\t1\t5\t" + "x" * 81 + "\t.\t.": ["name:too_long"],
    "chr1\t1\t5\t" + "é" * 80 + "\t.\t.": [],
    "chr1\t1\t5\ta\x7f\t.\t.": ["name:invalid_character"],
    "chr1\t1\t5\ta�\t.\t.": ["name:invalid_character"],
    "chr1\t" + " " * 100_000 + "1\t5\tn\t.\t.": [],
}


def _frames(spark, lines):
    table = spark.createDataFrame([(i, f, i, x, "clash") for i, (f, x) in enumerate(lines)], "line_id bigint, file_no int, line_no bigint, line string, chrom string")
    files = spark.createDataFrame([(1, "a", 3), (2, "b", 6), (2, "b", 6), (4, "c", None)], "file_no int, file_name string, n_cols int")
    refs = spark.createDataFrame([(0, "chr1", 100), (1, None, 5)], "tid int, name string, length bigint")
    return table, files, refs


def test_reasons_of_rejected_lines(spark):
    lines = [(1, x) for x in LINES] + [(2, x) for x in SIX]
    found = {r["line_id"]: sorted(r["reasons"]) for r in parse_region_lines(*_frames(spark, lines)).collect()}
    wanted = {i: sorted(v) for i, v in enumerate([*LINES.values(), *SIX.values()])}
    for i, reasons in wanted.items():
        if "broken_quoting" in reasons or "control_character" in reasons:  # what such a line holds may be at fault too
            assert set(reasons) <= set(found[i])
        else:
            assert found[i] == reasons


def test_comments_blanks_unknown_files_and_repeats(spark):
    lines = [(1, "# x"), (1, "track a"), (1, "browser b"), (1, " \t\r"), (1, ""), (1, None), (1, "﻿#x"), (3, "chr1\t1\t5"), (4, "chr1\t1\t5"), (None, "chr1\t1\t5"), (1, "chr1\t1\t5"), (1, "tracks\t1\t5")]
    table, files, refs = _frames(spark, lines)
    table = table.union(table.where("line_id = 10"))
    parsed = parse_region_lines(table, files, refs)
    assert rows(rejected_lines(parsed), "line_id", "reasons") == sorted([(7, ["unknown_file"]), (8, ["unknown_file"]), (9, ["unknown_file"]), (11, ["chrom:unknown_reference"])], key=repr)
    assert rows(valid_regions(parsed), "line_id", "chrom", "start", "stop", "name") == [(10, "chr1", 1, 5, None)] * 2
    for empty in (parse_region_lines(table.limit(0), files, refs), parse_region_lines(table.where("line_id < 7"), files, refs)):
        assert empty.collect() == []
    assert {r["line_id"] for r in rejected_lines(parse_region_lines(table, files, refs.limit(0))).collect()} == {7, 8, 9, 10, 11}


# intervals


def _periods(intervals):
    out, reach, start = [], None, None
    for a, b in sorted(x for x in intervals if x[0] is not None and x[1] is not None and x[0] < x[1]):
        if reach is None or a > reach:
            if reach is not None:
                out += [("period", start, reach), ("gap", reach, a)]
            start, reach = a, b
        reach = max(reach, b)
    return out + ([("period", start, reach)] if reach is not None else [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20))))
def test_interval_map(intervals):
    held = IntervalMap()
    for a, b in intervals:
        held.insert(a, b)
    found = [("period", a, b) for a, b in zip(held.starts, held.stops)] + [("gap", a, b) for a, b in held.gaps()]
    assert sorted(found) == sorted(_periods(intervals))


@pytest.mark.parametrize("tile_rows", [10**6, 50, 3])
def test_merge_intervals(spark, tile_rows):
    rng = random.Random(tile_rows)
    data = []
    for _ in range(1500):
        key = rng.choice(["hot", "hot", "a", "b", None])
        start = rng.choice([None, *[rng.randrange(3000)] * 30])
        data.append((key, rng.choice([1, 1, 1, 2, None]), start, None if start is None else start + rng.choice([-3, 0, 1, 5, 7, 200 if rng.random() < 0.05 else 4]), "x"))
    df = spark.createDataFrame(data, "name string, id int, start bigint, stop bigint, tile string").repartition(4)
    groups = defaultdict(list)
    for key, i, a, b, _ in data:
        if key is not None and i is not None:
            groups[key, i].append((a, b))
    want = sorted((*k, *p) for k, v in groups.items() for p in _periods(v))
    assert rows(merge_intervals(df, ["name", "id"], tile_rows=tile_rows)) == sorted(want, key=repr)


def test_merge_intervals_of_nothing(spark):
    df = spark.createDataFrame([("a", 5, 5), ("a", 6, 2), (None, 1, 2), ("a", None, 1)], "k string, start bigint, stop bigint")
    assert merge_intervals(df, ["k"]).collect() == []
    assert merge_intervals(df.limit(0), ["k"], tile_rows=1).collect() == []
    with pytest.raises(ValueError):
        merge_intervals(df.withColumnRenamed("k", "kind"), ["kind"])


def test_streamed_periods_sum_to_the_batch_result(spark, tmp_path):
    from tidespan.streaming.periods import stream_periods

    rng = random.Random(5)
    schema = "k string, start bigint, stop bigint"
    data = [(rng.choice("ab"), s := rng.randrange(200), s + rng.randrange(6)) for _ in range(120)]
    for i in range(3):
        spark.createDataFrame(data[i * 40 : i * 40 + 40], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stream_periods(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["k"])
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    total = spark.read.parquet(f"{tmp_path}/out").groupBy("k", "kind", "start", "stop").agg(F.sum("change").alias("c")).where("c <> 0")
    assert rows(total.select("k", "kind", "start", "stop")) == rows(merge_intervals(spark.createDataFrame(data, schema), ["k"]))
    assert {r["c"] for r in total.collect()} == {1}


# differences

DAY = [datetime.datetime(2024, 1, d) for d in range(1, 5)]
SCHEMA = "sample string, id string, n bigint, r double, at timestamp_ntz, latest string"
FIELDS = [Field("n"), Field("r", within=0.5)]


def _diff(spark, left, right, fields=FIELDS):
    one, two = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    return differences(one, two, {"sample": F.col("sample"), "id": F.trim("id")}, fields, "at", left_name="l", right_name="r")


def test_differences(spark):
    nan = float("nan")
    left = [("s", " a ", 1, 1.0, DAY[0], "x"), ("s", "a", 2, 1.0, DAY[1], "x"), ("s", "b", 1, 1.0, DAY[0], ""), (None, "c", None, None, DAY[0], ""), ("s", "d", 1, nan, None, ""), ("s", "e", 1, nan, DAY[0], ""), ("s", None, 1, 1.0, DAY[0], ""), ("s", "A", 1, 2.0, DAY[0], "")]
    right = [("s", "a", 2, 1.4, DAY[0], ""), ("s", "a", 2, 1.4, DAY[0], ""), (None, "c", None, None, DAY[3], ""), ("s", "d", 1, nan, DAY[0], ""), ("s", "e", 1, 1.0, DAY[0], ""), ("s", None, 1, None, DAY[0], ""), ("s", "A", 2, 2.6, DAY[0], ""), ("", "c", 5, 0.0, DAY[0], "")]
    found = _diff(spark, left, right)
    want = [("s", "b", "missing_in_r"), ("", "c", "missing_in_l"), ("s", "e", "r"), ("s", None, "r"), ("s", "A", "n"), ("s", "A", "r")]
    assert rows(difference_rows(found, ["sample", "id"])) == sorted(want, key=repr)
    detail = {r["id"]: r["diffs"] for r in found.collect()}
    assert [tuple(d) for d in detail["A"]] == [("n", "1", "2"), ("r", "2.0", "2.6")]


def test_differences_of_empty_tables_and_ties(spark):
    left = [("s", "a", 1, 1.0, DAY[0], "x"), ("s", "a", 3, 1.0, DAY[0], "x")]
    assert rows(difference_rows(_diff(spark, left, []), ["sample", "id"])) == [("s", "a", "missing_in_r")]
    assert rows(difference_rows(_diff(spark, [], left), ["sample", "id"])) == [("s", "a", "missing_in_l")]
    assert _diff(spark, [], []).collect() == []
    # of rows that are equally late the greatest counts
    assert _diff(spark, left, [("s", "a", 3, 1.0, DAY[0], "y")]).collect() == []


# packed values

PACKED = {
    "a;b; c": ["a", "b", "c"],
    "a, b;c": ["a", "b", "c"],
    '"x;y","z"': ["x;y", "z"],
    "'it''s' 'b'": ["it's", "b"],
    '["a" | "b""c"]': ["a", 'b"c'],
    "(a.1/b-2/c_3)": ["a.1", "b-2", "c_3"],
    "a": ["a"],
    "a'b": ["a", "b"],
    '""': [""],
    " ; ": [],
    "": [],
    "a；b": ["a", "b"],
    "a\tb\t": ["a", "b"],
    "x" * 200_000 + ";y": ["x" * 200_000, "y"],
    ";" * 50_000 + "y": ["y"],
}


def test_packed_values(spark):
    df = spark.createDataFrame([(i, s, 0) for i, s in enumerate(PACKED)] * 2 + [(99, None, 0)], "id bigint, s string, pos int")
    found = defaultdict(list)
    for r in split_packed(df, "id", "s", NAMES).orderBy("row_id", "pos").collect():
        found[r["row_id"]].append((r["pos"], r["item"], r["n_items"]))
    assert found == {i: [(p + 1, x, len(v)) for p, x in enumerate(v)] for i, v in enumerate(PACKED.values()) if v}
    assert split_packed(df.limit(0), "id", "s", NAMES).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1.-_;, |/\t\"'([é", max_size=25))
def test_every_dialect_that_parses_agrees(text):
    whole = [v for name, v, _ in candidates(text, NAMES) if name == "any"][0]
    assert all(v == whole for _, v, _ in candidates(text, NAMES))
    assert all(v == [w for w in "".join(c if c.isascii() and c.isdigit() else " " for c in text).split()] for _, v, _ in candidates(text, NUMBERS))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc12.-;, \"'é", max_size=20), st.sampled_from([NAMES, NUMBERS, FREE]))
def test_a_shape_stands_for_its_strings(text, grammar):
    bits = [(i * 37 % 11) / 2 + 1 for i in range(4096)]

    def cost(candidate):
        return candidate[2] + sum(bits[packed._shape(v)[0]] + packed._shape(v)[1] for v in candidate[1])

    found, best = packed._candidates(text, grammar), cheapest(shape_of(text, grammar), grammar, bits)
    mine = {c[0]: cost(c) for c in found}
    assert best is not None and mine[best[0]] <= min(mine.values()) + 1e-9


def test_codes_decide_where_values_hold_blanks_and_delimiters(spark):
    places = ["New York", "Rome", "Los Angeles", "San Juan", "Oslo", "El Paso"]
    strings, want = [], {}
    for i in range(120):
        chosen = [places[(i * 5 + j * (1 + i % 3)) % 6] for j in range(2 + i % 3)]
        delimiter = [";", "; ", ",", "|"][i % 4]
        strings.append((i, delimiter.join(chosen)))
        want[i] = chosen
    strings += [(200, '"Bonn, am Rhein","Rome"'), (201, "Oslo"), (202, ""), (203, "Rome\tNew York")]
    want |= {200: ["Bonn, am Rhein", "Rome"], 201: ["Oslo"], 203: ["Rome", "New York"]}
    found = defaultdict(list)
    for r in split_packed(spark.createDataFrame(strings, "id bigint, s string"), "id", "s", FREE).orderBy("row_id", "pos").collect():
        found[r["row_id"]].append(r["item"])
    assert found == want


def test_cheapest_dialect_is_named(spark):
    df = spark.createDataFrame([(i, f"g{i};h{i};k{i}") for i in range(50)] + [(60, "a;b,c|d")], "id bigint, s string")
    by = {r["row_id"]: r["dialect"] for r in split_packed(df, "id", "s", NAMES).collect()}
    assert by[3] == ";" and by[60] == "any"
