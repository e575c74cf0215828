"""The coverage engine against golden values, brute force and its invariants."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidespan.functions.regions import Bands
from tidespan.operators.alignments import assert_sorted, keep_fragments, read_intervals
from tidespan.operators.joins import _looks, bin_classes, bind_regions, interval_join
from tidespan.operators.multisample import antitarget, compare_counts, intersect_samples, mean_depths, shared_low_coverage, total_delta, wide_report
from tidespan.operators.spans import fill_spans, span_summary
from tidespan.operators.stats import clip_to_regions, count_reads, coverage_to_target, mapped_reads, region_coordinates, region_counts, region_stats
from tidespan.operators.sweep import coverage, merge_equal_runs
from tidespan.options import InputOptions, OutputOptions
from tidespan.plans import coverage as plans
from tidespan.plans import domain

MINI_REFS = [(0, "seq1", 1000), (1, "seq2", 1000), (2, "seq0", 1000)]
_COPIES = [(9, 109, 5), (189, 289, 2), (200, 300, 2), (250, 350, 2), (299, 399, 1), (379, 479, 1), (400, 500, 1), (650, 750, 1)]
MINI = [(0, a, b, 0) for a, b, n in _COPIES for _ in range(n)] + [(1, 499, 599, f) for f in (0, 16) for _ in range(5)]
GOLDEN = {
    "seq1": [(0, 9, 0), (9, 109, 5), (109, 189, 0), (189, 200, 2), (200, 250, 4), (250, 289, 6), (289, 299, 4), (299, 300, 5), (300, 350, 3), (350, 379, 1), (379, 399, 2), (399, 400, 1), (400, 479, 2), (479, 500, 1), (500, 650, 0), (650, 750, 1), (750, 1000, 0)],
    "seq2": [(0, 499, 0), (499, 599, 10), (599, 1000, 0)],
    "seq0": [(0, 1000, 0)],
}
TINY = (
    [(9, 50, 16), (10, 55, 16), (11, 56, 16), (12, 58, 16), (14, 45, 16), (100, 200, 0), (100, 200, 0), (100, 200, 16), (104, 196, 0), (106, 197, 0), (112, 199, 0), (102, 199, 0)]
    + [(299, 310, 16)] * 5 + [(310, 340, 0)] * 5 + [(340, 400, 16)] * 6 + [(609, 650, 0)] * 4 + [(650, 699, 16)] * 5 + [(799, 900, 16), (809, 890, 0)]
)
TINY_REGIONS = [("seq1", 100, 200, "feature_1"), ("seq1", 300, 400, "feature_2"), ("seq1", 600, 700, "feature_3"), ("seq1", 800, 900, "last_but_not_least")]


def refs(spark, found=MINI_REFS):
    return spark.createDataFrame(found, "tid int, name string, length bigint")


def reads(spark, found, sample="s"):
    return spark.createDataFrame([(sample, f, t, a, b, 60, 0) for t, a, b, f in found], "sample string, flag int, tid int, start bigint, stop bigint, mapq int, isize bigint")


def intervals(spark, found, known, **options):
    return read_intervals(reads(spark, found), known, InputOptions(**options))


@pytest.mark.parametrize("tile", [1 << 20, 64])
def test_golden_runs(spark, tile):
    known = refs(spark)
    runs = coverage(intervals(spark, MINI, known), known, tile=tile).join(known, "tid")
    assert rows(runs, "name", "start", "stop", "cov") == rows(spark.createDataFrame([(n, *r) for n, v in GOLDEN.items() for r in v], "n string, a bigint, b bigint, c bigint"))


@pytest.mark.parametrize("tile", [1 << 20, 64])
def test_bands_and_strands(spark, tile):
    known = refs(spark)
    found = intervals(spark, MINI, known)
    band = coverage(found, known, bands="2,4", tile=tile)
    assert {r["band"] for r in band.collect()} == {"0-1", "2-3", "4-"}
    assert rows(band.where("tid = 0"), "start", "stop", "band")[:3] == [(0, 9, "0-1"), (109, 189, "0-1"), (189, 200, "2-3")]
    both = coverage(found, known, stranded=True, tile=tile)
    assert both.agg(F.max("rev"), F.max("fwd")).first() == (5, 6)
    assert both.where("cov <> fwd + rev").count() == 0
    assert rows(coverage(found, known, stranded=True, bands="3", tile=tile).where("tid = 1"), "start", "stop", "band_fwd", "band_rev") == [(0, 499, "0-2", "0-2"), (499, 599, "3-", "3-"), (599, 1000, "0-2", "0-2")]


def test_band_breaks():
    assert Bands("4,2,2").labels == ["0-1", "2-3", "4-"]
    with pytest.raises(ValueError):
        Bands("a")


def test_spans(spark):
    known = refs(spark)
    runs = coverage(intervals(spark, MINI, known), known)
    high = fill_spans(span_summary(runs, known, 250, "max"), known, 250, ["s"])
    assert [r["cov"] for r in high.orderBy("tid", "span").collect()] == [5, 6, 1, 0, 0, 10, 10, 0, 0, 0, 0, 0]
    low = fill_spans(span_summary(runs, known, 300, "min"), known, 300, ["s"]).where("tid = 0").orderBy("span").collect()
    assert [(r["start"], r["stop"], r["cov"]) for r in low] == [(0, 300, 0), (300, 600, 0), (600, 900, 0), (900, 1000, 0)]
    for partial, last in (("nominal", 300), ("actual", 100)):
        mean = {(r["tid"], r["span"]): r["cov"] for r in span_summary(runs, known, 300, "mean", partial=partial).collect()}
        assert mean[1, 1] == pytest.approx(1000 * 99 / 100 / 300 + 10 / 300) and mean.get((1, 3), 0) == 0 * last
    with pytest.raises(ValueError):
        span_summary(runs, known, 10, "median")


def test_region_means_and_counts_of_mini(spark):
    known = refs(spark)
    raw = spark.createDataFrame([("seq1", 5, 112, "include_5"), ("seq1", 410, 532, "overlap_2"), ("seq1", 800, 950, "empty1_0"), ("seq2", 300, 532, "shared1_10"), ("seq2", 566, 769, "shared2_10"), ("seq0", 100, 200, "null_0")], "chrom string, start bigint, stop bigint, name string")
    bound = bind_regions(raw, known)
    found = intervals(spark, MINI, known)
    means = {r["name"]: round(r["mean"], 2) for r in region_stats(coverage(found, known), bound).collect()}
    assert means == {"include_5": 4.67, "overlap_2": 1.30, "empty1_0": 0.0, "shared1_10": 1.42, "shared2_10": 1.63, "null_0": 0.0}
    counts = {r["name"]: r["counts"] for r in region_counts(found, bound, samples=["s"]).collect()}
    assert counts == {n: int(n.rpartition("_")[2]) for n in means}


def test_tiny_tells_the_predicates_apart(spark):
    known = refs(spark, [(0, "seq1", 1000)])
    found = intervals(spark, [(0, a, b, f) for a, b, f in TINY], known)
    bound = bind_regions(spark.createDataFrame(TINY_REGIONS, "chrom string, start bigint, stop bigint, name string"), known)
    runs = coverage(found, known)
    by = lambda df, *c: {r["name"]: tuple(r[x] for x in c) for r in df.collect()}
    assert by(region_stats(runs, bound), "bases", "min", "max") == {"feature_1": (667, 3, 7), "feature_2": (560, 5, 6), "feature_3": (409, 0, 5), "last_but_not_least": (181, 1, 2)}
    assert {n: v[0] for n, v in by(region_stats(runs, bound, compat=True), "min").items()} == {"feature_1": 0, "feature_2": 0, "feature_3": 0, "last_but_not_least": 0}
    assert by(count_reads(found, bound), "counts") == {"feature_1": (7,), "feature_2": (16,), "feature_3": (9,), "last_but_not_least": (2,)}
    assert by(count_reads(found, bound, compat=True), "counts") == {"feature_1": (4,), "feature_2": (16,), "feature_3": (9,), "last_but_not_least": (1,)}
    assert by(count_reads(found, bound, compat=True, strict=True), "counts") == {"feature_1": (4,), "feature_2": (11,), "feature_3": (9,), "last_but_not_least": (1,)}


def test_same_names_are_pooled(spark):
    known = refs(spark, [(0, "chr1", 1000)])
    found = intervals(spark, [(0, 99, 110, 16), (0, 199, 210, 16), (0, 299, 310, 16)], known)
    raw = spark.createDataFrame([("chr1", 299, 309, "feat1"), ("chr1", 99, 109, "feat1"), ("chr1", 199, 209, "feat2")], "chrom string, start bigint, stop bigint, name string")
    bound = bind_regions(raw, known)
    assert rows(region_counts(found, bound, samples=["s"]), "name", "rev", "counts") == [("feat1", 2, 2), ("feat2", 1, 1)]
    assert rows(count_reads(found, bound, compat=True), "name", "counts") == []
    assert rows(region_coordinates(bound).where("name = 'feat1'")) == [("feat1", "chr1;chr1", "99;299", "109;309", 20)]


def test_physical_and_overhang(spark):
    known = refs(spark, [(0, "filt.1", 249)])
    pair = spark.createDataFrame([("s", 99, 0, 0, 46, 60, 249), ("s", 147, 0, 203, 249, 60, -249)], "sample string, flag int, tid int, start bigint, stop bigint, mapq int, isize bigint")
    assert rows(coverage(read_intervals(pair, known), known), "start", "stop", "cov") == [(0, 46, 1), (203, 249, 1), (46, 203, 0)]
    assert rows(coverage(read_intervals(pair, known, InputOptions(physical=True)), known), "start", "stop", "cov") == [(0, 249, 1)]
    assert rows(coverage(read_intervals(pair, known, InputOptions(fragment_length=100)), known), "start", "stop", "cov") == [(0, 100, 1), (100, 203, 0), (203, 249, 1)]
    beyond = reads(spark, [(0, 200, 260, 0)])
    assert rows(read_intervals(beyond, known), "start", "stop") == [(200, 249)]
    with pytest.raises(Exception, match="beyond reference"):
        read_intervals(beyond, known, InputOptions(overhang="error")).collect()
    assert keep_fragments(pair).count() == 1


def test_flags(spark):
    known = refs(spark, [(0, "x", 500000)])
    kept = intervals(spark, [(0, 0, int(f"1{f}"), f) for f in (0, 4, 16, 256, 272, 512, 1024, 83, 99, 2048)], known)
    assert kept.count() == 5
    assert mapped_reads(reads(spark, [(0, 0, 1, 4), (0, 0, 1, 0)])).first()["total"] == 1


@pytest.mark.parametrize("seed", range(3))
def test_random_reads_against_an_array(spark, seed):
    rng = random.Random(seed)
    length = rng.choice([1, 40, 300])
    known = refs(spark, [(0, "a", length), (1, "b", 50)])
    found = [(0, a := rng.randrange(length), min(length, a + rng.choice([0, 1, 5, 60])), rng.choice([0, 16])) for _ in range(rng.choice([0, 3, 80]))]
    depth = [sum(1 for _, a, b, _ in found if a <= i < b) for i in range(length)]
    runs = coverage(intervals(spark, found, known), known, samples=["s"], tile=rng.choice([8, 1 << 20])).where("tid = 0").orderBy("start").collect()
    assert [r["cov"] for r in runs for _ in range(r["stop"] - r["start"])] == depth
    assert all(a["cov"] != b["cov"] and a["stop"] == b["start"] for a, b in zip(runs, runs[1:])) and runs[0]["start"] == 0 and runs[-1]["stop"] == length
    regions = [(0, a := rng.randrange(length), rng.randrange(a, length + 1), rng.choice("pq")) for _ in range(12)]
    bound = spark.createDataFrame([r for r in regions if r[1] < r[2]] + [(0, 0, length, "all")], "tid int, start bigint, stop bigint, name string")
    stats = {r["name"]: r for r in region_stats(coverage(intervals(spark, found, known), known, samples=["s"]), bound, low=2).collect()}
    for name in {r["name"] for r in bound.collect()}:
        covered = [depth[i] for r in bound.collect() if r["name"] == name for i in range(r["start"], r["stop"])]
        s = stats[name]
        assert (s["bases"], s["min"], s["max"], s["low"], s["length"]) == (sum(covered), min(covered), max(covered), sum(d < 2 for d in covered), len(covered))


@pytest.mark.parametrize("width", [1, 4, 1 << 10])
def test_interval_join_against_pairs(spark, width):
    rng = random.Random(width)
    made = lambda n: [(rng.choice([0, 1, None]), a := rng.randrange(-5, 60), a + rng.choice([0, 1, 3, 40]), i) for i in range(n)]
    left, right = made(60), made(40)
    one = spark.createDataFrame(left, "tid int, start bigint, stop bigint, id int")
    two = spark.createDataFrame(right, "tid int, start bigint, stop bigint, id int")
    meets = lambda touching: sorted((x[3], y[3]) for x in left for y in right if x[0] is not None and x[0] == y[0] and ((x[1] <= y[2] and y[1] <= x[2]) if touching else (x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2])))
    assert rows(interval_join(one, two, ["tid"], width=width), "id", "right_id") == sorted(meets(False), key=repr)
    assert rows(interval_join(one, two, ["tid"], width=width, touching=True), "id", "right_id") == sorted(meets(True), key=repr)
    assert rows(interval_join(one, two, ["tid"], width=width, how="semi"), "id") == sorted({(a,) for a, _ in meets(False)}, key=repr)
    assert interval_join(one, two.limit(0), ["tid"]).collect() == []


def test_unknown_reference_raises(spark):
    raw = spark.createDataFrame([("nope", 0, 5, "")], "chrom string, start bigint, stop bigint, name string")
    with pytest.raises(Exception, match="unknown reference"):
        bind_regions(raw, refs(spark)).collect()
    assert bind_regions(raw, refs(spark), unknown="drop").collect() == []
    fine = spark.createDataFrame([("seq1", 0, 5, "")], "chrom string, start bigint, stop bigint, name string")
    assert bind_regions(fine, refs(spark)).first()["name"] == "seq1:0-5"


def test_unsorted_input_raises(spark):
    data = spark.createDataFrame([("s", 0, 5, 9, 1), ("s", 0, 3, 9, 2)], "sample string, tid int, start bigint, stop bigint, ord int")
    with pytest.raises(Exception, match="went backwards"):
        assert_sorted(data, "ord").collect()
    assert assert_sorted(data.withColumn("ord", -F.col("ord")), "ord").count() == 2


def test_samples_together(spark):
    known = refs(spark, [(0, "a", 100), (1, "b", 10)])
    both = read_intervals(reads(spark, [(0, 0, 50, 0), (0, 10, 20, 0)], "x").union(reads(spark, [(0, 40, 100, 0)], "y")), known)
    runs = coverage(both, known, samples=["x", "y"])
    means = {r["name"]: (r["x"], r["y"]) for r in mean_depths(runs, known, ["x", "y"], total=True).collect()}
    assert means == {"a": (0.6, 0.6), "b": (0.0, 0.0), "#Total": (60 / 110, 60 / 110)}
    assert rows(shared_low_coverage(runs, known, 0, 0, 2, 1.0)) == [(1, 0, 10, 2)]
    assert rows(shared_low_coverage(runs, known, 1, 9, 2, 0.5), "tid", "start", "stop", "n") == [(0, 0, 40, 1), (0, 40, 50, 2), (0, 50, 100, 1)]
    assert rows(intersect_samples(both, known, 2)) == [(0, 40, 50, 2)]
    report = wide_report(region_stats(runs, spark.createDataFrame([(0, 0, 10, "r"), (1, 5, 5, "none")], "tid int, start bigint, stop bigint, name string")), ["x", "y"])
    assert {r["name"]: (r["x_bases"], r["y_bases"], r["x_mean"], r["length"]) for r in report.collect()} == {"r": (10, 0, 1.0, 10), "none": (0, 0, 0.0, 0)}


def test_antitarget_and_target(spark):
    known = refs(spark, [(0, "a", 100), (1, "b", 10)])
    bound = spark.createDataFrame([(0, 10, 20, "p"), (0, 15, 30, "q"), (0, 90, 200, "q")], "tid int, start bigint, stop bigint, name string")
    assert rows(antitarget(bound, known)) == [(0, 0, 10), (0, 30, 90), (1, 0, 10)]
    cover = spark.createDataFrame([(0, 0, 16, 2), (0, 16, 100, 1)], "tid int, start bigint, stop bigint, cov bigint")
    assert rows(coverage_to_target(cover, bound), "name", "bases") == [("p", 16), ("q", 2 + 14 + 10)]
    assert rows(coverage_to_target(cover, bound, first_only=True), "name", "bases") == [("p", 16), ("q", 0)]
    assert clip_to_regions(cover.withColumn("sample", F.lit("s")), bound).count() == 5


def test_compare_counts(spark):
    one = spark.createDataFrame([("a", 2), ("b", 0)], "id string, n bigint")
    two = spark.createDataFrame([("a", 3), ("b", 1)], "id string, n bigint")
    found = compare_counts(one, two, "id", "n")
    assert rows(found) == [("a", 2, 3, 1, 50.0), ("b", 0, 1, 1, None)]
    assert tuple(total_delta(found).first()) == (2, 2)
    with pytest.raises(Exception, match="only one side"):
        compare_counts(one, two.limit(1), "id", "n").collect()


@pytest.mark.parametrize("bad", [{"min_mapq": 256}, {"flag_mask": -1}, {"fragment_length": -1}, {"overhang": "x"}])
def test_input_options(bad):
    with pytest.raises(ValueError):
        InputOptions(**bad)


@pytest.mark.parametrize("bad", [{"op": "sum"}, {"span": -1}, {"span": 5, "quantize": "1"}])
def test_output_options(bad):
    with pytest.raises(ValueError):
        OutputOptions(**bad)


def test_reads_in_target_of_every_reference(spark, monkeypatch):
    tables = {
        "alignments": reads(spark, [(0, 5, 20, 0), (1, 5, 20, 0), (1, 15, 30, 16), (1, 40, 50, 0), (2, 5, 20, 0)]),
        "refs": refs(spark),
        "regions": spark.createDataFrame([(0, 0, 10, "a"), (1, 10, 20, "b"), (1, 18, 25, "c"), (3, 0, 10, "d")], "tid int, start bigint, stop bigint, name string"),
    }
    for name, table in tables.items():
        monkeypatch.setattr(plans, name, lambda spark, folder, table=table: table)
    # the reference 2 has no target
    assert rows(plans.reads_in_target(spark, "")) == [(0, 1), (1, 2)]


def test_reads_with_a_null_bound_cover_nothing(spark):
    known = refs(spark)
    found = reads(spark, [(0, 10, None, 0), (0, None, 20, 0), (0, None, None, 0), (0, 30, 40, 16)])
    assert rows(read_intervals(found, known), "start", "stop") == [(30, 40)]
    assert rows(read_intervals(found, known, InputOptions(overhang="error")), "start", "stop") == [(30, 40)]
    # the end that an option sets is known
    assert rows(read_intervals(found, known, InputOptions(fragment_length=50)), "start", "stop") == [(10, 60), (30, 80)]
    assert rows(read_intervals(found.withColumn("isize", F.lit(5)), known, InputOptions(physical=True)), "start", "stop") == [(10, 15), (30, 35)]
    assert rows(coverage(read_intervals(found, known), known).where("cov > 0"), "tid", "start", "stop", "cov") == [(0, 30, 40, 1)]


def test_required_order_of_reads(spark):
    known, options = refs(spark), InputOptions(require_sorted="at")
    found = reads(spark, [(0, 10, 20, 0), (0, 30, 40, 0), (1, 5, 15, 0)]).withColumn("at", F.col("tid") * 100 + F.col("start"))
    assert rows(read_intervals(found, known, options), "tid", "start") == [(0, 10), (0, 30), (1, 5)]
    with pytest.raises(Exception, match="coverage went backwards"):
        read_intervals(found.withColumn("at", -F.col("at")), known, options).collect()


def test_more_references_than_a_driver_should_list(spark):
    refs = spark.range(1_500_000).select(F.col("id").cast("int").alias("tid"), F.concat(F.lit("r"), "id").alias("name"), F.lit(10).cast("bigint").alias("length"))
    reads = spark.createDataFrame([("s", 0, t, 2, 5, 60, 0) for t in (3, 1_499_999)], "sample string, flag int, tid int, start bigint, stop bigint, mapq int, isize bigint")
    runs = coverage(read_intervals(reads, refs), refs, samples=["s"])
    assert runs.count() == 1_500_000 + 4
    assert rows(runs.where("tid = 3"), "start", "stop", "cov") == [(0, 2, 0), (2, 5, 1), (5, 10, 0)]


def test_samples_in_and_out_of_the_plan(spark, monkeypatch):
    refs = spark.createDataFrame([(0, "x", 10)], "tid int, name string, length bigint")
    reads = spark.createDataFrame([(s, 0, 0, 1, 3, 60, 0) for s in ("a", None, "other")], "sample string, flag int, tid int, start bigint, stop bigint, mapq int, isize bigint")
    want = [("a", 0, 1, 0), ("a", 1, 3, 1), ("a", 3, 10, 0), ("b", 0, 10, 0), (None, 0, 1, 0), (None, 1, 3, 1), (None, 3, 10, 0)]
    for most in (64, 0):
        monkeypatch.setattr("tidespan.operators.sweep._IN_PLAN", most)
        assert rows(coverage(read_intervals(reads, refs), refs, samples=["a", "b", None]), "sample", "start", "stop", "cov") == sorted(want, key=repr)
    assert coverage(read_intervals(reads.limit(0), refs), refs).count() == 0


@pytest.mark.parametrize("touching", [False, True])
def test_joins_over_all_lengths_equal_brute_force(spark, touching):
    rng = random.Random(5)
    side = lambda n, longest: [(rng.choice([0, 1, None]), a, a + rng.choice([0, 1, rng.randrange(longest)])) for a in (rng.randrange(200_000) for _ in range(n))]
    a, b = side(300, 3000) + [(0, None, 5), (0, 0, 10**9)], side(200, 500) + side(20, 150_000) + [(1, 5, 10**8), (1, 9, None)]
    left = spark.createDataFrame([(i, *x) for i, x in enumerate(a)] * 2, "i int, tid int, start bigint, stop bigint").repartition(3)
    right = spark.createDataFrame([(i, *x) for i, x in enumerate(b)], "j int, tid int, start bigint, stop bigint")

    def meet(x, y):
        if None in x or None in y or x[0] != y[0]:
            return False
        if touching:
            return x[1] <= y[2] and y[1] <= x[2]
        return x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2]

    pairs = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if meet(x, y))
    assert rows(interval_join(left, right, ["tid"], touching=touching), "i", "j") == sorted(pairs * 2, key=repr)
    assert rows(interval_join(left, right, ["tid"], touching=touching, how="semi"), "i") == sorted([(i,) for i in {i for i, _ in pairs}] * 2, key=repr)


@pytest.mark.parametrize("n, sent", [(2_000, True), (60_000, False)])
def test_a_large_side_in_bins_is_not_broadcast(spark, n, sent):
    # 60,000 regions are 600,000 rows in bins, and by Spark's estimate still under its threshold
    regions = spark.range(n).select((F.col("id") % 3).cast("int").alias("tid"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 50).alias("stop"))
    reads = spark.range(1_000).select((F.col("id") % 3).cast("int").alias("tid"), (F.col("id") * 70).alias("start"), (F.col("id") * 70 + 10).alias("stop"), "id")
    found = interval_join(reads, regions, ["tid"], how="semi")
    assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) == sent
    # region k is on reference k % 3 and begins at 100 k
    assert rows(found, "id") == sorted(((i,) for i in range(1_000) if any(k % 3 == i % 3 and k < n and i * 70 < k * 100 + 50 and k * 100 < i * 70 + 10 for k in range(i * 70 // 100 - 1, i * 70 // 100 + 2))), key=repr)


def test_many_regions_are_not_broadcast_to_the_alignments(spark, monkeypatch):
    i, name = F.col("id"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int"))
    tables = {
        "alignments": spark.range(1_000).select(i.alias("aln_id"), F.lit("s").alias("sample"), F.lit(0).alias("flag"), (i % 3).cast("int").alias("chrom"), (i * 70).alias("start"), (i * 70 + 10).alias("stop"), F.lit(60).alias("mapq"), F.lit(0).cast("bigint").alias("isize")),
        "refs": spark.range(3).select(i.cast("int").alias("tid"), name.alias("name"), F.lit(10**7).cast("bigint").alias("length")),
        "regions": spark.range(60_000).select(i.alias("region_id"), name.alias("chrom"), (i * 100).alias("start"), (i * 100 + 50).alias("stop"), name.alias("name")),
    }
    monkeypatch.setattr(domain, "table", lambda spark, folder, name: tables[name])
    found = domain.aln_in_target(spark, "")
    semi = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "LeftSemi" in line]
    assert len(semi) == 1 and "SortMergeJoin" in semi[0]
    met = [r for r in range(1_000) if any(k % 3 == r % 3 and r * 70 < k * 100 + 50 and k * 100 < r * 70 + 10 for k in range(r * 70 // 100 - 1, r * 70 // 100 + 2))]
    assert rows(found) == [("s", t, len(of), sum(of) * 70) for t in range(3) if (of := [r for r in met if r % 3 == t])]


@pytest.mark.parametrize("threshold, sent", [("10m", True), ("256k", False), ("-1", False)])
def test_a_side_in_bins_is_held_against_the_threshold(spark, threshold, sent):
    # 2,000 regions are 20,000 rows in bins, which take 3 MB; Spark's estimate is under 256 KB
    regions = spark.range(2_000).select((F.col("id") % 3).cast("int").alias("tid"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 50).alias("stop"))
    reads = spark.range(1_000).select((F.col("id") % 3).cast("int").alias("tid"), (F.col("id") * 70).alias("start"), (F.col("id") * 70 + 10).alias("stop"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = interval_join(reads, regions, ["tid"], how="semi")
        assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) == sent
        assert rows(found, "id") == sorted(((i,) for i in range(1_000) if any(k % 3 == i % 3 and i * 70 < k * 100 + 50 and k * 100 < i * 70 + 10 for k in range(i * 70 // 100 - 1, i * 70 // 100 + 2))), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_stretches_take_few_bins(spark):
    left = spark.createDataFrame([(0, 0, 3_000_000_000, 7)], "tid int, start bigint, stop bigint, cov int")
    right = spark.range(1000).select(F.lit(0).alias("tid"), (F.col("id") * 1_000_000).alias("start"), (F.col("id") * 1_000_000 + 100 + F.col("id") % 7 * 10_000).alias("stop"))
    looks, _ = _looks(bin_classes(right), F.col("stop") - 1)
    assert left.select(F.size(looks)).first()[0] < 20 and interval_join(left, right, ["tid"]).count() == 1000


def test_one_giant_leaves_the_bins_of_the_others_alone(spark):
    many = spark.range(2000).select((F.col("id") * 1000).alias("start"), (F.col("id") * 1000 + 100).alias("stop"))
    assert bin_classes(many) == [7] and bin_classes(many.unionByName(spark.range(1).select(F.col("id").alias("start"), F.lit(2 * 10**8).cast("bigint").alias("stop")))) == [7, 29]


def test_runs_fuse_across_tiles(spark):
    data = [("s", a, a + 5, 1 if a < 60 else 2) for a in range(0, 100, 5)] + [("t", 0, 3, 1), ("t", 4, 9, 1), ("t", 9, 12, 1)]
    runs = spark.createDataFrame(data, "k string, start bigint, stop bigint, v int").repartition(4)
    for tile in (7, 1 << 20):
        assert rows(merge_equal_runs(runs, ["k"], ["v"], tile=tile)) == [("s", 0, 60, 1), ("s", 60, 100, 2), ("t", 0, 3, 1), ("t", 4, 12, 1)]


def test_long_runs_are_spread_by_stretches(spark, monkeypatch):
    monkeypatch.setattr("tidespan.operators.spans._CUT", 4)
    refs = spark.createDataFrame([(0, "x", 1001)], "tid int, name string, length bigint")
    runs = spark.createDataFrame([("s", 0, 0, 995, 3), ("s", 0, 995, 1001, 0)], "sample string, tid int, start bigint, stop bigint, cov bigint")
    found = {r["span"]: r["cov"] for r in span_summary(runs, refs, 10, "min").collect()}
    assert found == {**{i: 3 for i in range(99)}, 99: 0, 100: 0}
    assert fill_spans(span_summary(runs, refs, 10), refs, 10, ["s", "t"]).count() == 202


def test_out_of_order_reads_are_told(spark):
    reads = spark.range(400, numPartitions=3).select(F.lit("s").alias("sample"), (F.col("id") % 2).cast("int").alias("tid"), F.col("id").alias("place"), F.when(F.col("id") == 250, 3).otherwise(F.col("id")).alias("start"))
    assert assert_sorted(reads.where("place <> 250"), "place").count() == 399
    with pytest.raises(Exception, match="went backwards on reference 0"):
        assert_sorted(reads, "place").collect()
