import contextlib
import io

import pytest
from pyspark.sql import functions as F

from allelio.operators import intervals as I
from allelio.operators import joins as J


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def facts(spark):
    # One key holds two thirds of all rows.
    return spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id")).cast("bigint").alias("k"), F.col("id").alias("v")
    )


@pytest.fixture(scope="module")
def dims(spark):
    return spark.range(0, 2000, 2).select(F.col("id").alias("k"), F.lit("x").alias("name")).unionByName(
        spark.createDataFrame([(1, "hot")], "k bigint, name string")
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_equals_broadcast(facts, dims, rows, how, no_broadcast):
    small = J.lookup_join(facts, dims, "k", how, small=True)
    large = J.lookup_join(facts, dims, "k", how, max_bytes=0)
    assert "SortMergeJoin" in plan(large) and "BroadcastHashJoin" in plan(small)
    staged = J.lookup_join(facts, dims, "k", how, stage=True)
    assert small.columns == large.columns == staged.columns
    assert rows(small) == rows(large) == rows(staged)


def test_a_large_side_is_repeated_less(facts, dims, rows, no_broadcast, monkeypatch):
    want = rows(J.lookup_join(facts, dims, "k", "left_semi", small=True))
    size = J.measured_bytes(dims)
    for budget, salted in ((size * 3, True), (size, False), (0, False)):
        monkeypatch.setattr(J, "REPEAT_BYTES", budget)
        joined = J.lookup_join(facts, dims, "k", "left_semi", max_bytes=0)
        assert ("_salt" in plan(joined)) is salted
        assert rows(joined) == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_a_side_beyond_the_bound_is_never_broadcast(facts, dims, rows, how):
    # Spark's own threshold is on, and the written side is far below it.
    want = rows(J.lookup_join(facts, dims, "k", how, small=True))
    small_file, size = J.staged(dims)
    for kw in ({"max_bytes": 0}, {"max_bytes": 0, "stage": True}, {"max_bytes": 0, "size": size}, {"small": False}):
        joined = J.lookup_join(facts, small_file, "k", how, **kw)
        assert "Broadcast" not in plan(joined) and "SortMergeJoin" in plan(joined)
        assert rows(joined) == want
        assert "BroadcastHashJoin" not in plan(joined)


def test_hot_key_is_spread(facts, dims):
    salted, _ = J._salted(facts, dims, 16)
    per_salt = [r["count"] for r in salted.filter("k = 1").groupBy("_salt").count().collect()]
    assert len(per_salt) == 16 and max(per_salt) < 2 * min(per_salt)


def test_measured_bytes(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, None)], "a int, b string")
    assert J.measured_bytes(df) == 2 * 32 + 4
    assert J.staged(df)[1] == 2 * 32 + 4
    assert J.measured_bytes(df.filter("a > 5")) == 0


def test_semi_any_flag_and_consensus(spark, rows):
    df = spark.createDataFrame([(i,) for i in range(6)], "k int")
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(J.semi_join_any(df, [a, b], "k")) == [(1,), (2,), (3,)]
    assert rows(J.consensus(df, [a, b], "k")) == [(2,)]
    assert rows(J.intersect_ids([a, b, df], "k")) == [(2,)]
    assert rows(J.union_ids([a, b], "k")) == [(1,), (2,), (3,)]
    assert rows(J.flag_in(df, a, "k", "f")) == [(0, 0), (1, 1), (2, 1), (3, 0), (4, 0), (5, 0)]


def test_annotate_keeps_one_row_per_variant(spark, rows):
    df = spark.createDataFrame([("1", 5), ("1", 6)], "contig string, pos int")
    ann = spark.createDataFrame([("1", 5, "b"), ("1", 5, "a")], "contig string, pos int, sig string")
    assert rows(J.annotate(df, ann, ["contig", "pos"], ["sig"])) == [("1", 5, "a"), ("1", 6, None)]


def test_rule_override_and_null_gene(spark, rows):
    df = spark.createDataFrame([("TTN", 1), ("TTN", 9), ("DES", 9), (None, 9)], "gene string, pos int")
    assert rows(J.override_rule(df, "TTN", F.col("pos") < 5, F.lit(True))) == [("DES", 9), ("TTN", 1), (None, 9)]


def test_first_by_is_stable(facts):
    a = J.first_by(facts.repartition(7), ["k"], ["k"]).agg(F.sum("v")).first()
    b = J.first_by(facts.repartition(3), ["k"], ["k"]).agg(F.sum("v")).first()
    assert a == b


SITES = "contig string, pos bigint, gene string"
REGIONS = "contig string, start_pos bigint, end_pos bigint, name string"


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("how", ["broadcast", "salted"])
@pytest.mark.parametrize("bin_size", [7, 100, 100_000])
def test_interval_join_against_brute_force(spark, rows, closed, how, bin_size, no_broadcast):
    sites = [(f"chr{i % 3}", i * 13 % 500, f"g{i}") for i in range(400)]
    # Overlapping, nested, empty, one-base and reversed intervals; ends on bin edges.
    regions = [(f"chr{i % 3}", i * 37 % 450, i * 37 % 450 + w, f"r{i}") for i, w in enumerate([0, 1, 7, 50, 100, 300, -5, 14, 21, 100])]
    want = sorted(
        ((c, p, g, s, e, n) for c, p, g in sites for rc, s, e, n in regions if c == rc and s <= p and (p <= e if closed else p < e)), key=repr
    )
    df, reg = spark.createDataFrame(sites, SITES), spark.createDataFrame(regions, REGIONS)
    kw = {"max_bytes": 0} if how == "salted" else {}
    assert rows(I.interval_join(df, reg, closed, bin_size=bin_size, **kw)) == want
    kept = rows(I.filter_intervals(df, reg, closed, prune=True, bin_size=bin_size, **kw))
    assert kept == sorted({w[:3] for w in want}, key=repr)


def test_overlapping_genes_give_both(spark, rows):
    panel = I.region_panel(spark)
    assert panel.count() == 80
    assert panel.agg(F.sum(F.col("end_pos") - F.col("start_pos"))).first()[0] == 48_804_370
    sites = spark.createDataFrame([("chr1", 155_700_000), ("chr1", 237_100_000), ("chr10", 119_300_000)], "contig string, pos bigint")
    assert rows(I.interval_join(sites, panel).select("gene", "pos")) == [
        ("ACTN2", 237_100_000), ("BAG3", 119_300_000), ("LMNA", 155_700_000), ("RIT1", 155_700_000), ("RYR2", 237_100_000),
    ]


def test_pad_is_closed_and_contig_counts(spark, rows):
    exons = spark.createDataFrame([("chr2", 100, 200)], "contig string, start_pos bigint, end_pos bigint")
    df = spark.createDataFrame([("chr2", p) for p in (89, 90, 210, 211)] + [("chr3", 150)], "contig string, pos bigint")
    assert rows(I.near_intervals(df, exons)) == [("chr2", 210), ("chr2", 90)]


def test_inner_merge_of_two_and_five(spark):
    rows = [[(k, t * 100 + k) for k in range(20) if k % (t + 2)] for t in range(5)]
    tables = [spark.createDataFrame(r, f"k int, v{t} int") for t, r in enumerate(rows)]
    for n in (2, 5):
        shared = set.intersection(*[{k for k, _ in r} for r in rows[:n]])
        got = J.inner_merge(tables[:n], "k")
        assert got.columns == ["k", *[f"v{t}" for t in range(n)]]
        assert sorted(map(tuple, got.collect())) == sorted((k, *[t * 100 + k for t in range(n)]) for k in shared)
    twice = spark.createDataFrame([(1, None, 5), (1, 3, 9), (None, 1, 1)], "k int, a int, b int")
    only = spark.createDataFrame([(1,), (None,), (7,)], "k int")
    assert sorted(map(tuple, J.inner_merge([twice, only], "k").collect()), key=repr) == sorted([(1, None, 5), (None, 1, 1)], key=repr)
    with pytest.raises(ValueError, match="same name"):
        J.inner_merge([tables[0], tables[0]], "k")


def test_points_are_dealt_out_by_their_pairs(spark, rows, monkeypatch):
    points = spark.range(0, 3000, 1, 1).selectExpr("id AS v", "concat('chr', id % 2) AS contig", "id * 7 % 9000 AS pos")
    regions = spark.range(200).selectExpr("id AS r", "concat('chr', id % 3) AS contig", "id * 40 AS start_pos", "id * 40 + 500 AS end_pos")
    want = rows(points.join(regions, "contig").filter("pos >= start_pos AND pos < end_pos").select("v", "r"))
    assert rows(I.interval_join(points, regions).select("v", "r")) == want
    monkeypatch.setattr(I, "PAIRS_PER_TASK", 1000)
    monkeypatch.setattr(I, "PAIRS_PER_POINT", 1)
    dealt = I.interval_join(points, regions)
    assert dealt.rdd.getNumPartitions() >= len(want) // 1000 > 1
    assert rows(dealt.select("v", "r")) == want


def test_bins_are_as_wide_as_regions(spark):
    regions = spark.createDataFrame([("a", 1, 5000), ("a", 1, 1000)], "contig string, start_pos bigint, end_pos bigint")
    width = F.col("end_pos") - F.col("start_pos") + 1
    assert I._bin_size(regions, width) == 3000
    assert I._bin_size(regions, width * 1000) == I.BIN_SIZE and I._bin_size(regions.limit(0), width) == I.MIN_BIN


def test_a_site_meets_each_gene_once(spark, rows):
    schema = "gene string, contig string, start_pos bigint, end_pos bigint"
    regions = [("A", "c", 1 + i, 50 + i) for i in range(40)] + [("A", "c", 200, 210), ("B", "c", 60, 70), (None, "c", 60, 61), ("B", "d", 1, 5), ("B", "c", 9, 3)]
    merged = I.merged_regions(spark.createDataFrame(regions, schema), ["gene"])
    assert rows(merged) == sorted([("A", "c", 1, 89), ("A", "c", 200, 210), ("B", "c", 60, 70), (None, "c", 60, 61), ("B", "d", 1, 5)], key=repr)
    sites = spark.createDataFrame([(1, "c", 60), (2, "c", 210), (3, "c", 100), (1, "c", 60)], "site_id bigint, contig string, pos bigint")
    calls = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (1, 9)], "site_id bigint, sample_id bigint")
    got = rows(I.subset_genotypes(calls, sites, spark.createDataFrame(regions, schema), ["site_id"]).select("site_id", "sample_id", "gene"))
    assert got == sorted([(1, s, g) for s in (7, 9) for g in ("A", "B", None)] + [(2, 7, "A")], key=repr)


def test_genes_of_a_call_stay_listed(spark, rows):
    schema = "gene string, contig string, start_pos bigint, end_pos bigint"
    regions = spark.createDataFrame([("B", "c", 60, 70), ("A", "c", 1, 89), ("A", "c", 50, 60), (None, "c", 60, 61), ("A", "c", 200, 210)], schema)
    sites = spark.createDataFrame([(1, "c", 60), (2, "c", 210), (3, "c", 100), (1, "c", 60)], "site_id bigint, contig string, pos bigint")
    calls = spark.createDataFrame([(1, 7, "x"), (2, 7, "x"), (3, 8, "x"), (1, 9, "x")], "site_id bigint, sample_id bigint, gene string")
    listed = I.subset_genotypes(calls, sites, regions, ["site_id"], listed=True)
    assert listed.columns == ["site_id", "sample_id", "gene"]
    assert rows(listed) == [(1, 7, ["A", "B", None]), (1, 9, ["A", "B", None]), (2, 7, ["A"])]
    # A site that is there twice doubles its calls, as it does where calls meet sites again.
    carried = I.subset_genotypes(calls, sites, regions, ["site_id"], listed=True, carried=("pos",)).select("site_id", "sample_id", "pos", "gene")
    assert rows(carried) == [(1, s, 60, ["A", "B", None]) for s in (7, 7, 9, 9)] + [(2, 7, 210, ["A"])]
