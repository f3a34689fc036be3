"""Every registered query against its oracle, on the smallest test tables."""

import contextlib
import io
from pathlib import Path

import pytest

from __spark_entry__ import entry, queries
from allelio.catalog import ORACLES, QUERIES, fixtures
from check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, name):
    ok, text = compare(spark, con, SF, name)
    assert ok, text


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["site_id", "af_eur", "af_afr", "af_amr", "af_eas", "af_sas", "af_mid", "max_value"]
    assert df.count() == 183


HEAVY = [
    "interval_join", "interval_join_binned", "interval_filter", "genotype_region_join", "cohort_popmax", "semi_join_either",
    "tiered_variants", "gene_burden", "carrier_status", "rare_variant_ids", "annotate_by_variant", "missense_revel",
]


@pytest.mark.parametrize("name", HEAVY)
def test_plan_has_no_nested_loop(spark, name):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        queries()[name](spark, SF).explain("formatted")
    assert "NestedLoop" not in text.getvalue()
    assert "Cartesian" not in text.getvalue()


def test_calls_are_dealt_out(spark, tmp_path, monkeypatch):
    orders = [(i, i % 40 if i % 7 else None) for i in range(200)] + [(3, 5), (None, 1)]
    lines = [(i % 210 if i % 11 else None, i % 30 if i % 13 else None, float(i % 50), (i % 9) / 100 if i % 5 else None) for i in range(1500)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([], fixtures.BASE["part"]).write.parquet(f"{tmp_path}/part.parquet")
    fx = fixtures.Fixtures(spark, str(tmp_path))
    plain = fx.view("g_geno")
    want = sorted(map(str, plain.collect()))
    monkeypatch.setattr(fixtures, "LINES_PER_TASK", 100)
    dealt = fx.view("g_geno")
    assert dealt.schema == plain.schema and sorted(map(str, dealt.collect())) == want and len(want) > 100
    # Parts follow the line items, not the session's setting, and are not put together again.
    assert dealt.rdd.getNumPartitions() == 15


def test_a_call_of_many_genes_is_written_from_one_row(spark, tmp_path, rows, monkeypatch):
    from allelio.sources import writers

    lines = [(i % 300, i * 7 % 310, float(i % 50), (i % 9) / 100) for i in range(3000)]
    tables = {
        "supplier": (1500, lambda i: (i,)),
        "part": (300, lambda i: (i, f"Brand#{1 + i % 26}", "PROMO", i % 50)),
        "orders": (300, lambda i: (i, i % 70 if i % 9 else None)),
        "lineitem": (3000, lines.__getitem__),
    }
    for name, (n, row) in tables.items():
        spark.createDataFrame([row(i) for i in range(n)], fixtures.BASE[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    given, write = [], writers.write_genotypes
    monkeypatch.setattr(writers, "write_genotypes", lambda calls, *a, **kw: (given.append(calls), write(calls, *a, **kw))[1])
    out = queries()["write_genotype_subset"](spark, str(tmp_path))
    (calls,) = given
    keys = calls.select("site_id", "sample_id")
    assert 1000 < keys.count() == keys.distinct().count() < out.count() / 2
    for t in tables:
        spark.read.parquet(f"{tmp_path}/{t}.parquet").createOrReplaceTempView(t)
    want = spark.sql(ORACLES["write_genotype_subset"]).select(*out.columns)
    for t in tables:
        spark.catalog.dropTempView(t)
    assert rows(out) == rows(want)
