"""Frequencies, evidence, tiers, carriers."""

import pytest
from pyspark.sql import functions as F

from allelio.config import KNOWN_MECHANISM, PLP_GENES, TIER_GENES
from allelio.operators import carriers, evidence, frequency, intervals, nested, tiers
from allelio.plans import pipelines

GENO = "contig string, pos bigint, ref string, alt string, sample_id string, alt_dosage int"
KEY = ["contig", "pos", "ref", "alt"]


@pytest.fixture(scope="module")
def samples(spark):
    rows = [("m1", "eur", "male"), ("m2", "eur", "male"), ("f1", "eur", "female"), ("a1", "afr", "female"), ("z", "unknown", "male")]
    return spark.createDataFrame(rows, "sample_id string, ancestry string, sex string")


def test_frequency_counts_ploidy_and_missing_calls(spark, samples):
    calls = [
        ("chr1", 5, "A", "G", "m1", 2), ("chr1", 5, "A", "G", "m2", None), ("chr1", 5, "A", "G", "a1", 1), ("chr1", 5, "A", "G", "z", 2),
        ("chrX", 9_000_000, "A", "G", "m1", 2), ("chrX", 9_000_000, "A", "G", "m2", 1), ("chrX", 9_000_000, "A", "G", "f1", 1),
        ("chrX", 20_000, "A", "G", "m1", 2),  # pseudo-autosomal
    ]
    af = frequency.allele_freq(spark.createDataFrame(calls, GENO), samples, KEY)
    got = {(r.contig, r.pos, r.ancestry): (r.alt_ct, r.obs_ct, r.alt_freq) for r in af.collect()}
    assert got == {
        ("chr1", 5, "eur"): (2, 4, 0.5),
        ("chr1", 5, "afr"): (1, 2, 0.5),
        ("chrX", 9_000_000, "eur"): (2, 3, 2 / 3),  # m1 one allele, m2 no valid call, f1 one of two
        ("chrX", 20_000, "eur"): (2, 6, 2 / 6),
    }
    wide = frequency.cohort_popmax(spark.createDataFrame(calls, GENO), samples, KEY)
    best = {(r.contig, r.pos): (r.af_eur, r.af_afr, r.max_value) for r in wide.collect()}
    assert best == {("chr1", 5): (0.5, 0.5, 0.5), ("chrX", 9_000_000): (2 / 3, None, 2 / 3), ("chrX", 20_000): (2 / 6, None, 2 / 6)}


def test_frequency_without_called_alleles_is_null(spark, samples):
    calls = [("chr1", 5, "A", "G", "a1", None)]
    af = frequency.allele_freq(spark.createDataFrame(calls, GENO), samples, KEY)
    assert [(r.alt_ct, r.obs_ct, r.alt_freq) for r in af.collect()] == [(0, 0, None)]
    assert frequency.cohort_popmax(spark.createDataFrame(calls, GENO), samples, KEY).first().max_value is None


def test_counts_do_not_depend_on_partitions(spark, samples, rows):
    calls = spark.range(2000).select(
        F.lit("chr1").alias("contig"), (F.col("id") % 7).alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"),
        F.element_at(F.array(*[F.lit(s) for s in ("m1", "m2", "f1", "a1")]), (F.col("id") % 4 + 1).cast("int")).alias("sample_id"),
        (F.col("id") % 3).cast("int").alias("alt_dosage"),
    )
    assert rows(frequency.allele_freq(calls.repartition(1), samples, KEY)) == rows(frequency.allele_freq(calls.repartition(17), samples, KEY))


def test_combined_frequency_keeps_one_row_per_variant(spark, rows):
    # The same variant from two datasets and two overlapping genes.
    af = spark.createDataFrame(
        [("v", "eur", 0.1, "eur_TTN_2_1-2_2.afreq"), ("v", "eur", 0.2, "eur_DES_2_1-2_3.afreq"), ("v", "afr", 0.0, "x"), ("v", "mid", float("nan"), "x")],
        "variant_id string, ancestry string, alt_freq double, gene string",
    )
    wide = frequency.popmax_wide(frequency.combine_af(af, ["variant_id"]))
    row = wide.first()
    assert wide.count() == 1 and row.af_eur == 0.2 and row.af_afr is None and row.af_mid is None and row.max_value == 0.2
    assert carriers.final_gene(wide).first().genes_final == "DES"
    assert rows(frequency.combine_af_joined(af, ["variant_id"])) == rows(wide.select("variant_id", *[f"af_{a}" for a in frequency.ANCESTRIES]))


def test_founders(spark):
    fam = spark.createDataFrame([("a", "0", "0"), ("b", "a", "0")], "sample_id string, father_id string, mother_id string")
    assert [r.sample_id for r in frequency.founders(fam).collect()] == ["a"]


def test_ancestry_columns_leave_out_the_total(spark):
    df = spark.sql("SELECT array(named_struct('AC', 100), named_struct('AC', 1), named_struct('AC', 2)) AS freq")
    row = df.select(*nested.array_to_columns("freq", ["AC"], nested.ancestry_index())).first()
    assert (row.afr_AC, row.amr_AC, row.asj_AC) == (1, 2, None)


def test_public_and_cohort_keys_meet(spark, rows):
    public = spark.createDataFrame(
        [("chr1:5", '["A","G"]', 0.0005), ("chr1:6", '["A","G"]', 0.5), ("chr1:7", '["A","G"]', None)],
        "locus string, alleles string, joint_grpmax_AF double",
    )
    rare = pipelines.public_rare(public)
    assert rows(rare) == [("1", 5, "A", "G", 0.0005)]
    cohort = spark.createDataFrame([("1", 5, "A", "G", 0.0001), ("1", 8, "A", "G", 0.0001)], "contig string, pos bigint, ref string, alt string, max_value double")
    assert rows(frequency.rare_ids(cohort, rare, KEY)) == [("1", 5, "A", "G"), ("1", 8, "A", "G")]


def test_clinvar_classes(spark):
    two = "criteria_provided,_multiple_submitters,_no_conflicts"
    df = spark.createDataFrame(
        [("Pathogenic", two), ("Benign", two), ("Pathogenic", "no_assertion"), (None, two), ("Pathogenic|risk", two)], "clnsig string, clnrevstat string"
    )
    assert evidence.clinvar_filter(df).count() == 1
    assert evidence.clinvar_filter(df, include_benign=True).count() == 2


def test_gene_rules(spark, rows):
    exons = spark.createDataFrame([("2", 100, 200)], "contig string, start_pos bigint, end_pos bigint")
    lof = spark.createDataFrame([("2", 150, "TTN"), ("2", 500, "TTN"), ("9", 150, "TTN"), ("2", 500, "DES"), ("2", 1, None)], "contig string, pos bigint, gene string")
    assert rows(evidence.lof_in_high_psi(lof, exons)) == [("2", 1, None), ("2", 150, "TTN"), ("2", 500, "DES")]

    missense = spark.createDataFrame([(1, "SCN5A"), (2, "SCN5A"), (3, "MYH7"), (4, "MYH7"), (5, None)], "id int, gene string")
    annovar = spark.createDataFrame([(1, "0.7"), (2, "0.7"), (3, "."), (4, "0.1")], "id int, revel_scalar string")
    intervar = spark.createDataFrame([(1, "InterVar: Likely pathogenic"), (2, "InterVar: Benign")], "id int, intervar string")
    scores = spark.createDataFrame([(2, "[0.9]"), (3, "[null,0.9]"), (4, "[0.1]"), (5, "[0.65]")], "id int, revel_score string")
    got = rows(evidence.missense_supported(missense, scores, annovar, intervar, ["id"]).select("id", "gene"))
    assert got == [(1, "SCN5A"), (3, "MYH7"), (5, None)]


def test_tier_table(spark):
    rows = tiers.tier_table(spark).collect()
    assert len(rows) == len(set(rows))
    assert {len(v) for v in TIER_GENES.values()} == {14, 8, 6} and {len(v) for v in PLP_GENES.values()} == {14, 9, 8}
    assert len(KNOWN_MECHANISM["lof"]) == 13 and len(KNOWN_MECHANISM["missense"]) == 15
    assert {(r.gene, r.impact, r.faf_cutoff) for r in rows if r.disease == "hcm" and r.impact == "lof"} == {("MYBPC3", "lof", 4e-05)}


def test_tiers_take_either_frequency_and_keep_diseases_apart(spark):
    variants = spark.createDataFrame(
        [(1, "MYH7", "missense"), (2, "MYH7", "missense"), (3, "MYH7", "missense"), (4, "MYH7", "lof"), (5, "TTN", "lof"), (6, "TTN", "missense")],
        "id int, gene string, impact string",
    )
    cohort = spark.createDataFrame([(1, 3e-05), (2, 5e-05), (3, 0.0009), (4, 0.0)], "id int, max_value double")
    public = spark.createDataFrame([(2, 1e-05), (5, 8.4e-05), (6, 0.0)], "id int, max_value double")
    got = {(r.id, r.disease, r.impact) for r in tiers.tiered_variants(variants, cohort, public, ["id"]).collect()}
    assert got == {(1, "dcm", "missense"), (1, "hcm", "missense"), (2, "dcm", "missense"), (2, "hcm", "missense"), (5, "dcm", "lof")}


def test_clinvar_goes_by_geneinfo_then_gene(spark):
    df = spark.createDataFrame([("MYH7:1|X:2", "OTHER"), (None, "PKP2"), ("NOPE:1", "TTN")], "geneinfo string, gene string")
    got = {(r.geneinfo, r.disease) for r in tiers.clinvar_by_disease(df).collect()}
    assert got == {("MYH7:1|X:2", "dcm"), ("MYH7:1|X:2", "hcm"), (None, "arvc")}


CALLS = "v int, sample_id string, alt_dosage int"
SETS = "v int, gene string, disease string, impact string"


def test_burden_null_rule(spark):
    sets = spark.createDataFrame([(1, "TTN", "dcm", "lof"), (2, "TTN", "dcm", "lof"), (2, "TTN", "dcm", "lof"), (3, "DES", "dcm", "lof")], SETS)
    calls = spark.createDataFrame(
        [(1, "a", None), (2, "a", None), (1, "b", None), (2, "b", 2), (1, "c", None), (3, "d", None), (3, "e", 1), (9, "f", 2)], CALLS
    )
    got = {(r.sample_id, r.gene): r.burden for r in carriers.burden(calls, sets, ["v"]).collect()}
    # c: its second call is homozygous reference, so the sum is known.
    assert got == {("a", "TTN"): None, ("b", "TTN"): 2, ("c", "TTN"): 0, ("d", "DES"): None, ("e", "DES"): 1}
    zero = {(r.sample_id, r.gene): r.burden for r in carriers.burden(calls, sets, ["v"], na_as_zero=True).collect()}
    assert zero == {("a", "TTN"): 0, ("b", "TTN"): 2, ("c", "TTN"): 0, ("d", "DES"): 0, ("e", "DES"): 1}


def test_carrier_counts(spark):
    burdens = spark.createDataFrame(
        [("a", "MYH7", "dcm", "missense", 1), ("a", "MYH7", "hcm", "missense", 1), ("a", "TTN", "dcm", "lof", 3), ("b", "MYBPC3", "hcm", "lof", None)],
        "sample_id string, gene string, disease string, impact string, burden bigint",
    )
    got = {r.sample_id: r for r in carriers.carrier_counts(burdens).collect()}
    assert (got["a"].n_missense_carriers, got["a"].n_lp_p_pupv_carriers, got["a"].n_dcm_lp_p_pupv_carriers) == (2, 3, 2)
    assert got["a"].is_hcm_missense_carriers == 1 and got["a"].is_arvc_missense_carriers is None
    assert got["b"].n_hcm_lof_carriers == 0 and got["b"].is_hcm_lof_carriers is None
    assert {r.sample_id: r.n_lp_p_pupv_carriers for r in carriers.carrier_counts(burdens, distinct_genes=True).collect()} == {"a": 2, "b": 0}
    people = spark.createDataFrame([("a",), ("c",)], "sample_id string")
    whole = {r.sample_id: r for r in carriers.with_cohort(carriers.carrier_counts(burdens), people, fill=0).collect()}
    assert set(whole) == {"a", "c"} and whole["c"].n_lof_carriers == 0 and whole["c"].is_hcm_lof_carriers == 0
    assert whole["a"].is_arvc_missense_carriers is None


def test_wide_burden_has_every_column(spark):
    burdens = spark.createDataFrame([("a", "TTN", "dcm", "lof", 3)], "sample_id string, gene string, disease string, impact string, burden bigint")
    wide = carriers.burden_wide(burdens)
    assert wide.columns == ["sample_id", *carriers.burden_columns()]
    assert wide.first()["TTN_dcm_lof"] == 3 and wide.first()["MYH7_hcm_lof"] is None


def test_run_cohort(spark, tmp_path, rows):
    def ann(alt, effect, gene):
        return f"{alt}|{effect}|HIGH|{gene}|E|transcript|NM|pc|1/2|c.1|p.1"

    variant_rows = [
        ("chr2", 178_600_000, "r1", "A", ["G", "T"], "ANN=" + ann("G", "stop_gained", "TTN") + "," + ann("T", "synonymous_variant", "TTN")),
        ("chr2", 178_700_000, "r2", "A", ["G"], "ANN=" + ann("G", "stop_gained", "TTN")),  # no high-PSI exon
        ("chr14", 23_400_000, "r3", "C", ["T"], "ANN=" + ann("T", "missense_variant", "MYH7") + "," + ann("T", "missense_variant", "MYH6") + ";GENEINFO=MYH7:4625;CLNSIG=Pathogenic;CLNREVSTAT=reviewed_by_expert_panel"),
        ("chr9", 5, "r4", "C", ["T"], "ANN=" + ann("T", "stop_gained", "TTN")),  # outside the panel
    ]
    layout = "contig string, pos bigint, id string, ref string, alts array<string>, info string"
    failed = [("chr2", 178_600_500, "r5", "A", ["G"], "ANN=" + ann("G", "stop_gained", "TTN"))]
    x = pipelines.CohortInputs(
        rows=spark.createDataFrame(variant_rows, layout).withColumns({"source": F.lit("exome"), "filter": F.lit("x")}).unionByName(
            spark.createDataFrame(failed, layout).withColumns({"source": F.lit("wgs"), "filter": F.lit("LowQual")})
        ),
        genotypes=spark.createDataFrame(
            # Two datasets hold the same calls, a third one is not used.
            [(*call, d) for d in ("exome", "clinvar", "acaf") for call in (
                ("chr2", 178_600_000, "A", "G", "s1", 1), ("chr2", 178_700_000, "A", "G", "s2", 1), ("chr14", 23_400_000, "C", "T", "s2", 2),
            )] + [("chr9", 5, "C", "T", "s1", 2, "exome"), ("chr2", 178_600_000, "A", "G", "s3", 2, "acaf")],
            GENO + ", dataset string",
        ),
        samples=spark.createDataFrame([(f"s{i}", "eur") for i in range(1, 2001)], "sample_id string, ancestry string"),
        regions=intervals.region_panel(spark),
        public=spark.createDataFrame([("chr2:178600000", '["A","G"]', 1e-05), ("chr14:23400000", '["C","T"]', 2e-05)], "locus string, alleles string, joint_grpmax_AF double"),
        exons=spark.createDataFrame([("chr2", 178_599_000, 178_601_000)], "contig string, start_pos bigint, end_pos bigint"),
        annovar=spark.createDataFrame([], "contig string, pos bigint, ref string, alt string, revel_scalar string"),
        intervar=spark.createDataFrame([], "contig string, pos bigint, ref string, alt string, intervar string"),
        revel=spark.createDataFrame([("14", 23_400_000, "C", "T", "[0.9]")], "contig string, pos bigint, ref string, alt string, revel_score string"),
    )
    out = pipelines.run_cohort(x, str(tmp_path))
    assert rows(out["sets"].select("pos", "gene", "disease", "impact")) == [
        (178_600_000, "TTN", "dcm", "lof"), (23_400_000, "MYH7", "dcm", "lp_p"), (23_400_000, "MYH7", "dcm", "missense"),
        (23_400_000, "MYH7", "hcm", "lp_p"), (23_400_000, "MYH7", "hcm", "missense"),
    ]
    people = {r.sample_id: r for r in out["carriers"].filter("sample_id IN ('s1', 's2', 's3')").collect()}
    assert out["carriers"].count() == 2000
    assert (people["s1"].n_dcm_lof_carriers, people["s1"].n_missense_carriers) == (1, 0)
    assert (people["s2"].n_lof_carriers, people["s2"].n_missense_carriers, people["s2"].n_lp_p_carriers) == (0, 2, 2)
    assert people["s3"].n_lp_p_pupv_carriers == 0
    assert rows(out["rare_ids"]) == [("14", 23_400_000, "C", "T"), ("2", 178_600_000, "A", "G"), ("2", 178_700_000, "A", "G")]
    assert {r.pos: r.max_value for r in out["cohort_af"].collect()} == {178_600_000: 1 / 4000, 178_700_000: 1 / 4000, 23_400_000: 2 / 4000}
    assert rows(out["summary"]) == [("MYH7", 0, 1), ("TTN", 1, 0)]
    pipelines.export_cohort(out, str(tmp_path / "out"))
    (ids,) = (tmp_path / "out" / "variant_lists" / "impact=lof" / "disease=dcm" / "source=exome").glob("*.csv")
    assert ids.read_text() == "ID\n2:178600000:A:G\n"
    assert spark.read.parquet(str(tmp_path / "out" / "carriers")).count() == 2000


def test_variant_lists_narrow_the_genotype_scan(spark, tmp_path):
    import contextlib
    import io

    calls = spark.range(5000).select(
        F.lit("chr2").alias("contig"), (F.col("id") * 10_000).alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"),
        F.lit("s1").alias("sample_id"), F.lit(1).alias("alt_dosage"),
    )
    calls.write.parquet(str(tmp_path / "calls"))
    stored = spark.read.schema(GENO).parquet(str(tmp_path / "calls"))
    ids = spark.createDataFrame([("chr2", 50_000, "A", "G"), ("chr2", 70_000, "A", "G"), ("chr2", 70_001, "A", "G")], "contig string, pos bigint, ref string, alt string")
    got = carriers.extract_variants(stored, ids, KEY)
    assert sorted(r.pos for r in got.collect()) == [50_000, 70_000]
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        got.explain("formatted")
    assert "GreaterThanOrEqual(pos,50000), LessThanOrEqual(pos,70001)" in text.getvalue()
    sets = ids.selectExpr("*", "'TTN' AS gene", "'dcm' AS disease", "'lof' AS impact")
    assert [tuple(r) for r in carriers.burden(stored, sets, KEY).collect()] == [("s1", "TTN", "dcm", "lof", 2)]


def test_region_lists_narrow_a_scan_without_losing_rows(spark, tmp_path):
    import contextlib
    import io

    from allelio.operators import intervals as I
    from allelio.sources import readers, writers

    panel = I.region_panel(spark)
    rows = [(c, s, "A", "G", g, "x") for c, s, e, g in panel.select("contig", "start_pos", "end_pos", "gene").collect() for s in (s, s - 1, e - 1, e)]
    sites = spark.createDataFrame(rows + [("chr21", 5, "A", "G", "none", "x")], "contig string, pos bigint, ref string, alt string, gene string, effect string")
    want = I.filter_intervals(sites, panel).count()
    writers.write_by_position(sites, str(tmp_path / "by_position"))
    writers.save_stage(sites, str(tmp_path), "plain")
    for name, shown in (("by_position", "dynamicpruning"), ("plain", "LessThanOrEqual(pos,")):
        df = I.filter_intervals(readers.read_sites(spark, str(tmp_path / name), regions=panel), panel)
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            df.explain("formatted")
        assert shown in text.getvalue()
        assert df.count() == want
    plain = panel.withColumn("contig", F.regexp_replace("contig", "^chr", ""))
    for stored in ("by_position", "plain"):
        assert I.filter_intervals(readers.read_sites(spark, str(tmp_path / stored), regions=plain), panel).count() == want
    kept = readers.read_sites(spark, str(tmp_path / "by_position"), place=True)
    assert "place_100kb" in kept.columns and I.filter_intervals(I.prune_to_regions(kept, plain, either_style=True), panel).count() == want
    narrowed = I.prune_to_regions(spark.read.parquet(str(tmp_path / "plain")), plain, either_style=True)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        narrowed.explain("formatted")
    assert "PushedFilters: [Or(" in text.getvalue() and "IN (X,chrX) AND (pos" in text.getvalue()


def scanned_rows(df):
    """Rows that the file scans of a query handed on, from its plan's metrics after it has run."""
    df.collect()
    total, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            open_.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            open_.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        open_ += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_a_scan_reads_little_more_than_its_regions(spark, tmp_path):
    from allelio.operators import intervals as I
    from allelio.sources import readers, writers

    # Of the whole panel, places of 100,000 bases are at most 1.2 times the bases of its regions; 24 ranges are 20 times.
    panel = I.region_panel(spark)
    bases = sum(e - s for _, s, e in I.merge_spans([tuple(r) for r in panel.select("contig", "start_pos", "end_pos").collect()]))
    assert I.places(panel, "place_100kb").count() * 100_000 <= 1.2 * bases
    # Sites every 10,000 bases over 5 million of two contigs, 30 regions: more than one filter's ranges.
    sites = spark.range(1_000).selectExpr("concat('chr', 1 + id % 2) AS contig", "(id div 2) * 10000 AS pos", "'A' AS ref", "'G' AS alt", "'x' AS gene", "'y' AS effect")
    spans = [(f"chr{1 + i % 2}", 100_000 + i * 300_000 // 2, 100_000 + i * 300_000 // 2 + 70_000 + 2_000 * (i % 9)) for i in range(30)]
    regions = spark.createDataFrame(spans, "contig string, start_pos bigint, end_pos bigint")
    want = I.filter_intervals(sites, regions).count()
    writers.write_by_position(sites, str(tmp_path / "placed"))
    writers.write_by_position(sites, str(tmp_path / "wide"), place="place_mb")
    sites.repartition(1).sortWithinPartitions("contig", "pos").write.option("parquet.block.size", 4096).option("parquet.page.size", 1024).parquet(str(tmp_path / "sorted"))
    read = {}
    for name in ("placed", "wide", "sorted"):
        narrowed = readers.read_sites(spark, str(tmp_path / name), regions=regions)
        assert I.filter_intervals(narrowed, regions).count() == want
        read[name] = scanned_rows(narrowed.select("contig", "pos"))
        plain = regions.withColumn("contig", F.regexp_replace("contig", "^chr", ""))
        assert I.filter_intervals(readers.read_sites(spark, str(tmp_path / name), regions=plain), regions).count() == want
    # Rows of the places, besides the list of places itself.
    listed = I.places(regions, "place_100kb").count()
    assert read["placed"] == listed * 10 + listed
    assert read["wide"] > read["placed"]
    # Contig by contig, each with all its ranges: the filter keeps just the regions' rows, without one long condition.
    ranges = readers.read_sites(spark, str(tmp_path / "sorted"), regions=regions)
    assert want <= ranges.count() <= want + 2 * len(spans)


def test_spans_are_merged_by_the_smallest_gap():
    from allelio.operators.intervals import merge_spans

    spans = [("a", 1, 5), ("a", 4, 9), ("a", 20, 30), ("a", 31, 40), ("b", 41, 50)]
    assert merge_spans(spans) == [("a", 1, 9), ("a", 20, 30), ("a", 31, 40), ("b", 41, 50)]
    assert merge_spans(spans, 3) == [("a", 1, 9), ("a", 20, 40), ("b", 41, 50)]
    assert merge_spans(spans, 2) == [("a", 1, 40), ("b", 41, 50)]
    assert merge_spans(spans, 1) == [("a", 1, 40), ("b", 41, 50)]


def test_long_region_lists_still_narrow(spark):
    from allelio.operators.intervals import prune_to_regions

    df = spark.range(100_000, numPartitions=2).selectExpr("'chr1' AS contig", "id AS pos")
    many = spark.range(5001).selectExpr("'chr1' AS contig", "1000 + id * 10 AS start_pos", "1000 + id * 10 + 1 AS end_pos")
    want = set(range(1000, 51_002))
    assert {r.pos for r in prune_to_regions(df, many).collect()} == want
    assert {r.pos for r in prune_to_regions(df, many, span=100, most=50).collect()} == want
    assert prune_to_regions(df, many.limit(0)) is df


def test_one_key_for_indels_of_every_table(spark, tmp_path, rows):
    def ann(alt):
        return f"ANN={alt}|frameshift_variant|HIGH|TTN|E|transcript|NM|pc|1/2|c.1|p.1"

    seq = "GATTTTTTC"
    layout = "contig string, pos bigint, id string, ref string, alts array<string>, info string, source string, filter string"
    empty = "contig string, pos bigint, ref string, alt string"
    x = pipelines.CohortInputs(
        rows=spark.createDataFrame([("chr2", 7, "r1", "TT", ["T"], ann("T"), "exome", "PASS")], layout),
        genotypes=spark.createDataFrame([("chr2", 7, "TT", "T", "s1", 1), ("chr2", 5, "TT", "T", "s2", 1)], GENO),
        samples=spark.createDataFrame([(f"s{i}", "eur") for i in range(1, 2001)], "sample_id string, ancestry string"),
        regions=spark.createDataFrame([("TTN", "chr2", 1, 10)], "gene string, contig string, start_pos bigint, end_pos bigint"),
        public=spark.createDataFrame([("chr2:6", '["TT","T"]', 1e-05)], "locus string, alleles string, joint_grpmax_AF double"),
        exons=spark.createDataFrame([("chr2", 1, 10)], "contig string, start_pos bigint, end_pos bigint"),
        annovar=spark.createDataFrame([], empty + ", revel_scalar string"),
        intervar=spark.createDataFrame([], empty + ", intervar string"),
        revel=spark.createDataFrame([], empty + ", revel_score string"),
        genome=spark.createDataFrame([("chr2", i // 4, seq[i : i + 4]) for i in range(0, len(seq), 4)], "contig string, chunk_no bigint, seq string"),
        chunk=4,
    )
    out = pipelines.run_cohort(x, str(tmp_path))
    assert rows(out["sets"].select(*KEY, "gene", "disease", "impact")) == [("2", 2, "AT", "A", "TTN", "dcm", "lof")]
    assert rows(out["public_rare"].select(*KEY)) == [("2", 2, "AT", "A")]
    assert [(r.pos, r.max_value) for r in out["cohort_af"].collect()] == [(2, 2 / 4000)]
    assert rows(out["carriers"].filter("n_lof_carriers = 1").select("sample_id")) == [("s1",), ("s2",)]
    assert rows(out["summary"]) == [("TTN", 1, 0)]


def test_consequences_are_aligned_after_alleles_met_their_annotation(spark):
    def ann(alt, effect):
        return f"{alt}|{effect}|HIGH|TTN|E|transcript|NM|pc|1/2|c.1|p.1"

    seq = "GATTTTTTC"
    df = spark.createDataFrame(
        [("c", 7, "TT", ["T", "TTA"], "ANN=" + ann("T", "frameshift_variant") + "," + ann("TTA", "stop_gained"))],
        "contig string, pos bigint, ref string, alts array<string>, info string",
    )
    genome = spark.createDataFrame([("c", i // 4, seq[i : i + 4]) for i in range(0, len(seq), 4)], "contig string, chunk_no bigint, seq string")
    known = spark.createDataFrame([("c", 2, "AT", "A", "TTN:1", "Pathogenic", "x")], "contig string, pos bigint, ref string, alt string, GENEINFO string, CLNSIG string, CLNREVSTAT string")
    out = pipelines.categorised_consequences(df, clinvar=known, genome=genome, chunk=4)
    got = sorted((r.POS, r.REF, r.ALT, r.ALLELE, r.EFFECT, r.CLNSIG, r.category) for r in out.collect() if r.category != "clinvar")
    # The deletion moves to the start of the run, where ClinVar knows it; the insertion of "A" cannot move.
    assert got == [(2, "AT", "A", "T", "frameshift_variant", "Pathogenic", "lof"), (8, "T", "TA", "TTA", "stop_gained", None, "lof")]


def test_calls_in_buckets_of_samples_are_not_shuffled_for_the_join(spark, tmp_path, no_broadcast):
    import contextlib
    import io

    from allelio.operators import frequency
    from allelio.sources import buckets

    calls = spark.range(4000).selectExpr("'chr1' AS contig", "id % 37 AS pos", "'A' AS ref", "'G' AS alt", "id % 90 AS sample_id", "CAST(CASE WHEN id % 11 = 0 THEN NULL ELSE 1 + id % 2 END AS INT) AS alt_dosage")
    people = spark.range(90).selectExpr("id AS sample_id", "CASE WHEN id % 2 = 0 THEN 'eur' ELSE 'afr' END AS ancestry")
    want = sorted(map(tuple, frequency.cohort_popmax(calls, people, KEY).collect()))
    stored = [buckets.write_buckets(t, str(tmp_path / n), buckets=4) for n, t in (("calls", calls), ("people", people))]
    for left, right in (stored, [buckets.read_buckets(spark, str(tmp_path / n), ", ".join(f"{c} {k}" for c, k in t.dtypes), buckets=4) for n, t in (("calls", calls), ("people", people))]):
        got = frequency.cohort_popmax(left, right, KEY, bucketed=True)
        assert sorted(map(tuple, got.collect())) == want
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            got.explain("formatted")
        assert "hashpartitioning(sample_id" not in text.getvalue() and "SortMergeJoin" in text.getvalue()


def test_consequences_are_dealt_out_by_bytes(spark):
    import contextlib
    import io

    rows = spark.range(0, 100, 1, 1).selectExpr("'c' AS contig", "id AS pos", "'A' AS ref", "'G' AS alts", "'ANN=G|stop_gained|HIGH|TTN' AS info")
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        pipelines.consequence_table(rows).explain("formatted")
    assert "REBALANCE_PARTITIONS" in text.getvalue()
    assert pipelines.consequence_table(rows).count() == 100


def star_tables(spark, folder, calls):
    """Test tables of ``calls`` line items over 20 parts and 30 customers."""
    tables = {
        "customer": ["id AS c_custkey", "CAST(id % 7 AS INT) AS c_nationkey"],
        "part": ["id AS p_partkey", "concat('Brand#', 1 + id % 3) AS p_brand", "'ECONOMY' AS p_type", "CAST(id % 5 AS INT) AS p_size"],
        "orders": ["id AS o_orderkey", "id % 30 AS o_custkey"],
        "lineitem": ["id AS l_orderkey", "id * 13 % 20 AS l_partkey", "CAST(id % 50 AS DOUBLE) AS l_quantity", "CAST(id % 9 AS DOUBLE) / 100 AS l_tax"],
    }
    for name, columns in tables.items():
        n = {"customer": 30, "part": 20}.get(name, calls)
        spark.range(n).selectExpr(*columns).write.parquet(f"{folder}/{name}.parquet")


def test_buckets_grow_in_number_with_the_calls(spark, tmp_path, monkeypatch, rows):
    from allelio.catalog import QUERIES, analyses

    star_tables(spark, tmp_path, 400)
    used, write = [], analyses.buckets.write_buckets
    monkeypatch.setattr(analyses.buckets, "write_buckets", lambda df, path, buckets: used.append(buckets) or write(df, path, buckets=buckets))
    few = rows(QUERIES["allele_frequency_founders"](spark, str(tmp_path)))
    monkeypatch.setattr(analyses, "CALLS_PER_BUCKET", 50)
    assert rows(QUERIES["allele_frequency_founders"](spark, str(tmp_path))) == few and few
    assert used == [4, 4, 8, 8]


def test_plink_sets_of_a_gene_are_cut_by_calls(spark, tmp_path, monkeypatch, rows):
    from allelio.catalog import QUERIES, sources

    star_tables(spark, tmp_path / "in", 600)
    whole = rows(QUERIES["scan_plink_bed"](spark, str(tmp_path / "in")))
    monkeypatch.setattr(sources, "CALLS_PER_SET", 10)
    assert rows(QUERIES["scan_plink_bed"](spark, str(tmp_path / "in"))) == whole and len(whole) > 50
    calls = spark.range(200).selectExpr("'exome' AS dataset", "'TTN' AS gene", "'chr1' AS contig", "id % 40 AS pos", "'A' AS ref", "'G' AS alt", "id AS sample_id", "1 AS alt_dosage")
    sources.write_plink_sets(calls, f"file://{tmp_path}/sets")
    cells = [len(f.read_bytes()) - 3 for f in (tmp_path / "sets" / "exome").glob("*.bed")]
    assert len(cells) > 5 and sum(cells) < 40 * 200 // 4 // 3
