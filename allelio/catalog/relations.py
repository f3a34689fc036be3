"""Filters, joins, aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelio.catalog.registry import query
from allelio.catalog.sources import DATASET, VID
from allelio.config import ANCESTRIES, CARRIER_GENES, DISEASES, IMPACTS, TIER_GENES, VARIANT_KEY
from allelio.functions import fields, keys
from allelio.operators import annotation, carriers, evidence, frequency, intervals
from allelio.operators import joins as J

ID = ["site_id"]


def sites(fx, *cols):
    df = fx.view("g_site")
    return df.select(*cols) if cols else df


def freq(fx):
    return frequency.allele_freq(fx.view("g_geno"), fx.view("g_sample"), ID)


def cutoff(fx, k: float):
    """k / number of samples, as a scalar subquery."""
    return fx.view("g_sample").agg(F.lit(k) / F.count(F.lit(1))).scalar()


# --- filters ------------------------------------------------------------------

IN_REGION = "EXISTS (SELECT 1 FROM g_region r WHERE r.contig = s.contig AND s.pos >= r.start_pos AND s.pos {op} r.end_pos)"


@query("interval_filter", ["g_site", "g_region"], f"SELECT site_id, contig, pos FROM g_site s WHERE {IN_REGION.format(op='<')}")
def interval_filter(fx):
    return intervals.filter_intervals(sites(fx, "site_id", "contig", "pos"), fx.view("g_region"))


@query("region_filter_closed", ["g_site", "g_region"], f"SELECT site_id, contig, pos FROM g_site s WHERE {IN_REGION.format(op='<=')}")
def region_filter_closed(fx):
    return intervals.filter_intervals(sites(fx, "site_id", "contig", "pos"), fx.view("g_region"), closed=True, prune=True)


@query("pass_filter", ["g_vcf"], "SELECT site_id, id FROM g_vcf WHERE filter = 'PASS'")
def pass_filter(fx):
    return annotation.filter_pass(fx.view("g_vcf")).select("site_id", "id")


def _flagged(fx, name):
    rows = sites(fx).select("site_id", F.col("effect").alias("EFFECT"), F.col("clnsig").alias("CLNSIG"))
    return rows.filter(annotation.category_flags()[name]).select("site_id")


@query("categorise_plp", ["g_site"], "SELECT site_id FROM g_site WHERE regexp_matches(clnsig, 'Pathogenic|Likely_pathogenic')")
def categorise_plp(fx):
    return _flagged(fx, "clinvar")


@query(
    "categorise_lof",
    ["g_site"],
    "SELECT site_id FROM g_site WHERE regexp_matches(effect, 'stop_gained|frameshift|start_lost|splice')",
)
def categorise_lof(fx):
    return _flagged(fx, "lof")


@query("categorise_missense", ["g_site"], "SELECT site_id FROM g_site WHERE effect LIKE '%missense%'")
def categorise_missense(fx):
    return _flagged(fx, "missense")


@query(
    "in_list",
    ["g_site"],
    "SELECT site_id, gene, clnsig FROM g_site WHERE gene IN ('TTN', 'MYH7', 'LMNA') AND clnsig IN ('Pathogenic', 'Benign')",
)
def in_list(fx):
    chosen = fields.is_in("gene", ["TTN", "MYH7", "LMNA"]) & fields.is_in("clnsig", ["Pathogenic", "Benign"])
    return sites(fx, "site_id", "gene", "clnsig").filter(chosen)


@query(
    "not_in_list",
    ["g_site"],
    "SELECT site_id, clnsig FROM g_site WHERE clnsig IS NULL OR clnsig NOT IN ('Pathogenic', 'Benign')",
)
def not_in_list(fx):
    return sites(fx, "site_id", "clnsig").filter(fields.not_in("clnsig", ["Pathogenic", "Benign"]))


@query("threshold", ["g_gnomad"], "SELECT locus, joint_grpmax_af FROM g_gnomad WHERE joint_grpmax_af <= 0.001")
def threshold(fx):
    return frequency.rare(fx.view("g_gnomad").select("locus", "joint_grpmax_af"), col="joint_grpmax_af")


@query("nonzero_af", ["g_af"], "SELECT site_id, ancestry, alt_ct FROM g_af WHERE alt_ct > 0")
def nonzero_af(fx):
    return frequency.nonzero_af(freq(fx)).select("site_id", "ancestry", "alt_ct")


PLP = "('Pathogenic', 'Likely_pathogenic', 'Pathogenic/Likely_pathogenic')"
STARS = "('criteria_provided,_multiple_submitters,_no_conflicts', 'reviewed_by_expert_panel')"


@query(
    "clnsig_in",
    ["g_site"],
    "SELECT site_id, clnsig FROM g_site WHERE clnsig IN ('Pathogenic', 'Likely_pathogenic', 'Pathogenic/Likely_pathogenic', 'Benign')",
)
def clnsig_in(fx):
    return evidence.clinvar_significance(sites(fx, "site_id", "clnsig"), include_benign=True)


@query("clinvar_two_star", ["g_site"], f"SELECT site_id, clnrevstat FROM g_site WHERE clnrevstat IN {STARS}")
def clinvar_two_star(fx):
    return evidence.clinvar_two_star(sites(fx, "site_id", "clnrevstat"))


@query("regex_contains", ["g_revel"], "SELECT site_id, intervar FROM g_revel WHERE intervar LIKE '%athogenic%'")
def regex_contains(fx):
    return evidence.intervar_pathogenic(fx.view("g_revel").select("site_id", "intervar"))


@query("not_null", ["g_gnomad"], "SELECT locus, joint_grpmax_af FROM g_gnomad WHERE joint_grpmax_af IS NOT NULL")
def not_null(fx):
    return fx.view("g_gnomad").select("locus", "joint_grpmax_af").filter(F.col("joint_grpmax_af").isNotNull())


REVEL_ANY = """SELECT DISTINCT site_id FROM (SELECT site_id, unnest(string_split(replace(replace(revel_score, '[', ''), ']', ''), ',')) AS x
 FROM g_revel) WHERE TRY_CAST(x AS DOUBLE) >= 0.65"""


@query("any_element_at_least", ["g_revel"], REVEL_ANY)
def any_element_at_least(fx):
    return evidence.revel_any(fx.view("g_revel")).select("site_id")


@query(
    "keep_samples",
    ["g_geno", "g_sample"],
    "SELECT site_id, sample_id, alt_dosage FROM g_geno WHERE sample_id IN (SELECT sample_id FROM g_sample WHERE ancestry = 'afr')",
)
def keep_samples(fx):
    afr = fx.view("g_sample").filter(F.col("ancestry") == "afr")
    return carriers.keep_samples(fx.view("g_geno").select("site_id", "sample_id", "alt_dosage"), afr)


@query(
    "extract_variants",
    ["g_geno", "g_site"],
    f"SELECT site_id, sample_id, alt_dosage FROM g_geno WHERE site_id IN (SELECT site_id FROM g_site WHERE clnsig IN {PLP})",
)
def extract_variants(fx):
    ids = evidence.clinvar_significance(sites(fx))
    return carriers.extract_variants(fx.view("g_geno").select("site_id", "sample_id", "alt_dosage"), ids, ID)


GENES24 = ", ".join(f"'{g}'" for g in CARRIER_GENES)


@query("gene_target_filter", ["g_site"], f"SELECT site_id, gene FROM g_site WHERE gene IN ({GENES24})")
def gene_target_filter(fx):
    return carriers.carrier_genes(sites(fx, "site_id", "gene"))


# --- burden -------------------------------------------------------------------

SETS = "(SELECT DISTINCT site_id, gene, disease, impact FROM g_tier) t"
BURDEN_SQL = f"""
SELECT sample_id, gene, disease, impact, CASE WHEN missing < size THEN total END AS burden FROM (
 SELECT sample_id, gene, disease, impact, CAST(coalesce(sum(alt_dosage), 0) AS BIGINT) AS total,
  count(CASE WHEN alt_dosage IS NULL THEN 1 END) AS missing FROM g_geno JOIN {SETS} USING (site_id) GROUP BY ALL) b
JOIN (SELECT gene, disease, impact, count(*) AS size FROM {SETS} GROUP BY ALL) n USING (gene, disease, impact)"""


def burdens(fx):
    return carriers.burden(fx.view("g_geno"), fx.view("g_tier"), ID)


@query("gene_burden", ["g_geno", "g_tier"], BURDEN_SQL)
def gene_burden(fx):
    return burdens(fx)


@query(
    "column_group_select",
    ["g_geno", "g_tier"],
    f"SELECT sample_id, gene, burden FROM ({BURDEN_SQL}) WHERE disease = 'dcm' AND impact = 'lof'",
)
def column_group_select(fx):
    return burdens(fx).filter((F.col("disease") == "dcm") & (F.col("impact") == "lof")).select("sample_id", "gene", "burden")


WIDE = [f"{g}_{d}_{i}" for d in DISEASES for g in TIER_GENES[d] for i in IMPACTS]


@query(
    "burden_pivot",
    ["g_geno", "g_tier"],
    "SELECT sample_id, "
    + ", ".join(f"CAST(sum(burden) FILTER (WHERE concat_ws('_', gene, disease, impact) = '{c}') AS BIGINT) AS \"{c}\"" for c in WIDE)
    + f" FROM ({BURDEN_SQL}) GROUP BY sample_id",
)
def burden_pivot(fx):
    return carriers.burden_wide(burdens(fx))


def _counts_sql(kind: str) -> str:
    def one(name, cond):
        if kind == "n":
            return f"count(*) FILTER (WHERE {cond} AND burden > 0) AS n_{name}"
        return f"max(CASE WHEN {cond} AND burden IS NOT NULL THEN CASE WHEN burden > 0 THEN 1 ELSE 0 END END) AS is_{name}"

    cols = [one(f"{i}_carriers", f"impact = '{i}'") for i in IMPACTS]
    cols += [one(f"{d}_{i}_carriers", f"disease = '{d}' AND impact = '{i}'") for d in DISEASES for i in IMPACTS]
    total = [one("lp_p_pupv_carriers", "true")] + [one(f"{d}_lp_p_pupv_carriers", f"disease = '{d}'") for d in DISEASES]
    return ", ".join(cols), ", ".join(total)


N_GROUPS, N_TOTALS = _counts_sql("n")
IS_GROUPS, IS_TOTALS = _counts_sql("is")
TOTAL_NAMES = ["lp_p_pupv_carriers", *[f"{d}_lp_p_pupv_carriers" for d in DISEASES]]


def _counted(fx, prefix, totals, **kw):
    df = carriers.carrier_counts(burdens(fx), **kw)
    return df.select(
        "sample_id", *[c for c in df.columns if c.startswith(prefix) and (c.removeprefix(prefix) in TOTAL_NAMES) == totals]
    )


@query("carrier_counts", ["g_geno", "g_tier"], f"SELECT sample_id, {N_GROUPS} FROM ({BURDEN_SQL}) GROUP BY sample_id")
def carrier_counts(fx):
    return _counted(fx, "n_", False)


@query("carrier_totals", ["g_geno", "g_tier"], f"SELECT sample_id, {N_TOTALS} FROM ({BURDEN_SQL}) GROUP BY sample_id")
def carrier_totals(fx):
    return _counted(fx, "n_", True)


@query("carrier_flag", ["g_geno", "g_tier"], f"SELECT sample_id, {IS_GROUPS} FROM ({BURDEN_SQL}) GROUP BY sample_id")
def carrier_flag(fx):
    return _counted(fx, "is_", False)


@query(
    "carrier_totals_distinct_genes",
    ["g_geno", "g_tier"],
    f"""SELECT sample_id, count(DISTINCT CASE WHEN burden > 0 THEN gene END) AS n_lp_p_pupv_carriers, """
    + ", ".join(f"count(DISTINCT CASE WHEN burden > 0 AND disease = '{d}' THEN gene END) AS n_{d}_lp_p_pupv_carriers" for d in DISEASES)
    + f" FROM ({BURDEN_SQL}) GROUP BY sample_id",
)
def carrier_totals_distinct_genes(fx):
    return _counted(fx, "n_", True, distinct_genes=True)


# --- joins --------------------------------------------------------------------

INTERVAL_SQL = """SELECT s.site_id, s.contig, s.pos, r.gene AS region_gene, r.start_pos, r.end_pos FROM g_site s JOIN g_region r
 ON r.contig = s.contig AND s.pos >= r.start_pos AND s.pos < r.end_pos"""


def _interval_join(fx, **kw):
    regions = fx.view("g_region").withColumnRenamed("gene", "region_gene")
    return intervals.interval_join(sites(fx, "site_id", "contig", "pos"), regions, **kw)


@query("interval_join", ["g_site", "g_region"], INTERVAL_SQL)
def interval_join(fx):
    return _interval_join(fx)


@query("interval_join_binned", ["g_site", "g_region"], INTERVAL_SQL)
def interval_join_binned(fx):
    # As for region lists too large to broadcast: shuffled by contig, bin and salt.
    return _interval_join(fx, bin_size=1000, max_bytes=0)


@query(
    "genotype_region_join",
    ["g_geno", "g_site", "g_region"],
    f"""SELECT DISTINCT g.site_id, sample_id, alt_dosage, r.gene, {DATASET.replace('site_id', 'g.site_id')} AS dataset FROM g_geno g JOIN g_site s USING (site_id)
 JOIN g_region r ON r.contig = s.contig AND s.pos BETWEEN r.start_pos AND r.end_pos""",
)
def genotype_region_join(fx):
    calls = fx.view("g_geno").withColumn("dataset", F.expr(DATASET))
    return intervals.subset_genotypes(calls, sites(fx), fx.view("g_region"), ID).select(
        "site_id", "sample_id", "alt_dosage", "gene", "dataset"
    )


@query(
    "padded_interval_semi",
    ["g_site", "g_hipsi"],
    """SELECT site_id, contig, pos FROM g_site s WHERE EXISTS (
 SELECT 1 FROM g_hipsi h WHERE h.contig = s.contig AND s.pos BETWEEN h.start_pos - 10 AND h.end_pos + 10)""",
)
def padded_interval_semi(fx):
    return intervals.near_intervals(sites(fx, "site_id", "contig", "pos"), fx.view("g_hipsi"))


@query(
    "annotate_by_variant",
    ["g_vcf", "g_site"],
    """SELECT v.site_id, contig, pos, v.ref, s.clnsig, CASE WHEN s.clnsig IS NOT NULL THEN s.clnrevstat END AS clnrevstat
FROM g_vcf v JOIN g_site s USING (site_id, contig, pos)""",
)
def annotate_by_variant(fx):
    known = sites(fx).filter(F.col("clnsig").isNotNull())
    table = known.unionByName(known)  # a table that lists its variants twice adds no rows
    return J.annotate(
        sites(fx, "site_id", *VARIANT_KEY), table.select(*VARIANT_KEY, "clnsig", "clnrevstat"), VARIANT_KEY, ["clnsig", "clnrevstat"]
    ).select("site_id", "contig", "pos", "ref", "clnsig", "clnrevstat")


AF_WIDE = ", ".join(f"max(CASE WHEN ancestry = '{a}' THEN CAST(alt_ct AS DOUBLE) / obs_ct END) AS af_{a}" for a in ANCESTRIES)
COMBINED_SQL = f"SELECT site_id, {AF_WIDE} FROM g_af WHERE alt_ct > 0 GROUP BY site_id"


@query("full_outer_chain", ["g_af"], COMBINED_SQL)
def full_outer_chain(fx):
    return frequency.combine_af(freq(fx), ID)


@query("full_outer_chain_joined", ["g_af"], COMBINED_SQL)
def full_outer_chain_joined(fx):
    return frequency.combine_af_joined(freq(fx), ID)


@query("semi_join_ids", ["g_site", "g_revel"], f"SELECT site_id, gene FROM g_site WHERE site_id IN ({REVEL_ANY})")
def semi_join_ids(fx):
    return J.semi_join(sites(fx, "site_id", "gene"), evidence.revel_any(fx.view("g_revel")), ID)


@query(
    "semi_join_either",
    ["g_site", "g_revel", "g_gnomad"],
    f"SELECT site_id, gene FROM g_site WHERE site_id IN ({REVEL_ANY}) OR site_id IN (SELECT site_id FROM g_gnomad WHERE joint_grpmax_af <= 0.001)",
)
def semi_join_either(fx):
    rare = frequency.rare(fx.view("g_gnomad"), col="joint_grpmax_af")
    return J.semi_join_any(sites(fx, "site_id", "gene"), [evidence.revel_any(fx.view("g_revel")), rare], ID)


CONSENSUS = """SELECT site_id FROM g_revel WHERE TRY_CAST(revel_scalar AS DOUBLE) >= 0.65 AND intervar LIKE '%athogenic%'"""


@query("evidence_intersection", ["g_site", "g_revel"], f"SELECT site_id, gene FROM g_site WHERE site_id IN ({CONSENSUS})")
def evidence_intersection(fx):
    revel = fx.view("g_revel")
    return J.consensus(sites(fx, "site_id", "gene"), [evidence.revel_pass(revel), evidence.intervar_pathogenic(revel)], ID)


@query(
    "inner_merge_samples",
    ["g_geno", "g_site"],
    """SELECT sample_id, lof, missense FROM (SELECT sample_id, CAST(sum(alt_dosage) AS BIGINT) AS lof FROM g_geno JOIN g_site USING (site_id)
 WHERE effect = 'stop_gained' GROUP BY sample_id) a JOIN (SELECT sample_id, CAST(sum(alt_dosage) AS BIGINT) AS missense FROM g_geno JOIN g_site USING (site_id)
 WHERE effect = 'missense_variant' GROUP BY sample_id) b USING (sample_id)""",
)
def inner_merge_samples(fx):
    return J.inner_merge(_burdens_of(fx, {"lof": "stop_gained", "missense": "missense_variant"}), "sample_id")


def _burdens_of(fx, effects: dict[str, str]):
    """One table of ALT alleles per sample for each kind of effect, from the calls once."""
    calls = J.lookup_join(fx.view("g_geno"), sites(fx, "site_id", "effect"), ID)
    summed, _ = J.staged(calls.groupBy("sample_id", "effect").agg(F.sum("alt_dosage").alias("n")), "burdens")
    return [summed.filter(F.col("effect") == e).select("sample_id", F.col("n").alias(name)) for name, e in effects.items()]


FIVE = {"lof": "stop_gained", "fs": "frameshift_variant", "splice_missense": "missense_variant&splice_region_variant", "missense": "missense_variant", "silent": "synonymous_variant"}


@query(
    "inner_merge_five",
    ["g_geno", "g_site"],
    "SELECT sample_id, " + ", ".join(FIVE) + " FROM "
    + " JOIN ".join(
        f"(SELECT sample_id, CAST(sum(alt_dosage) AS BIGINT) AS {name} FROM g_geno JOIN g_site USING (site_id) WHERE effect = '{e}' GROUP BY sample_id) t_{name}"
        + (" USING (sample_id)" if i else "")
        for i, (name, e) in enumerate(FIVE.items())
    ),
)
def inner_merge_five(fx):
    return J.inner_merge(_burdens_of(fx, FIVE), "sample_id")


@query(
    "left_merge_cohort",
    ["g_sample", "g_geno", "g_tier"],
    f"SELECT sample_id, total FROM g_sample LEFT JOIN (SELECT sample_id, CAST(sum(burden) AS BIGINT) AS total FROM ({BURDEN_SQL}) GROUP BY sample_id) b USING (sample_id)",
)
def left_merge_cohort(fx):
    total = burdens(fx).groupBy("sample_id").agg(F.sum("burden").alias("total"))
    return carriers.with_cohort(total, fx.view("g_sample"))


@query("genotype_ancestry_join", ["g_geno", "g_sample"], "SELECT site_id, sample_id, alt_dosage, ancestry FROM g_geno JOIN g_sample USING (sample_id)")
def genotype_ancestry_join(fx):
    return J.lookup_join(fx.view("g_geno"), fx.view("g_sample"), "sample_id").select("site_id", "sample_id", "alt_dosage", "ancestry")


@query(
    "genotype_ancestry_join_shuffled",
    ["g_geno", "g_sample"],
    "SELECT site_id, sample_id, alt_dosage, ancestry FROM g_geno JOIN g_sample USING (sample_id)",
)
def genotype_ancestry_join_shuffled(fx):
    # As for cohorts too large to broadcast: shuffled by sample and salt.
    joined = J.lookup_join(fx.view("g_geno"), fx.view("g_sample"), "sample_id", max_bytes=0)
    return joined.select("site_id", "sample_id", "alt_dosage", "ancestry")


@query(
    "rule_override",
    ["g_site"],
    "SELECT site_id, gene, pos FROM g_site WHERE (gene = 'TTN' AND pos < 50000) OR (gene <> 'TTN' AND clnsig IS NOT NULL)",
)
def rule_override(fx):
    df = sites(fx, "site_id", "gene", "pos", "clnsig")
    return J.override_rule(df, "TTN", F.col("pos") < 50000, F.col("clnsig").isNotNull()).drop("clnsig")


# --- aggregations -------------------------------------------------------------


@query(
    "allele_frequency",
    ["g_af"],
    "SELECT site_id, ancestry, CAST(alt_ct AS BIGINT) AS alt_ct, CAST(obs_ct AS BIGINT) AS obs_ct, CAST(alt_ct AS DOUBLE) / obs_ct AS alt_freq FROM g_af",
)
def allele_frequency(fx):
    return freq(fx)


@query(
    "allele_frequency_by_dataset",
    ["g_geno", "g_sample"],
    f"""SELECT site_id, {DATASET} AS dataset, ancestry, CAST(sum(coalesce(alt_dosage, 0)) AS BIGINT) AS alt_ct,
 2 * max(n) - 2 * count(CASE WHEN alt_dosage IS NULL THEN 1 END) AS obs_ct FROM g_geno JOIN g_sample USING (sample_id)
JOIN (SELECT ancestry, count(*) AS n FROM g_sample GROUP BY ancestry) t USING (ancestry) GROUP BY ALL""",
)
def allele_frequency_by_dataset(fx):
    calls = fx.view("g_geno").withColumn("dataset", F.expr(DATASET))
    return frequency.allele_freq(calls, fx.view("g_sample"), ID, by=("dataset",)).drop("alt_freq")


@query("popmax", ["g_popmax"], "SELECT site_id, max_value FROM g_popmax")
def popmax(fx):
    return frequency.popmax(frequency.nonzero_af(freq(fx)), ID)


@query("distinct_ids", ["g_geno", "g_site"], f"SELECT DISTINCT {VID} AS variant_id FROM g_geno JOIN g_site USING (site_id)")
def distinct_ids(fx):
    return J.lookup_join(fx.view("g_geno"), sites(fx), ID).select(keys.variant_id().alias("variant_id")).distinct()


@query(
    "dedupe_first",
    ["g_geno"],
    """SELECT site_id, sample_id, alt_dosage FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY sample_id) AS rn FROM g_geno) WHERE rn = 1""",
)
def dedupe_first(fx):
    return J.first_by(fx.view("g_geno").select("site_id", "sample_id", "alt_dosage"), ID, ["sample_id"])


@query(
    "crosstab",
    ["g_site"],
    f"""SELECT gene AS genes_final, count(*) FILTER (WHERE NOT coalesce(clnsig IN {PLP}, false)) AS not_lp_p,
 count(*) FILTER (WHERE clnsig IN {PLP}) AS lp_p FROM g_site GROUP BY gene""",
)
def crosstab(fx):
    flag = F.coalesce(F.col("clnsig").isin(evidence.clinvar_classes()).cast("int"), F.lit(0))
    return carriers.variant_counts(sites(fx).select(F.col("gene").alias("genes_final"), flag.alias("lp_p")))


@query(
    "write_summary",
    ["g_site"],
    f"""SELECT gene, count(*) FILTER (WHERE NOT coalesce(clnsig IN {PLP}, false)) AS not_lp_p, count(*) FILTER (WHERE clnsig IN {PLP}) AS lp_p FROM g_site GROUP BY gene""",
)
def write_summary(fx):
    from allelio.sources import readers, writers

    path = fx.scratch("summary")
    writers.write_tsv(crosstab(fx), path, compression="none")
    names = {"genes_final": ("gene", "string"), "not_lp_p": ("not_lp_p", "bigint"), "lp_p": ("lp_p", "bigint")}
    return readers.read_tsv(fx.spark, path, names)


@query(
    "row_counts",
    ["g_site", "g_geno"],
    """SELECT 'sites' AS step, count(*) AS n_rows FROM g_site UNION ALL SELECT 'pass two-star', count(*) FROM g_site WHERE clnrevstat IN """
    + STARS
    + " UNION ALL SELECT 'calls', count(*) FROM g_geno",
)
def row_counts(fx):
    return J.step_counts({"sites": sites(fx), "pass two-star": evidence.clinvar_two_star(sites(fx)), "calls": fx.view("g_geno")})


# --- set operations -----------------------------------------------------------


@query(
    "union_all",
    ["g_site"],
    "SELECT site_id, gene, 'lof' AS impact FROM g_site WHERE effect LIKE '%splice%' UNION ALL SELECT site_id, gene, 'missense' FROM g_site WHERE effect LIKE '%missense%'",
)
def union_all(fx):
    lof = sites(fx).filter(F.col("effect").contains("splice")).select("site_id", "gene", F.lit("lof").alias("impact"))
    missense = sites(fx).filter(F.col("effect").contains("missense")).select(F.lit("missense").alias("impact"), "gene", "site_id")
    return J.stack([lof, missense])


@query(
    "union_distinct",
    ["g_popmax", "g_gnomad", "g_sample"],
    """SELECT site_id FROM g_popmax WHERE max_value <= (SELECT 30e0 / count(*) FROM g_sample) UNION SELECT site_id FROM g_gnomad WHERE joint_grpmax_af <= 0.001""",
)
def union_distinct(fx):
    cohort = frequency.rare(frequency.cohort_popmax(fx.view("g_geno"), fx.view("g_sample"), ID), cutoff(fx, 30.0))
    return frequency.rare_ids(cohort, frequency.rare(fx.view("g_gnomad"), col="joint_grpmax_af"), ID)


@query(
    "intersect_ids",
    ["g_site", "g_revel"],
    f"SELECT site_id FROM g_site WHERE effect LIKE '%missense%' AND site_id IN ({CONSENSUS})",
)
def intersect_ids(fx):
    revel = fx.view("g_revel")
    missense = sites(fx).filter(F.col("effect").contains("missense"))
    return J.intersect_ids([evidence.revel_pass(revel), evidence.intervar_pathogenic(revel), missense], ID)
