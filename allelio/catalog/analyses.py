"""Whole analyses over the fixture tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from allelio.catalog.columns import CONSEQUENCE_LAYOUT_SQL, _combined
from allelio.catalog.registry import query
from allelio.catalog.relations import BURDEN_SQL, CONSENSUS, ID, IS_GROUPS, IS_TOTALS, N_GROUPS, N_TOTALS, PLP, REVEL_ANY, STARS, cutoff, sites
from allelio.catalog.sources import CATEGORY_SQL, SOURCE, VID
from allelio.config import CARRIER_GENES, KNOWN_MECHANISM, PAR_X, PLP_GENES, TIER_GENES, VARIANT_KEY
from allelio.functions import keys
from allelio.operators import carriers, evidence, frequency, tiers
from allelio.operators.joins import stack, staged
from allelio.operators.normalise import normalise
from allelio.plans import pipelines
from allelio.sources import buckets, readers, writers

# Fixture cutoffs: k / number of samples.
RARE_K = 30.0
FAF_K = {"dcm": 22.5, "arvc": 24.0, "hcm": 19.5}
N = "(SELECT count(*) FROM g_sample)"
# A task holds one bucket, so buckets grow in number, not in size.
CALLS_PER_BUCKET = 500_000


def cohort(fx):
    return frequency.cohort_popmax(fx.view("g_geno"), fx.view("g_sample"), ID)


@query(
    "extract_gene_sites",
    ["g_site", "g_region"],
    """SELECT s.contig, s.pos, s.ref, s.alt, r.gene FROM g_site s JOIN g_region r ON r.contig = s.contig AND s.pos >= r.start_pos AND s.pos < r.end_pos""",
)
def extract_gene_sites(fx):
    return pipelines.extract_gene_sites(sites(fx, *VARIANT_KEY), fx.view("g_region")).select(*VARIANT_KEY, "gene")


@query("consequence_table", ["g_vcf", "g_site"], CATEGORY_SQL)
def consequence_table(fx):
    return pipelines.categorised_consequences(fx.view("g_vcf"))


@query(
    "consequence_table_pass",
    ["g_vcf", "g_site"],
    f"""SELECT t.* EXCLUDE ("GENEINFO", "CLNSIG", "CLNREVSTAT"), s.geneinfo AS "GENEINFO", s.clnsig AS "CLNSIG", s.clnrevstat AS "CLNREVSTAT"
FROM ({CONSEQUENCE_LAYOUT_SQL}) t JOIN g_vcf v ON v.id = t."ID" LEFT JOIN g_site s ON s.site_id = v.site_id AND s.alt = t."ALT" AND s.clnsig IS NOT NULL
WHERE v.filter = 'PASS'""",
)
def consequence_table_pass(fx):
    # PASS rows only, ClinVar columns joined from a table instead of INFO.
    clinvar = sites(fx).filter(F.col("clnsig").isNotNull())
    table = clinvar.select(
        *VARIANT_KEY, F.col("geneinfo").alias("GENEINFO"), F.col("clnsig").alias("CLNSIG"), F.col("clnrevstat").alias("CLNREVSTAT")
    )
    rows = fx.view("g_vcf").drop("clnsig", "clnrevstat", "geneinfo")
    return pipelines.consequence_table(rows, clinvar=table, pass_only=True)


@query(
    "gnomad_rare",
    ["g_gnomad", "g_site"],
    """SELECT replace(contig, 'chr', '') AS contig, pos, ref, alt, concat(replace(contig, 'chr', ''), ':', pos, ':', ref, ':', alt) AS variant_id, joint_grpmax_af AS max_value
FROM g_gnomad JOIN g_site USING (site_id) WHERE joint_grpmax_af <= 0.001""",
)
def gnomad_rare(fx):
    public = fx.view("g_gnomad").select("locus", "alleles", F.col("joint_grpmax_af").alias("joint_grpmax_AF"))
    return pipelines.public_rare(public).withColumn("variant_id", keys.variant_id())


def _wide(a: str) -> str:
    return f"max(CASE WHEN ancestry = '{a}' AND alt_ct > 0 THEN CAST(alt_ct AS DOUBLE) / obs_ct END) AS af_{a}"


AF_WIDE = ", ".join(_wide(a) for a in ("eur", "afr", "amr", "eas", "sas", "mid"))


@query(
    "cohort_popmax",
    ["g_af", "g_popmax", "g_sample"],
    f"""SELECT site_id, {AF_WIDE}, max(max_value) AS max_value FROM g_af JOIN g_popmax USING (site_id)
WHERE max_value <= (SELECT 30e0 / count(*) FROM g_sample) GROUP BY site_id""",
)
def cohort_popmax(fx):
    return pipelines.cohort_rare(fx.view("g_geno"), fx.view("g_sample"), ID, cutoff(fx, RARE_K))


PAR = " OR ".join(f"x.pos BETWEEN {s} AND {e}" for s, e in PAR_X)
FOUNDERS_SQL = f"""SELECT site_id, contig, pos, ancestry, alt_ct, obs_ct, CASE WHEN obs_ct <> 0 THEN CAST(alt_ct AS DOUBLE) / obs_ct END AS alt_freq FROM (
 SELECT site_id, contig, pos, ancestry, CAST(coalesce(sum(alt), 0) AS BIGINT) AS alt_ct,
  CAST(max(2 * n - CASE WHEN on_x THEN males ELSE 0 END) - coalesce(sum(CASE WHEN alt IS NULL THEN CASE WHEN one THEN 1 ELSE 2 END END), 0) AS BIGINT) AS obs_ct FROM (
  SELECT *, CASE WHEN NOT one THEN alt_dosage WHEN alt_dosage = 2 THEN 1 WHEN alt_dosage = 0 THEN 0 END AS alt FROM (
   SELECT x.site_id, x.contig, x.pos, p.ancestry, g.alt_dosage, t.n, t.males, x.contig = 'chrX' AND NOT ({PAR}) AS on_x,
    x.contig = 'chrX' AND NOT ({PAR}) AND coalesce(p.sex, '') = 'male' AS one
   FROM g_geno g JOIN g_xsite x USING (site_id) JOIN g_person p USING (sample_id)
   JOIN (SELECT ancestry, count(*) AS n, count(*) FILTER (WHERE sex = 'male') AS males FROM g_person WHERE father_id = '0' AND mother_id = '0' GROUP BY ancestry) t USING (ancestry)
   WHERE p.father_id = '0' AND p.mother_id = '0')) GROUP BY site_id, contig, pos, ancestry)"""


@query("allele_frequency_founders", ["g_geno", "g_xsite", "g_person"], FOUNDERS_SQL)
def allele_frequency_founders(fx):
    # Founders only, with males haploid on X; calls and people in buckets of the sample, as for a cohort too large to broadcast.
    calls = fx.view("g_geno").join(fx.view("g_xsite"), "site_id").select("site_id", "contig", "pos", "sample_id", "alt_dosage")
    n = max(4, math.ceil(fx.table("lineitem").count() / CALLS_PER_BUCKET))  # there are no more calls than line items; counted from file footers
    calls = buckets.write_buckets(calls, fx.scratch("calls"), buckets=n)
    people = buckets.write_buckets(frequency.founders(fx.view("g_person")), fx.scratch("people"), buckets=n)
    return frequency.allele_freq(calls, people, ["site_id", "contig", "pos"], bucketed=True)


@query(
    "rare_variant_ids",
    ["g_popmax", "g_gnomad", "g_sample", "g_site"],
    """SELECT replace(contig, 'chr', '') AS contig, pos, ref, alt FROM g_site WHERE site_id IN (
 SELECT site_id FROM g_popmax WHERE max_value <= (SELECT 30e0 / count(*) FROM g_sample) UNION
 SELECT site_id FROM g_gnomad WHERE joint_grpmax_af <= 0.001)""",
)
def rare_variant_ids(fx):
    # The cohort writes contigs with prefix, the public table loses it: both sides are brought to one form.
    own = sites(fx, "site_id", *VARIANT_KEY).withColumn("contig", keys.norm_contig("contig"))
    calls = fx.view("g_geno").join(own, "site_id")
    rare = pipelines.cohort_rare(calls, fx.view("g_sample"), VARIANT_KEY, cutoff(fx, RARE_K))
    public = fx.view("g_gnomad").select("locus", "alleles", F.col("joint_grpmax_af").alias("joint_grpmax_AF"))
    return frequency.rare_ids(rare, pipelines.public_rare(public), VARIANT_KEY)


@query("clinvar_plp", ["g_site"], f"SELECT site_id, gene, clnsig FROM g_site WHERE clnsig IN {PLP} AND clnrevstat IN {STARS}")
def clinvar_plp(fx):
    return evidence.clinvar_filter(sites(fx)).select("site_id", "gene", "clnsig")


LOF = "regexp_matches(effect, 'stop_gained|frameshift|splice_acceptor|splice_donor|start_lost|splice')"
NEAR = "EXISTS (SELECT 1 FROM g_hipsi h WHERE h.contig = s.contig AND s.pos BETWEEN h.start_pos - 10 AND h.end_pos + 10)"
LOF_SQL = f"SELECT site_id, gene FROM g_site s WHERE {LOF} AND (gene <> 'TTN' OR {NEAR})"
MISSENSE_SQL = f"""SELECT site_id, gene FROM g_site WHERE effect LIKE '%missense%' AND (
 (gene = 'SCN5A' AND site_id IN ({CONSENSUS})) OR (gene <> 'SCN5A' AND site_id IN ({REVEL_ANY})))"""


def lof(fx):
    rows = sites(fx).filter(F.col("effect").rlike("stop_gained|frameshift|splice_acceptor|splice_donor|start_lost|splice"))
    return evidence.lof_in_high_psi(rows.select("site_id", "contig", "pos", "gene"), fx.view("g_hipsi")).select("site_id", "gene")


def missense(fx):
    rows = sites(fx, "site_id", "gene", "effect").filter(F.col("effect").rlike("missense")).drop("effect")
    revel = fx.view("g_revel")
    return evidence.missense_supported(rows, revel, revel, revel, ID)


@query("ttn_hipsi_lof", ["g_site", "g_hipsi"], LOF_SQL)
def ttn_hipsi_lof(fx):
    return lof(fx)


@query(
    "scn5a_consensus",
    ["g_site", "g_revel"],
    f"SELECT site_id, gene FROM g_site WHERE effect LIKE '%missense%' AND gene = 'SCN5A' AND site_id IN ({CONSENSUS})",
)
def scn5a_consensus(fx):
    rows = sites(fx).filter(F.col("effect").rlike("missense") & (F.col("gene") == "SCN5A")).select("site_id", "gene")
    return evidence.gene_consensus(rows, fx.view("g_revel"), fx.view("g_revel"), ID)


@query("missense_revel", ["g_site", "g_revel"], MISSENSE_SQL)
def missense_revel(fx):
    return missense(fx)


TIER_VALUES = ", ".join(
    f"('{d}', '{i}', '{g}', {FAF_K[d]})" for d in TIER_GENES for i, known in KNOWN_MECHANISM.items() for g in TIER_GENES[d] if g in known
)
TIERED_SQL = f"""SELECT f.site_id, f.gene, t.disease, f.impact, {SOURCE.replace('site_id', 'f.site_id')} AS source, c.max_value AS cohort_af, p.joint_grpmax_af AS public_af
FROM (SELECT site_id, gene, 'lof' AS impact FROM ({LOF_SQL}) UNION ALL SELECT site_id, gene, 'missense' FROM ({MISSENSE_SQL})) f
JOIN (VALUES {TIER_VALUES}) AS t(disease, impact, gene, k) USING (gene, impact)
LEFT JOIN g_popmax c ON c.site_id = f.site_id LEFT JOIN g_gnomad p ON p.site_id = f.site_id
WHERE c.max_value <= CAST(t.k AS DOUBLE) / {N} OR p.joint_grpmax_af <= CAST(t.k AS DOUBLE) / {N}"""
TIERED_VIEWS = ["g_site", "g_hipsi", "g_revel", "g_popmax", "g_gnomad", "g_sample"]


def tiered(fx):
    variants = stack([lof(fx).withColumn("impact", F.lit("lof")), missense(fx).withColumn("impact", F.lit("missense"))])
    n = fx.view("g_sample").count()
    public = fx.view("g_gnomad").select("site_id", F.col("joint_grpmax_af").alias("max_value"))
    rows = tiers.tiered_variants(
        variants, cohort(fx), public, ID, rarity=RARE_K / n, cutoffs={d: k / n for d, k in FAF_K.items()}
    )
    return rows.withColumn("source", F.expr(SOURCE))


@query("tiered_variants", TIERED_VIEWS, TIERED_SQL)
def tiered_variants(fx):
    return tiered(fx)


PLP_VALUES = ", ".join(f"('{d}', '{g}')" for d, panel in PLP_GENES.items() for g in panel)
CLINVAR_SQL = f"""SELECT site_id, panel_gene AS gene, disease, 'lp_p' AS impact, {SOURCE} AS source FROM g_site s
JOIN (VALUES {PLP_VALUES}) AS d(disease, panel_gene) ON panel_gene = string_split(geneinfo, ':')[1]
WHERE clnsig IN {PLP} AND clnrevstat IN {STARS}"""


def clinvar(fx):
    rows = tiers.clinvar_by_disease(evidence.clinvar_filter(sites(fx)))
    return rows.select("site_id", "gene", "disease", "impact", F.expr(SOURCE).alias("source"))


@query("clinvar_by_disease", ["g_site"], CLINVAR_SQL)
def clinvar_by_disease(fx):
    return clinvar(fx)


@query(
    "clinvar_by_disease_rare",
    ["g_site", "g_popmax", "g_sample"],
    f"SELECT * FROM ({CLINVAR_SQL}) WHERE site_id IN (SELECT site_id FROM g_popmax WHERE max_value <= 30e0 / {N})",
)
def clinvar_by_disease_rare(fx):
    rows = tiers.clinvar_by_disease(evidence.clinvar_filter(sites(fx)), frequency.rare(cohort(fx), cutoff(fx, RARE_K)), ID)
    return rows.select("site_id", "gene", "disease", "impact", F.expr(SOURCE).alias("source"))


LISTS_SQL = f"""SELECT DISTINCT impact, disease, source, {VID} AS "ID" FROM (
 SELECT site_id, disease, impact, source FROM ({TIERED_SQL}) UNION ALL SELECT site_id, disease, impact, source FROM ({CLINVAR_SQL}))
JOIN g_site USING (site_id)"""


@query("export_id_lists", TIERED_VIEWS, LISTS_SQL)
def export_id_lists(fx):
    cols = ["site_id", "disease", "impact", "source"]
    rows = tiered(fx).select(*cols).unionByName(clinvar(fx).select(*cols))
    path = fx.scratch("id-lists")
    writers.export_ids(rows.join(sites(fx, "site_id", *VARIANT_KEY), "site_id"), path)
    names = {c: (c, "string") for c in ("impact", "disease", "source", "ID")}
    return readers.read_tsv(fx.spark, path, names)


MASTER = ", ".join(f"'{g}'" for g in sorted({g for p in TIER_GENES.values() for g in p}))


@query(
    "variant_summary",
    TIERED_VIEWS,
    f"""SELECT gene AS genes_final, count(*) FILTER (WHERE NOT is_plp) AS not_lp_p, count(*) FILTER (WHERE is_plp) AS lp_p FROM (
 SELECT site_id, gene, site_id IN (SELECT site_id FROM ({CLINVAR_SQL})) AS is_plp FROM g_site JOIN g_popmax USING (site_id)
 WHERE max_value <= 30e0 / {N} AND gene IN ({MASTER})
  AND (site_id IN (SELECT site_id FROM ({CLINVAR_SQL})) OR site_id IN (SELECT site_id FROM ({TIERED_SQL})))) GROUP BY gene""",
)
def variant_summary(fx):
    combined = frequency.rare(_combined(fx), cutoff(fx, RARE_K))
    return pipelines.variant_summary(combined, tiered(fx), clinvar(fx), ID)


CARRIER_GENES_SQL = ", ".join(f"'{g}'" for g in CARRIER_GENES)


def _filled(cols: str) -> str:
    names = [c.rsplit(" AS ", 1)[1] for c in cols.split(", ") if " AS " in c]
    return ", ".join(f"CASE WHEN c.sample_id IS NULL THEN 0 ELSE c.{n} END AS {n}" for n in names)


@query(
    "carrier_status",
    ["g_sample", "g_geno", "g_tier"],
    f"""SELECT s.sample_id, {_filled(N_GROUPS)}, {_filled(N_TOTALS)}, {_filled(IS_GROUPS)}, {_filled(IS_TOTALS)} FROM g_sample s LEFT JOIN (
 SELECT sample_id, {N_GROUPS}, {N_TOTALS}, {IS_GROUPS}, {IS_TOTALS} FROM ({BURDEN_SQL}) WHERE gene IN ({CARRIER_GENES_SQL}) GROUP BY sample_id) c USING (sample_id)""",
)
def carrier_status(fx):
    sets = carriers.carrier_genes(fx.view("g_tier"))
    return pipelines.carrier_status(fx.view("g_geno"), sets, fx.view("g_sample"), ID)


# --- left alignment -----------------------------------------------------------

CHUNK = 500

# Variants of every document-contig: at each 199th base a deletion, an insertion of a copy of what follows, an
# insertion of a longer copy, and a replacement that can be trimmed at both ends. ``ctx`` is the sequence from two
# bases in front of the position to four behind it.
INDELS = [
    ("del1", "substr(ctx, 3, 2)", "substr(ctx, 4, 1)"),
    ("ins1", "substr(ctx, 3, 1)", "concat(substr(ctx, 3, 1), substr(ctx, 3, 1))"),
    ("ins3", "substr(ctx, 3, 1)", "concat(substr(ctx, 1, 3), substr(ctx, 3, 1))"),
    ("del4", "substr(ctx, 3, 5)", "substr(ctx, 7, 1)"),
    ("mnv", "concat(substr(ctx, 3, 1), 'AC', substr(ctx, 6, 2))", "concat(substr(ctx, 3, 1), 'CA', substr(ctx, 6, 2))"),
]
INDEL_SQL = " UNION ALL ".join(
    f"SELECT concat(contig, ':', p, ':{name}') AS row_id, contig, p AS pos, {ref} AS ref, {alt} AS alt FROM placed" for name, ref, alt in INDELS
)


def _genome_and_variants(fx):
    # Cut once: a substring of a text is found from its start, so many of a long one cost its length each.
    cut = fx.view("g_genome").repartition("contig").selectExpr("contig", "length(seq) AS n", f"regexp_extract_all(seq, '.{{1,{CHUNK}}}', 0) AS parts")
    cut, _ = staged(cut, "cut-genome")
    chunks = cut.select("contig", F.posexplode("parts").alias("chunk_no", "seq"))
    # From two bases in front of a position on: the end of one chunk and the start of the next.
    ctx = f"substring(concat(get(parts, CAST((p - 3) div {CHUNK} AS INT)), coalesce(get(parts, CAST((p - 3) div {CHUNK} + 1 AS INT)), '')), CAST((p - 3) % {CHUNK} + 1 AS INT), 7)"
    placed = cut.selectExpr(
        "contig", f"inline(CASE WHEN n >= 8 THEN transform(sequence(3, n - 5, 199), p -> struct(CAST(p AS BIGINT) AS p, {ctx} AS ctx)) END)"
    )
    alleles = F.array(
        *[F.struct(F.lit(name).alias("name"), F.expr(ref).alias("ref"), F.expr(alt).alias("alt")) for name, ref, alt in INDELS]
    )
    variants = placed.select("contig", F.col("p").alias("pos"), F.explode(alleles).alias("v")).select(
        F.concat_ws(":", "contig", "pos", "v.name").alias("row_id"), "contig", "pos", "v.ref", "v.alt"
    )
    return chunks.withColumn("chunk_no", F.col("chunk_no").cast("bigint")), variants


LEFT_ALIGN_SQL = f"""
placed AS (SELECT contig, CAST(p AS BIGINT) AS p, substr(seq, CAST(p AS INT) - 2, 7) AS ctx FROM (
 SELECT contig, seq, unnest(generate_series(3, length(seq) - 5, 199)) AS p FROM g_genome)),
v AS ({INDEL_SQL}),
step(row_id, contig, pos, ref, alt, done) AS (
 SELECT row_id, contig, pos, ref, alt, ref = alt FROM v
 UNION ALL
 SELECT row_id, contig,
  CASE kind WHEN 'extend' THEN pos - 1 WHEN 'front' THEN pos + 1 ELSE pos END,
  CASE kind WHEN 'extend' THEN concat(base, left(ref, length(ref) - 1)) WHEN 'end' THEN left(ref, length(ref) - 1)
   WHEN 'front' THEN substr(ref, 2) ELSE ref END,
  CASE kind WHEN 'extend' THEN concat(base, left(alt, length(alt) - 1)) WHEN 'end' THEN left(alt, length(alt) - 1)
   WHEN 'front' THEN substr(alt, 2) ELSE alt END,
  kind = 'none'
 FROM (SELECT step.*, substr(seq, pos - 1, 1) AS base, CASE
   WHEN right(ref, 1) = right(alt, 1) AND least(length(ref), length(alt)) > 1 THEN 'end'
   WHEN right(ref, 1) = right(alt, 1) AND pos > 1 THEN 'extend'
   WHEN left(ref, 1) = left(alt, 1) AND least(length(ref), length(alt)) > 1 THEN 'front'
   ELSE 'none' END AS kind FROM step JOIN g_genome USING (contig) WHERE NOT done) s)"""


@query(
    "left_align",
    ["g_genome"],
    ("SELECT row_id, contig, pos, ref, alt FROM step WHERE done", LEFT_ALIGN_SQL),
)
def left_align(fx):
    chunks, variants = _genome_and_variants(fx)
    chunks, _ = staged(chunks, "genome")
    variants, _ = staged(variants, "variants")
    return normalise(variants, chunks, CHUNK).select("row_id", "contig", "pos", "ref", "alt")
