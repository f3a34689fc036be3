"""Projections and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelio.catalog.registry import query
from allelio.config import ANCESTRIES, CONSEQUENCE_COLS, GENE_SOURCE_ORDER, PUBLIC_ANCESTRIES
from allelio.functions import fields, keys
from allelio.operators import annotation, carriers, frequency, nested
from allelio.operators.joins import flag_in
from allelio.plans.pipelines import consequence_table

from allelio.catalog.sources import CONSEQUENCE_SQL, VID


# --- nested site frequencies --------------------------------------------------

# Counts of place i of the frequency array; place 0 is the total.
N_PLACES = 1 + len(PUBLIC_ANCESTRIES)
AC = "(site_id * 3 + {i} * 5) % 13"
AN = "200 + {i} + site_id % 7"


def nested_public(fx):
    """The nested site table of the public frequencies."""

    def block(shift: int) -> str:
        places = ", ".join(
            f"named_struct('AC', {AC.format(i=i + shift)}, 'AF', CAST({AC.format(i=i + shift)} AS DOUBLE) / ({AN.format(i=i + shift)}),"
            f" 'AN', {AN.format(i=i + shift)}, 'homozygote_count', site_id % 3, 'note', 'x')"
            for i in range(N_PLACES)
        )
        return (
            f"named_struct('freq', array({places}),"
            " 'faf', array(named_struct('faf95', CAST(site_id % 30 AS DOUBLE) / 1000, 'faf99', CAST(site_id % 40 AS DOUBLE) / 1000)),"
            " 'fafmax', named_struct('faf95_max', CAST(site_id % 31 AS DOUBLE) / 100, 'faf95_max_gen_anc', 'afr',"
            "  'faf99_max', CAST(site_id % 41 AS DOUBLE) / 100, 'faf99_max_gen_anc', 'nfe', 'other', 1),"
            " 'grpmax', named_struct('AC', site_id % 40, 'AF', joint_grpmax_af, 'AN', CAST(10000 AS BIGINT), 'homozygote_count', site_id % 2,"
            "  'gen_anc', CASE WHEN joint_grpmax_af IS NOT NULL THEN 'eas' END))"
        )

    return fx.view("g_gnomad").selectExpr(
        "site_id",
        "locus",
        "from_json(alleles, 'array<string>') AS alleles",
        f"{block(0)} AS joint",
        f"{block(20)} AS exomes",
        f"{block(40)} AS genomes",
        "named_struct('fail_interval_qc', site_id % 4 = 0, 'outside_broad_capture_region', site_id % 8 = 0,"
        " 'outside_ukb_capture_region', site_id % 6 = 0, 'not_called_in_exomes', site_id % 10 = 0,"
        " 'not_called_in_genomes', site_id % 12 = 0) AS region_flags",
        "named_struct('contingency_table_test', array(named_struct('p_value', CAST(site_id % 100 AS DOUBLE) / 100)),"
        " 'cochran_mantel_haenszel_test', named_struct('p_value', CAST(site_id % 50 AS DOUBLE) / 50)) AS freq_comparison_stats",
    )


def af(i: int) -> str:
    return f"CAST({AC.format(i=i)} AS DOUBLE) / ({AN.format(i=i)})"


@query(
    "select_nested",
    ["g_gnomad"],
    f"""SELECT locus, CAST(site_id % 31 AS DOUBLE) / 100 AS faf95_max, joint_grpmax_af AS grpmax_af, {AC.format(i=20)} AS exomes_ac,
 CAST(site_id % 40 AS DOUBLE) / 1000 AS genomes_faf99, site_id % 4 = 0 AS fail_interval_qc FROM g_gnomad""",
)
def select_nested(fx):
    df = nested.select_frequencies(nested_public(fx))
    return df.select(
        "locus",
        F.col("joint_fafmax.faf95_max").alias("faf95_max"),
        F.col("joint_grpmax.AF").alias("grpmax_af"),
        nested.array_at("exomes_freq", 0)["AC"].alias("exomes_ac"),
        nested.array_at("genomes_faf", 0)["faf99"].alias("genomes_faf99"),
        F.col("region_flags.fail_interval_qc").alias("fail_interval_qc"),
    )


PLACES = f"generate_series(0, {N_PLACES - 1})"


@query(
    "map_array_struct",
    ["g_gnomad"],
    f"""SELECT locus, i AS place, {AC.format(i='i')} AS ac, {af('i')} AS af, {AN.format(i='i')} AS an, site_id % 3 AS homozygotes
FROM g_gnomad, LATERAL (SELECT unnest({PLACES}) AS i)""",
)
def map_array_struct(fx):
    kept = nested_public(fx).select("locus", nested.keep_fields("joint.freq", nested.FREQ_FIELDS).alias("freq"))
    rows = kept.select("locus", F.posexplode("freq").alias("place", "f"))
    return rows.select(
        "locus", F.col("place").cast("bigint").alias("place"), F.col("f.AC").alias("ac"), F.col("f.AF").alias("af"),
        F.col("f.AN").alias("an"), F.col("f.homozygote_count").alias("homozygotes"),
    )


@query(
    "array_at",
    ["g_gnomad"],
    f"""SELECT locus, from_json(alleles, '["VARCHAR"]')[1] AS ref, from_json(alleles, '["VARCHAR"]')[2] AS alt,
 {AC.format(i=0)} AS total_ac, CAST(NULL AS BIGINT) AS out_of_range FROM g_gnomad""",
)
def array_at(fx):
    freq = F.col("joint.freq")
    return nested_public(fx).select(
        "locus",
        nested.array_at("alleles", 0).alias("ref"),
        nested.array_at("alleles", 1).alias("alt"),
        nested.array_at(freq, 0)["AC"].alias("total_ac"),
        nested.array_at(freq, 99)["AC"].alias("out_of_range"),
    )


@query(
    "array_field",
    ["g_gnomad"],
    f"SELECT locus, i AS place, {AN.format(i='i')} AS an FROM g_gnomad, LATERAL (SELECT unnest({PLACES}) AS i)",
)
def array_field(fx):
    ans = nested_public(fx).select("locus", nested.array_field("joint.freq", "AN").alias("an"))
    return ans.select("locus", F.posexplode("an").alias("place", "an")).withColumn("place", F.col("place").cast("bigint"))


LABELLED_SQL = ", ".join(
    f"{af(i)} AS \"{a}_AF\", {AC.format(i=i)} AS \"{a}_AC\", {AN.format(i=i)} AS \"{a}_AN\""
    for i, a in enumerate(PUBLIC_ANCESTRIES, start=1)
)


@query("labelled_array_columns", ["g_gnomad"], f"SELECT locus, {LABELLED_SQL} FROM g_gnomad")
def labelled_array_columns(fx):
    return nested_public(fx).select(
        "locus", *nested.array_to_columns("joint.freq", ["AF", "AC", "AN"], nested.ancestry_index())
    )


@query(
    "gnomad_flatten",
    ["g_gnomad", "g_site"],
    f"""SELECT locus, ref, alt, true AS is_snp, {af(0)} AS "joint_AF", {AC.format(i=0)} AS "joint_AC", {AN.format(i=0)} AS "joint_AN",
 joint_grpmax_af AS "joint_grpmax_AF", site_id % 40 AS "joint_grpmax_AC", CAST(10000 AS BIGINT) AS "joint_grpmax_AN",
 CASE WHEN joint_grpmax_af IS NOT NULL THEN 'eas' END AS joint_grpmax_gen_anc,
 CAST(site_id % 30 AS DOUBLE) / 1000 AS joint_faf95, CAST(site_id % 40 AS DOUBLE) / 1000 AS joint_faf99,
 CAST(site_id % 31 AS DOUBLE) / 100 AS joint_faf95_max, 'afr' AS joint_faf95_max_gen_anc,
 CAST(site_id % 41 AS DOUBLE) / 100 AS joint_faf99_max, 'nfe' AS joint_faf99_max_gen_anc,
 site_id % 4 = 0 AS fail_interval_qc, site_id % 8 = 0 AS outside_broad_capture_region, site_id % 6 = 0 AS outside_ukb_capture_region,
 site_id % 10 = 0 AS not_called_in_exomes, site_id % 12 = 0 AS not_called_in_genomes,
 CAST(site_id % 100 AS DOUBLE) / 100 AS freq_cong_pval, CAST(site_id % 50 AS DOUBLE) / 50 AS freq_cmh_pval, {LABELLED_SQL}
FROM g_gnomad JOIN g_site USING (site_id)""",
)
def gnomad_flatten(fx):
    return nested.flatten_frequencies(nested_public(fx)).drop("alleles")


# --- projections --------------------------------------------------------------


@query("sites_only", ["g_geno", "g_site"], "SELECT contig, pos, ref, alt, count(*) AS n FROM g_geno JOIN g_site USING (site_id) GROUP BY ALL")
def sites_only(fx):
    matrix = fx.view("g_geno").join(fx.view("g_site").select("site_id", "contig", "pos", "ref", "alt"), "site_id")
    entries = matrix.groupBy("contig", "pos", "ref", "alt").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("sample_id", "alt_dosage")).alias("entries")
    )
    return annotation.sites_only(entries)


@query("drop_columns", ["g_site"], "SELECT site_id, contig, pos, ref, alt, gene FROM g_site")
def drop_columns(fx):
    return fx.view("g_site").drop("effect", "clnsig", "clnrevstat", "geneinfo", "no_such_column")


@query(
    "rename_subset",
    ["g_af", "g_site"],
    f"SELECT {VID} AS \"ID\", CAST(alt_ct AS DOUBLE) / obs_ct AS af_eur, gene AS gene_eur FROM g_af JOIN g_site USING (site_id) WHERE ancestry = 'eur'",
)
def rename_subset(fx):
    af_long = frequency.allele_freq(fx.view("g_geno"), fx.view("g_sample"), ["site_id"])
    return (
        af_long.filter(F.col("ancestry") == "eur")
        .join(fx.view("g_site"), "site_id")
        .select(keys.variant_id().alias("ID"), F.col("alt_freq").alias("af_eur"), F.col("gene").alias("gene_eur"))
    )


@query("add_constant", ["g_sample"], 'SELECT sample_id, ancestry, 0 AS "FID", sample_id AS "IID" FROM g_sample')
def add_constant(fx):
    return fx.view("g_sample").withColumns({"FID": F.lit(0), "IID": F.col("sample_id")})


@query(
    "extract_ann_fields",
    ["g_ann"],
    """SELECT site_id, string_split(e, '|')[1] AS "ALLELE", string_split(e, '|')[2] AS "EFFECT", string_split(e, '|')[4] AS "GENE",
 string_split(e, '|')[7] AS "FEATURE", string_split(e, '|')[10] AS "HGVS_C", nullif(string_split(e, '|')[11], '') AS "HGVS_P"
FROM (SELECT site_id, unnest(string_split(regexp_extract(info, '(^|;)ANN=([^;]*)', 2), ',')) AS e FROM g_ann)""",
)
def extract_ann_fields(fx):
    return annotation.explode_ann(fx.view("g_ann").select("site_id", "info")).drop("info")


CONSEQUENCE_LAYOUT_SQL = f"""
SELECT source, contig AS "CHROM", pos AS "POS", id AS "ID", ref AS "REF", alt AS "ALT", alt AS "ALLELE", effect AS "EFFECT",
 gene AS "GENE", feature AS "FEATURE", hgvs_c AS "HGVS_C", hgvs_p AS "HGVS_P", geneinfo AS "GENEINFO", clnsig AS "CLNSIG",
 clnrevstat AS "CLNREVSTAT" FROM ({CONSEQUENCE_SQL}) t"""


@query("positional_project", ["g_vcf", "g_site"], f"SELECT * EXCLUDE (source) FROM ({CONSEQUENCE_LAYOUT_SQL}) u")
def positional_project(fx):
    return consequence_table(fx.view("g_vcf")).select(*CONSEQUENCE_COLS)


@query(
    "membership_flag",
    ["g_site"],
    "SELECT site_id, CASE WHEN clnsig IN ('Pathogenic', 'Likely_pathogenic') THEN 1 ELSE 0 END AS lp_p FROM g_site",
)
def membership_flag(fx):
    sites = fx.view("g_site")
    return flag_in(sites.select("site_id"), sites.filter(F.col("clnsig").isin("Pathogenic", "Likely_pathogenic")), "site_id", "lp_p")


@query(
    "first_non_null",
    ["g_af", "g_site"],
    "SELECT site_id, coalesce("
    + ", ".join(f"max(CASE WHEN ancestry = '{a}' THEN gene END)" for a in GENE_SOURCE_ORDER)
    + ") AS genes_final FROM g_af JOIN g_site USING (site_id) WHERE alt_ct > 0 GROUP BY site_id",
)
def first_non_null(fx):
    return carriers.final_gene(_combined(fx)).select("site_id", "genes_final")


def _combined(fx):
    """Wide cohort frequencies with the file each ancestry's value came from."""
    af_long = frequency.allele_freq(fx.view("g_geno"), fx.view("g_sample"), ["site_id"])
    name = F.concat_ws("_", "ancestry", "gene", F.lit("chr1_100-200_2.afreq"))
    named = af_long.join(fx.view("g_site").select("site_id", "gene"), "site_id").withColumn("gene", name)
    return frequency.popmax_wide(frequency.combine_af(named, ["site_id"]))


@query("rowwise_max", ["g_popmax"], "SELECT site_id, max_value FROM g_popmax")
def rowwise_max(fx):
    return _combined(fx).select("site_id", fields.rowwise_max(*[f"af_{a}" for a in ANCESTRIES]).alias("max_value"))


# --- functions ----------------------------------------------------------------


@query(
    "parse_interval",
    ["g_region"],
    """SELECT concat(contig, ':', start_pos, '-', end_pos) AS region, contig, start_pos, end_pos, CAST(NULL AS VARCHAR) AS bare_contig,
 start_pos AS bare_start, CAST(NULL AS BIGINT) AS bad_start FROM g_region""",
)
def parse_interval(fx):
    text = F.concat(F.col("contig"), F.lit(":"), F.col("start_pos").cast("string"), F.lit("-"), F.col("end_pos").cast("string"))
    full, bare = keys.parse_interval("region"), keys.parse_interval(F.substring_index("region", ":", -1))
    bad = keys.parse_interval(F.concat("region", F.lit("x")))
    return fx.view("g_region").select(text.alias("region")).select(
        "region", full["contig"].alias("contig"), full["start_pos"].alias("start_pos"), full["end_pos"].alias("end_pos"),
        bare["contig"].alias("bare_contig"), bare["start_pos"].alias("bare_start"), bad["start_pos"].alias("bad_start"),
    )


@query(
    "variant_id",
    ["g_site"],
    f"SELECT site_id, {VID} AS variant_id, CASE WHEN clnsig IS NOT NULL THEN concat(contig, ':', pos, ':', ref, ':', clnsig) END AS with_null FROM g_site",
)
def variant_id(fx):
    return fx.view("g_site").select(
        "site_id", keys.variant_id().alias("variant_id"), keys.variant_id(alt="clnsig").alias("with_null")
    )


@query(
    "normalise_contig",
    ["g_site"],
    "SELECT site_id, replace(contig, 'chr', '') AS plain, contig AS prefixed, concat('chr', replace(contig, 'chr', ''), '_chr') AS inner_kept FROM g_site",
)
def normalise_contig(fx):
    plain = keys.norm_contig("contig")
    return fx.view("g_site").select(
        "site_id",
        plain.alias("plain"),
        keys.norm_contig(plain, "chr").alias("prefixed"),
        keys.norm_contig(F.concat(plain, F.lit("_chr")), "chr").alias("inner_kept"),
    )


@query(
    "json_alleles_to_key",
    ["g_gnomad"],
    """SELECT locus, array_to_string(from_json(alleles, '["VARCHAR"]'), ':') AS alleles_key FROM g_gnomad""",
)
def json_alleles_to_key(fx):
    return fx.view("g_gnomad").select("locus", keys.alleles_key("alleles").alias("alleles_key"))


@query(
    "is_snp",
    ["g_site"],
    """SELECT site_id, ref <> alt AS plain, false AS insertion, false AS same,
 (CASE WHEN ref <> alt THEN 1 ELSE 0 END + CASE WHEN alt <> ref THEN 1 ELSE 0 END) = 1 AS two_changes, ref <> alt AS padded, false AS symbolic FROM g_site""",
)
def is_snp(fx):
    sites = fx.view("g_site")
    return sites.select(
        "site_id",
        keys.is_snp("ref", "alt").alias("plain"),
        keys.is_snp(F.col("ref"), F.concat("ref", F.lit("T"))).alias("insertion"),
        keys.is_snp("ref", "ref").alias("same"),
        keys.is_snp(F.concat("ref", "alt"), F.concat("alt", "ref")).alias("two_changes"),
        keys.is_snp(F.concat("ref", F.lit("GT")), F.concat("alt", F.lit("GT"))).alias("padded"),
        keys.is_snp(F.col("ref"), F.lit("*")).alias("symbolic"),
    )


@query(
    "explode_ann",
    ["g_ann"],
    """SELECT site_id, string_split(e, '|')[2] AS "EFFECT", ac FROM (SELECT site_id, regexp_extract(info, 'AC=([0-9]+)', 1) AS ac,
 unnest(string_split(regexp_extract(info, '(^|;)ANN=([^;]*)', 2), ',')) AS e FROM g_ann)""",
)
def explode_ann(fx):
    rows = fx.view("g_ann").select("site_id", "info", fields.info_field("info", "AC").alias("ac"))
    return annotation.explode_ann(rows).select("site_id", "EFFECT", "ac")


@query(
    "split_multiallelic",
    ["g_multi"],
    """SELECT site_id, contig, pos, ref, i - 1 AS alt_index, string_split(alts, ',')[i] AS alt, string_split(ac, ',')[i] AS ac
FROM g_multi, LATERAL (SELECT unnest(generate_series(1, 2)) AS i)""",
)
def split_multiallelic(fx):
    rows = annotation.split_alleles(fx.view("g_multi"), "alts", per_allele=("ac",))
    return rows.withColumn("alt_index", F.col("alt_index").cast("bigint"))


@query(
    "match_ann_allele",
    ["g_vcf", "g_site"],
    f"""SELECT site_id, alt, effect FROM (SELECT CAST(replace(id, 'rs', '') AS BIGINT) AS site_id, alt, effect FROM ({CONSEQUENCE_SQL}) t)
UNION ALL SELECT site_id, 'N' AS alt, CAST(NULL AS VARCHAR) AS effect FROM g_vcf""",
)
def match_ann_allele(fx):
    # One ALT that no entry annotates ("N") is added to every site: it stays, without consequence.
    rows = fx.view("g_vcf").withColumn("alts", F.concat("alts", F.lit(",N"))).select("site_id", "alts", "info")
    alleles = annotation.split_alleles(rows, "alts")
    return annotation.explode_ann(alleles, annotation.match_allele(annotation.ann_entries())).select(
        "site_id", "alt", F.col("EFFECT").alias("effect")
    )


@query(
    "split_column",
    ["g_site", "g_multi"],
    """SELECT site_id, string_split(geneinfo, ':')[1] AS g1, string_split(geneinfo, ':')[2] AS g2, string_split(geneinfo, ':')[3] AS g3,
 CAST(NULL AS VARCHAR) AS g4, string_split(geneinfo, '|')[2] AS second, string_split(alts, ',')[2] AS alt2 FROM g_site LEFT JOIN g_multi USING (site_id)""",
)
def split_column(fx):
    sites = fx.view("g_site").select("site_id", "geneinfo").join(fx.view("g_multi").select("site_id", "alts"), "site_id", "left")
    pipes = fields.split_cols("geneinfo", r"\|", ["first", "second"])
    alts = fields.split_cols("alts", ",", ["alt1", "alt2"])
    return sites.select("site_id", *fields.split_cols("geneinfo", ":", ["g1", "g2", "g3", "g4"]), pipes[1], alts[1])


@query(
    "geneinfo_symbol",
    ["g_site"],
    """SELECT site_id, string_split(geneinfo, ':')[1] AS symbol, concat(string_split(geneinfo, ':')[1], ';LOC', site_id % 9) AS symbols FROM g_site""",
)
def geneinfo_symbol(fx):
    return fx.view("g_site").select(
        "site_id",
        fields.geneinfo_symbol("geneinfo").alias("symbol"),
        F.array_join(fields.geneinfo_symbols("geneinfo"), ";").alias("symbols"),
    )


@query(
    "gene_from_filename",
    ["g_site"],
    "SELECT site_id, gene, concat('afr_', gene, '_7_', pos, '-', pos + 9, '_2.afreq') AS other FROM g_site",
)
def gene_from_filename(fx):
    def name(a):
        span = F.concat_ws("-", "pos", F.col("pos") + 9)
        return F.concat(F.concat_ws("_", F.lit(a), "gene", F.lit("7"), span), F.lit("_2.afreq"))

    return fx.view("g_site").select(
        "site_id", keys.gene_from_path(name("eur"), "eur").alias("gene"), keys.gene_from_path(name("afr"), "eur").alias("other")
    )


@query(
    "flip_dosage",
    ["g_geno"],
    "SELECT sample_id, site_id, 2 - alt_dosage AS flipped, alt_dosage AS twice, CAST(NULL AS INTEGER) AS outside FROM g_geno",
)
def flip_dosage(fx):
    once = fields.flip_dosage("alt_dosage")
    return fx.view("g_geno").select(
        "sample_id", "site_id", once.alias("flipped"), fields.flip_dosage(once).alias("twice"),
        fields.flip_dosage(F.col("alt_dosage") + 5).alias("outside"),
    )


@query(
    "parse_score_list",
    ["g_revel"],
    """SELECT site_id, i - 1 AS place, TRY_CAST(string_split(replace(replace(revel_score, '[', ''), ']', ''), ',')[i] AS DOUBLE) AS score
FROM g_revel, LATERAL (SELECT unnest(generate_series(1, len(string_split(revel_score, ',')))) AS i)""",
)
def parse_score_list(fx):
    scores = fx.view("g_revel").select("site_id", F.posexplode(fields.score_array("revel_score")).alias("place", "score"))
    return scores.withColumn("place", F.col("place").cast("bigint"))


@query("parse_score", ["g_revel"], "SELECT site_id, TRY_CAST(revel_scalar AS DOUBLE) AS score FROM g_revel")
def parse_score(fx):
    return fx.view("g_revel").select("site_id", fields.score("revel_scalar").alias("score"))


@query("pad_interval", ["g_hipsi"], "SELECT contig, start_pos - 10 AS start_pos, end_pos + 10 AS end_pos FROM g_hipsi")
def pad_interval(fx):
    from allelio.operators.intervals import pad_intervals

    return pad_intervals(fx.view("g_hipsi"))


@query(
    "gene_alias",
    ["g_site"],
    "SELECT site_id, CASE WHEN gene = 'OBSCN' THEN 'NKX2-5' ELSE gene END AS gene FROM g_site",
)
def gene_alias(fx):
    spelled = F.when(F.col("gene") == "OBSCN", F.lit("NKX2_5")).otherwise(F.col("gene"))
    return fx.view("g_site").select("site_id", keys.canonical_gene(spelled).alias("gene"))


@query(
    "fix_info_header",
    ["g_site"],
    """SELECT site_id, CASE WHEN site_id % 2 = 0 AND site_id % 3 = 0 THEN concat('##INFO=<ID=', gene, site_id, ',Description="Description not provided",Number=.,Source="a,b",Type=String>')
 WHEN site_id % 2 = 0 THEN concat('##INFO=<ID=', gene, site_id, ',Number=.,Type=String,Description="Description not provided">')
 WHEN site_id % 3 = 0 THEN concat('##INFO=<ID=', gene, site_id, ',Description="', effect, '",Number=1,Source="a,b",Type=Integer>')
 ELSE concat('##INFO=<ID=', gene, site_id, ',Number=1,Type=Integer,Description="', effect, '">') END AS line FROM g_site""",
)
def fix_info_header(fx):
    text = F.when(F.col("site_id") % 2 == 0, F.lit("")).otherwise(F.col("effect"))
    name, described = F.concat(F.lit("##INFO=<ID="), "gene", F.col("site_id").cast("string")), F.concat(F.lit('Description="'), text, F.lit('"'))
    last = F.concat(name, F.lit(",Number=1,Type=Integer,"), described, F.lit(">"))
    early = F.concat(name, F.lit(","), described, F.lit(',Number=1,Source="a,b",Type=Integer>'))
    line = F.when(F.col("site_id") % 3 == 0, early).otherwise(last)
    return fx.view("g_site").select("site_id", fields.repair_header(line).alias("line"))


@query(
    "case_when",
    ["g_multi"],
    """SELECT site_id, CASE WHEN site_id % 2 = 0 THEN string_split(alts, ',')[1] WHEN site_id % 5 = 0 THEN string_split(alts, ',')[2] END AS alt_corrected FROM g_multi""",
)
def case_when(fx):
    # The ALT that equals the annotated allele, NULL if none does.
    first, second = fields.split_cols("alts", ",", ["a1", "a2"])
    allele = F.when(F.col("site_id") % 2 == 0, first).when(F.col("site_id") % 5 == 0, second).otherwise(F.lit("none"))
    rows = fx.view("g_multi").select("site_id", first, second, allele.alias("allele"))
    return rows.select(
        "site_id",
        F.when(F.col("allele") == F.col("a1"), F.col("a1")).when(F.col("allele") == F.col("a2"), F.col("a2")).alias("alt_corrected"),
    )


@query(
    "strip_suffix",
    ["g_site"],
    "SELECT site_id, concat(gene, '_dcm_lof') AS raw, concat('a.raw_', gene) AS inner_kept, concat('eur_', gene) AS afreq FROM g_site",
)
def strip_suffix(fx):
    return fx.view("g_site").select(
        "site_id",
        keys.strip_suffix(F.concat("gene", F.lit("_dcm_lof.raw")), ".raw", ".bed").alias("raw"),
        keys.strip_suffix(F.concat(F.lit("a.raw_"), "gene"), ".raw").alias("inner_kept"),
        keys.strip_suffix(F.concat(F.lit("eur_"), "gene", F.lit(".afreq")), ".raw", ".bed", ".afreq").alias("afreq"),
    )


@query(
    "info_field",
    ["g_vcf"],
    """SELECT site_id, CAST(site_id % 5 AS VARCHAR) AS ac, geneinfo, coalesce(clnsig, '.') AS clnsig, clnrevstat,
 CAST(NULL AS VARCHAR) AS flag, CAST(NULL AS VARCHAR) AS missing FROM g_vcf""",
)
def info_field(fx):
    def info(key):
        return fields.info_field("info", key)

    return fx.view("g_vcf").select(
        "site_id", info("AC").alias("ac"), info("GENEINFO").alias("geneinfo"), info("CLNSIG").alias("clnsig"),
        info("CLNREVSTAT").alias("clnrevstat"), info("DB").alias("flag"), info("NOPE").alias("missing"),
    )
