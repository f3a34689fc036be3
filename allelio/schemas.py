"""Schemas of all inputs and stages; nothing is inferred."""

SITES = "contig string, pos bigint, ref string, alt string, gene string, effect string"

GENOTYPES = "contig string, pos bigint, ref string, alt string, sample_id bigint, alt_dosage int, dataset string"

REGIONS = "chrom string, gene string, region string"

BIM = "chrom string, variant_id string, cm double, pos bigint, a1 string, a2 string"
FAM = "family_id string, sample_id string, father_id string, mother_id string, sex_code int, phenotype string"

_FREQ_BLOCK = (
    "struct<freq:array<struct<AC:bigint,AF:double,AN:bigint,homozygote_count:bigint>>,"
    "faf:array<struct<faf95:double,faf99:double>>,"
    "fafmax:struct<faf95_max:double,faf95_max_gen_anc:string,faf99_max:double,faf99_max_gen_anc:string>,"
    "grpmax:struct<AC:bigint,AF:double,AN:bigint,homozygote_count:bigint,gen_anc:string>>"
)
PUBLIC_SITES = (
    f"locus string, alleles array<string>, joint {_FREQ_BLOCK}, exomes {_FREQ_BLOCK}, genomes {_FREQ_BLOCK}, "
    "region_flags struct<fail_interval_qc:boolean,outside_broad_capture_region:boolean,"
    "outside_ukb_capture_region:boolean,not_called_in_exomes:boolean,not_called_in_genomes:boolean>, "
    "freq_comparison_stats struct<contingency_table_test:array<struct<p_value:double>>,"
    "cochran_mantel_haenszel_test:struct<p_value:double>>"
)

# Text tables: header name in the file -> (column, type). Other columns of the file are ignored.
PUBLIC_TSV = {
    "locus": ("locus", "string"),
    "alleles": ("alleles", "string"),
    "joint_grpmax_AF": ("joint_grpmax_AF", "double"),
}
ANCESTRY_TSV = {"research_id": ("sample_id", "bigint"), "ancestry_pred": ("ancestry", "string")}
AFREQ_TSV = {"ID": ("variant_id", "string"), "ALT_FREQS": ("alt_freq", "double")}
EXON_TSV = {"Hg38 start": ("start_pos", "bigint"), "Hg38 end": ("end_pos", "bigint")}
ANNOVAR_TSV = {
    "Chr": ("contig", "string"),
    "Start": ("pos", "bigint"),
    "Ref": ("ref", "string"),
    "Alt": ("alt", "string"),
    "REVEL_score": ("revel_scalar", "string"),
}
INTERVAR_TSV = {
    "#Chr": ("contig", "string"),
    "Start": ("pos", "bigint"),
    "Ref": ("ref", "string"),
    "Alt": ("alt", "string"),
    "InterVar: InterVar and Evidence": ("intervar", "string"),
}
REVEL_TSV = {
    "locus": ("locus", "string"),
    "ref": ("ref", "string"),
    "alt": ("alt", "string"),
    "revel_score": ("revel_score", "string"),
}
CONSEQUENCE_TSV = {
    name: (name, "bigint" if name == "POS" else "string")
    for name in (
        "CHROM", "POS", "ID", "REF", "ALT", "ALLELE", "EFFECT", "GENE", "FEATURE", "HGVS_C", "HGVS_P",
        "GENEINFO", "CLNSIG", "CLNREVSTAT",
    )
}
