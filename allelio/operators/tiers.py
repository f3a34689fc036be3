"""Disease tiers: which variants count for which disease."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelio.config import DISEASES, FAF_CUTOFFS, KNOWN_MECHANISM, PLP_GENES, RARE_AF, TIER_GENES
from allelio.functions.fields import geneinfo_symbol, nan_to_null
from allelio.operators.joins import BROADCAST_BYTES, lookup_join, semi_join, staged


def tier_table(spark: SparkSession, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """``disease, impact, gene, faf_cutoff``: disease genes in which the impact is a known mechanism."""
    cutoffs = cutoffs or FAF_CUTOFFS
    rows = [
        (d, impact, gene, float(cutoffs[d]))
        for d in DISEASES
        for impact, mechanism in KNOWN_MECHANISM.items()
        for gene in TIER_GENES[d]
        if gene in mechanism
    ]
    return spark.createDataFrame(rows, "disease string, impact string, gene string, faf_cutoff double")


def disease_panel(spark: SparkSession, genes: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(d, g) for d, panel in (genes or PLP_GENES).items() for g in panel]
    return spark.createDataFrame(rows, "disease string, gene string")


def with_frequencies(variants: DataFrame, cohort: DataFrame, public: DataFrame, key: list[str]) -> DataFrame:
    """Variants with ``cohort_af`` and ``public_af``; NULL where a table does not hold the variant.

    Each frequency table is unique per key and far larger than the variant list, so the list is what is written once
    and measured: the tables are first cut to its keys. What is left is no longer than the list.
    """
    variants, size = staged(variants, "variants")
    small = 2 * size <= BROADCAST_BYTES
    ids = variants.select(*key).distinct()

    def cut(table: DataFrame, name: str) -> DataFrame:
        af = table.select(*key, nan_to_null("max_value").alias(name))
        return lookup_join(af, ids, key, "left_semi", small=small)

    afs = cut(cohort, "cohort_af").join(cut(public, "public_af"), key, "full")
    return lookup_join(variants, afs, key, "left", small=small)


def tiered_variants(
    variants: DataFrame,
    cohort: DataFrame,
    public: DataFrame,
    key: list[str],
    rarity: float | None = None,
    cutoffs: dict[str, float] | None = None,
) -> DataFrame:
    """LoF and missense variants (``gene, impact``) per disease they count for.

    A variant counts if cohort or public frequency is at most the disease cutoff (and at most ``rarity``). All tier
    cells come from one join with the tier table, which is a fixed list and therefore broadcast.
    """
    tiers = tier_table(variants.sparkSession, cutoffs).withColumn(
        "_cut", F.least("faf_cutoff", F.lit(RARE_AF if rarity is None else rarity))
    )
    with_af = with_frequencies(variants, cohort, public, key)
    hit = (F.col("cohort_af") <= F.col("_cut")) | (F.col("public_af") <= F.col("_cut"))
    return with_af.join(F.broadcast(tiers), ["gene", "impact"]).filter(hit).drop("_cut", "faf_cutoff")


def clinvar_by_disease(clinvar: DataFrame, rare: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """ClinVar variants per disease, by the first GENEINFO symbol or, without one, by the annotated gene.

    ``gene`` of the result is the panel gene that matched, so a variant annotated for several genes makes one set per disease.
    With ``rare`` only variants in that key list are kept.
    """
    if rare is not None:
        clinvar = semi_join(clinvar, rare, key)
    panel = disease_panel(clinvar.sparkSession).withColumnRenamed("gene", "_panel_gene")
    symbol = geneinfo_symbol("geneinfo") if "geneinfo" in clinvar.columns else F.lit(None).cast("string")
    named = clinvar.withColumn("_panel_gene", F.coalesce(symbol, F.col("gene")))
    matched = named.join(F.broadcast(panel), "_panel_gene")
    return matched.withColumn("gene", F.col("_panel_gene")).drop("_panel_gene").withColumn("impact", F.lit("lp_p"))


def id_lists(tiers: DataFrame, key: list[str], by: tuple[str, ...] = ("impact", "disease", "source")) -> DataFrame:
    """Distinct variant keys per list."""
    return tiers.select(*[c for c in by if c in tiers.columns], *key).distinct()
