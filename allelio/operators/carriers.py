"""Who carries what: burden per person and gene set, carrier counts, variant summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelio.config import CARRIER_GENES, DISEASES, GENE_SOURCE_ORDER, IMPACTS, TIER_GENES
from allelio.functions.keys import gene_from_path
from allelio.operators.intervals import prune_to_variants
from allelio.operators.joins import BROADCAST_BYTES, first_by, lookup_join, semi_join, stack, staged

SET = ["gene", "disease", "impact"]
MASTER_GENES = sorted({g for panel in TIER_GENES.values() for g in panel})


def keep_samples(genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """Calls of listed samples."""
    return semi_join(genotypes, samples, "sample_id")


def _narrowed(genotypes: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    return prune_to_variants(genotypes, ids) if {"contig", "pos"} <= set(key) else genotypes


def extract_variants(genotypes: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    """Calls of listed variants. With a positional key, row groups far from all of them are not read."""
    ids, size = staged(ids.select(*key).distinct(), "variant-ids")
    return lookup_join(_narrowed(genotypes, ids, key), ids, key, "left_semi", size=size)


def carrier_genes(df: DataFrame, genes: list[str] | None = None) -> DataFrame:
    return df.filter(F.col("gene").isin(genes or CARRIER_GENES))


def burden(genotypes: DataFrame, tiers: DataFrame, key: list[str], na_as_zero: bool = False, prune: bool = True) -> DataFrame:
    """ALT alleles per sample and (gene, disease, impact) set.

    ``tiers`` names the sets of each variant; a variant named twice in a set counts once. Samples without any row in
    a set are homozygous reference there and get no row. The burden is NULL if all calls of the set are missing.
    ``prune=False`` is for calls that are narrowed to the variants already.
    """
    members, size = staged(tiers.select(*key, *SET).distinct(), "set-members")
    small = size <= BROADCAST_BYTES
    calls = (_narrowed(genotypes, members, key) if prune else genotypes).select(*key, "sample_id", "alt_dosage")
    calls = lookup_join(calls, members, key, size=size)
    summed = calls.groupBy("sample_id", *SET).agg(
        F.coalesce(F.sum("alt_dosage"), F.lit(0)).cast("bigint").alias("burden"),
        F.count_if(F.col("alt_dosage").isNull()).alias("_missing"),
    )
    if na_as_zero:
        return summed.select("sample_id", *SET, "burden")
    known = F.when(F.col("_missing") < F.col("_size"), F.col("burden"))
    # At most as many rows as members, mostly far fewer: of a long list, this one is measured by itself.
    sizes = members.groupBy(*SET).agg(F.count(F.lit(1)).alias("_size"))
    return lookup_join(summed, sizes, SET, small=small or None, stage=not small).select("sample_id", *SET, known.alias("burden"))


def burden_columns(genes: dict[str, list[str]] | None = None) -> list[str]:
    """``<gene>_<disease>_<impact>`` for every gene of a disease's panel."""
    return [f"{g}_{d}_{i}" for d in DISEASES for g in (genes or TIER_GENES)[d] for i in IMPACTS]


def burden_wide(burdens: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per sample, one column per named set."""
    named = burdens.withColumn("_set", F.concat_ws("_", *SET))
    return named.groupBy("sample_id").pivot("_set", columns or burden_columns()).agg(F.sum("burden"))


def with_cohort(table: DataFrame, samples: DataFrame, fill: int | None = None) -> DataFrame:
    """All cohort members; those without a row get NULL, or ``fill``, in every column of ``table``."""
    marked = table.withColumn("_known", F.lit(True))
    out = samples.select("sample_id").distinct().join(marked, "sample_id", "left")
    if fill is not None:
        cols = [c for c in table.columns if c != "sample_id"]
        out = out.withColumns({c: F.when(F.col("_known"), F.col(c)).otherwise(F.lit(fill)) for c in cols})
    return out.drop("_known")


def carrier_counts(burdens: DataFrame, distinct_genes: bool = False) -> DataFrame:
    """Per sample, the number of sets with a burden above 0: per impact, per disease and impact, and in total.

    ``n_`` columns count sets, ``is_`` columns tell 0/1 (NULL where every burden of the group is NULL). A gene that
    counts for two diseases counts twice in the totals unless ``distinct_genes``.
    """
    groups = {f"{i}_carriers": f"impact = '{i}'" for i in IMPACTS}
    groups |= {f"{d}_{i}_carriers": f"disease = '{d}' AND impact = '{i}'" for d in DISEASES for i in IMPACTS}
    groups |= {"lp_p_pupv_carriers": "true"}
    groups |= {f"{d}_lp_p_pupv_carriers": f"disease = '{d}'" for d in DISEASES}
    if distinct_genes:
        # First one row per person and gene, so that no distinct count is needed.
        hits = [F.expr(f"max(CAST(burden > 0 AS INT)) FILTER (WHERE {group}) AS {name}") for name, group in groups.items()]
        burdens = burdens.groupBy("sample_id", "gene").agg(*hits)
        texts = [t for name in groups for t in (f"count_if({name} = 1) AS n_{name}", f"max({name}) AS is_{name}")]
    else:
        texts = [
            t
            for name, group in groups.items()
            for t in (
                f"count(*) FILTER (WHERE {group} AND burden > 0) AS n_{name}",
                f"max(CAST(burden > 0 AS INT)) FILTER (WHERE {group}) AS is_{name}",
            )
        ]
    return burdens.groupBy("sample_id").agg(*[F.expr(t) for t in texts])


def final_gene(df: DataFrame, from_paths: bool = True) -> DataFrame:
    """``genes_final``: first known gene over the ancestries' frequency files."""

    def gene(a):
        return gene_from_path(f"gene_{a}", a) if from_paths else F.col(f"gene_{a}")

    return df.withColumn("genes_final", F.coalesce(*[gene(a) for a in GENE_SOURCE_ORDER]))


def counted_variants(combined: DataFrame, tiered: DataFrame, clinvar: DataFrame, key: list[str], **kw) -> DataFrame:
    """Frequency rows of variants in either list, once per variant, with final gene and list membership flags.

    The gene comes from the ancestries' frequency files unless ``combined`` already has ``genes_final``. Both lists become one table of flags per variant, so one join does the choice and both flags.
    """
    none, one = F.lit(0), F.lit(1)
    marks = stack(
        [
            clinvar.select(*key, one.alias("lp_p"), none.alias("lof_missense")),
            tiered.select(*key, none.alias("lp_p"), one.alias("lof_missense")),
        ]
    )
    marks = marks.groupBy(*key).agg(F.max("lp_p").alias("lp_p"), F.max("lof_missense").alias("lof_missense"))
    once = first_by(lookup_join(combined, marks, key, stage=True), key, ["max_value"])
    named = once if "genes_final" in once.columns else final_gene(once, **kw)
    return named.filter(F.col("genes_final").isin(MASTER_GENES))


def variant_counts(counted: DataFrame) -> DataFrame:
    """Gene by P/LP flag, with zero cells."""
    return counted.groupBy("genes_final").agg(
        F.count_if(F.col("lp_p") == 0).alias("not_lp_p"), F.count_if(F.col("lp_p") == 1).alias("lp_p")
    )

