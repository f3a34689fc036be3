"""Whole analyses, composed of operators. Steps that measure or write a join side run jobs while the plan is built."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelio.config import EXON_PAD, RARE_AF, REVEL_CUTOFF, VARIANT_KEY
from allelio.functions.fields import nan_to_null
from allelio.functions.keys import alleles_key, canonical_gene, norm_contig, split_locus
from allelio.operators import annotation, carriers, evidence, frequency, intervals, tiers
from allelio.operators.joins import annotate, first_by, lookup_join, semi_join, stack, staged
from allelio.operators.normalise import normalise
from allelio.sources.writers import export_ids, save_stage, write_tsv


def extract_gene_sites(sites: DataFrame, regions: DataFrame, closed: bool = False, prune: bool = True) -> DataFrame:
    """Sites of every gene region, without genotype entries; a site in two regions appears for both genes."""
    if prune:
        sites = intervals.prune_to_regions(sites, regions)
    panel = regions.withColumn("gene", canonical_gene("gene"))
    rows = annotation.sites_only(sites)
    return intervals.interval_join(rows.drop("gene") if "gene" in rows.columns else rows, panel, closed).drop(
        "start_pos", "end_pos"
    )


def consequence_table(
    rows: DataFrame,
    clinvar: DataFrame | None = None,
    genome: DataFrame | None = None,
    chunk: int | None = None,
    pass_only: bool = False,
) -> DataFrame:
    """Annotated variant rows to the 14-column layout, one row per allele and annotation entry of that allele.

    Alleles are split and matched to their entries before left alignment, because entries name the ALT as written.
    ClinVar columns come from ``clinvar`` if given, else from INFO. Rows are dealt out by their bytes first: the texts are long to
    read compared with their files, of which a few would leave all rows to as many tasks.
    """
    if pass_only:
        rows = annotation.filter_pass(rows)
    rows = rows.hint("rebalance")
    alleles = annotation.split_alleles(rows, "alts").drop("alt_index")
    entries = annotation.match_allele(annotation.ann_entries())
    out = annotation.explode_ann(alleles, entries)
    if genome is not None:
        out = normalise(staged(out, "alleles")[0], genome, chunk)
    if clinvar is not None:
        out = annotate(out.drop("GENEINFO", "CLNSIG", "CLNREVSTAT"), clinvar, VARIANT_KEY, ["GENEINFO", "CLNSIG", "CLNREVSTAT"])
    return annotation.extract_fields(out)


def categorised_consequences(rows: DataFrame, **kw) -> DataFrame:
    """Consequence rows with their category (clinvar, lof, missense); a row in two categories appears twice."""
    return annotation.categorise(consequence_table(rows, **kw))


def public_rare(public: DataFrame, cutoff: float | Column = RARE_AF, af: str = "joint_grpmax_AF") -> DataFrame:
    """Flat public frequencies to rare variants with the cohort's key (contig without prefix).

    ``alleles`` is JSON text or an array.
    """
    rare = public.filter(nan_to_null(af) <= cutoff)
    locus = split_locus("locus")
    kinds = {f.name: f.dataType for f in public.schema}
    alleles = F.col("alleles") if isinstance(kinds["alleles"], T.ArrayType) else F.split(alleles_key("alleles"), ":")
    extra = [c for c in public.columns if c not in ("locus", "alleles", af)]
    return rare.select(
        norm_contig(locus["contig"]).alias("contig"),
        locus["pos"].alias("pos"),
        F.get(alleles, F.lit(0)).alias("ref"),
        F.get(alleles, F.lit(1)).alias("alt"),
        F.col(af).alias("max_value"),
        *extra,
    )


def cohort_rare(
    genotypes: DataFrame, samples: DataFrame, key: list[str], cutoff: float | Column = RARE_AF
) -> DataFrame:
    """Variants whose largest ancestry frequency in the cohort is at most the cutoff."""
    return frequency.rare(frequency.cohort_popmax(genotypes, samples, key), cutoff)


def variant_summary(combined: DataFrame, tiered: DataFrame, clinvar: DataFrame, key: list[str], **kw) -> DataFrame:
    """Gene by P/LP counts over the variants of both final lists."""
    return carriers.variant_counts(carriers.counted_variants(combined, tiered, clinvar, key, **kw))


def carrier_status(
    genotypes: DataFrame, sets: DataFrame, samples: DataFrame, key: list[str], distinct_genes: bool = False, prune: bool = True
) -> DataFrame:
    """Carrier counts of every cohort member; members without an ALT allele in any set have 0."""
    burdens = carriers.burden(genotypes, sets, key, prune=prune)  # cut to the cohort last, when calls are already summed
    return carriers.with_cohort(carriers.carrier_counts(burdens, distinct_genes), samples, fill=0)


@dataclass
class CohortInputs:
    """Inputs of ``run_cohort``. Contigs may be written with or without ``chr`` in any table."""

    rows: DataFrame  # annotated variant rows: contig, pos, id, ref, alts, filter, info, source (exome or wgs)
    genotypes: DataFrame
    samples: DataFrame
    regions: DataFrame
    public: DataFrame  # flat public frequencies: locus, alleles, joint_grpmax_AF
    exons: DataFrame
    annovar: DataFrame
    intervar: DataFrame
    revel: DataFrame
    clinvar: DataFrame | None = None  # contig, pos, ref, alt, GENEINFO, CLNSIG, CLNREVSTAT; else taken from INFO
    genome: DataFrame | None = None  # contig, chunk_no, seq: left-align against it
    chunk: int | None = None  # bases per genome row
    rarity: float = RARE_AF
    cutoffs: dict[str, float] | None = None
    revel_cutoff: float = REVEL_CUTOFF
    pad: int = EXON_PAD
    # Genotypes with a ``dataset`` column hold the same call several times: frequencies are counted per dataset,
    # carriers in one. Carriers and summary go by the variant lists of one source (None: all).
    frequency_datasets: tuple[str, ...] = ("exome", "clinvar")
    carrier_dataset: str = "exome"
    carrier_source: str | None = "exome"


def plain_contigs(table: DataFrame | None) -> DataFrame | None:
    """The table with contigs without prefix."""
    return None if table is None else table.withColumn("contig", norm_contig("contig"))


def aligned(table: DataFrame, genome: DataFrame, chunk: int) -> DataFrame:
    """The table under left-aligned keys: each of its indels is aligned once, and rows take the key of theirs.

    Rows that were written as different indels, but are the same one, get equal keys.
    """
    key, places = VARIANT_KEY, ("pos", "ref", "alt")
    indels = table.filter("length(ref) + length(alt) > 2").select(*key).distinct()
    indels, _ = staged(indels.withColumns({f"written_{c}": F.col(c) for c in places}), "indels")
    moved = normalise(indels, genome, chunk).filter("pos <> written_pos OR ref <> written_ref OR alt <> written_alt")
    new = moved.select("contig", *[F.col(f"written_{c}").alias(c) for c in places], *[F.col(c).alias(f"aligned_{c}") for c in places])
    found = lookup_join(table, new, key, "left", stage=True)
    return found.withColumns({c: F.coalesce(f"aligned_{c}", c) for c in places}).select(*table.columns)


def run_cohort(x: CohortInputs, stage_dir: str) -> dict[str, DataFrame]:
    """From annotated variants and calls to tiers, carrier counts and the variant summary.

    Tables with several readers are written below ``stage_dir`` once: categorised consequences, cohort and public
    frequencies, and the final variant sets.
    """
    key = VARIANT_KEY
    regions = plain_contigs(x.regions)
    exons = plain_contigs(x.exons)
    # Narrow the scans first, on contigs as stored, then bring the names to one style and filter exactly.
    rows = plain_contigs(intervals.prune_to_regions(x.rows, regions, either_style=True))
    calls = plain_contigs(intervals.prune_to_regions(x.genotypes, regions, either_style=True))
    calls = intervals.filter_intervals(calls, regions, closed=True)
    inside = intervals.filter_intervals(rows, regions)
    if "filter" in inside.columns:  # only genome rows carry calls that failed
        inside = inside.filter(~F.col("source").eqNullSafe("wgs") | (F.col("filter") == "PASS"))
    clinvar, genome, annovar, intervar, revel = [plain_contigs(t) for t in (x.clinvar, x.genome, x.annovar, x.intervar, x.revel)]
    if genome is not None:  # one way to write a variant in every table
        calls = aligned(calls, genome, x.chunk)
        clinvar, annovar, intervar, revel = [t if t is None else aligned(t, genome, x.chunk) for t in (clinvar, annovar, intervar, revel)]
    consequences = categorised_consequences(inside, clinvar=clinvar, genome=genome, chunk=x.chunk).select(
        "source",
        "category",
        F.col("CHROM").alias("contig"),
        F.col("POS").alias("pos"),
        F.col("REF").alias("ref"),
        F.col("ALT").alias("alt"),
        F.col("EFFECT").alias("effect"),
        canonical_gene("GENE").alias("gene"),
        F.col("GENEINFO").alias("geneinfo"),
        F.col("CLNSIG").alias("clnsig"),
        F.col("CLNREVSTAT").alias("clnrevstat"),
    )
    panel = regions.select(canonical_gene("gene").alias("gene"))
    consequences = save_stage(semi_join(consequences, panel, "gene"), stage_dir, "consequences")

    counted, by = calls, ()
    if "dataset" in calls.columns:
        counted = calls.filter(F.col("dataset").isin(*x.frequency_datasets))
        by = ("dataset",)
    cohort = save_stage(frequency.cohort_popmax(counted, x.samples, key, by), stage_dir, "cohort_af")
    public = public_rare(x.public, x.rarity)
    if genome is not None:  # of several rows that are the same variant, the most frequent one counts
        commonest = aligned(public, genome, x.chunk).withColumn("_order", -F.col("max_value"))
        public = first_by(commonest, key, ["_order"]).drop("_order")
    public = save_stage(public, stage_dir, "public_rare")

    lof = evidence.lof_in_high_psi(consequences.filter(F.col("category") == "lof"), exons, pad=x.pad)
    missense = evidence.missense_supported(
        consequences.filter(F.col("category") == "missense"), revel, annovar, intervar, key, cutoff=x.revel_cutoff
    )
    functional = save_stage(stack([lof, missense]).withColumnRenamed("category", "impact"), stage_dir, "functional")
    tiered = tiers.tiered_variants(functional, frequency.rare(cohort, x.rarity), public, key, x.rarity, x.cutoffs)
    plp = tiers.clinvar_by_disease(evidence.clinvar_filter(consequences.filter(F.col("category") == "clinvar")))
    cols = ["source", *key, "gene", "disease", "impact"]
    sets = save_stage(stack([tiered.select(*cols), plp.select(*cols)]).distinct(), stage_dir, "sets")

    listed = sets if x.carrier_source is None else sets.filter(F.col("source") == x.carrier_source)
    # Carriers need only the calls near listed variants. Calls that are still to be aligned may lie further right.
    wanted = carriers.carrier_genes(listed)
    carried = calls if genome is not None else plain_contigs(intervals.prune_to_variants(x.genotypes, wanted, either_style=True))
    if "dataset" in carried.columns:
        carried = carried.filter(F.col("dataset") == x.carrier_dataset)
    rare = frequency.rare(cohort, x.rarity)
    # Where gene regions overlap, a variant goes to the first of the genes that are counted.
    spans = regions.select(canonical_gene("gene").alias("genes_final"), "contig", "start_pos", "end_pos")
    spans = spans.filter(F.col("genes_final").isin(carriers.MASTER_GENES))
    placed = intervals.interval_join(rare.select(*key, "max_value"), spans, closed=True).drop("start_pos", "end_pos")
    is_plp = F.col("impact") == "lp_p"
    return {
        "consequences": consequences,
        "cohort_af": cohort,
        "public_rare": public,
        "rare_ids": frequency.rare_ids(rare, public, key),
        "sets": sets,
        "carriers": carrier_status(carried, wanted, x.samples, key, prune=False),
        "summary": variant_summary(placed, listed.filter(~is_plp), listed.filter(is_plp), key),
    }


def export_cohort(out: dict[str, DataFrame], path: str) -> None:
    """Write what ``run_cohort`` returns: variant ID lists, the carrier table, and the summary as text."""
    base = path.rstrip("/")
    export_ids(out["sets"], f"{base}/variant_lists")
    out["carriers"].write.mode("overwrite").parquet(f"{base}/carriers")
    write_tsv(out["summary"], f"{base}/summary", compression="none")
