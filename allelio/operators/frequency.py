"""Allele frequencies per ancestry, their maximum, and the rare-variant lists built from them.

Genotypes are long and sparse: no row means homozygous reference, a row with a NULL dosage means no call. The number
of called alleles is therefore the ploidy of the whole ancestry less the ploidy of its missing calls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelio.config import ANCESTRIES, PAR_X, RARE_AF
from allelio.functions.fields import nan_to_null, rowwise_max
from allelio.operators.joins import lookup_join, union_ids


def founders(samples: DataFrame) -> DataFrame:
    """Samples without a listed parent."""
    return samples.filter((F.col("father_id") == "0") & (F.col("mother_id") == "0"))


def _in_par() -> Column:
    return reduce(lambda a, b: a | b, [F.col("pos").between(s, e) for s, e in PAR_X])


def _attach_samples(genotypes: DataFrame, samples: DataFrame, cols: list[str], sexed: bool, bucketed: bool) -> DataFrame:
    """Calls with ancestry, ALT alleles, missing ploidy, and the ploidy of the whole ancestry at this site.

    On chromosome X outside the pseudo-autosomal regions a male carries one allele; a heterozygous call there
    cannot be right and counts as missing. Without a ``sex`` column every sample is diploid.
    """
    known = samples.filter(F.col("ancestry").isin(ANCESTRIES))
    male = F.col("sex") == "male" if sexed else F.lit(False)
    known = known.select("sample_id", "ancestry", F.coalesce(male, F.lit(False)).alias("male"))
    totals = known.groupBy("ancestry").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("male").alias("n_male")
    )  # one row per label in ANCESTRIES, so always small
    people = known.join(F.broadcast(totals), "ancestry")
    calls = genotypes.select(*cols, "sample_id", "alt_dosage")
    # No sample holds more than its share of the calls, so the buckets of a sample key are even.
    calls = calls.join(people.hint("merge"), "sample_id") if bucketed else lookup_join(calls, people, "sample_id", stage=True)
    haploid_site = F.col("contig").isin("X", "chrX") & ~_in_par() if sexed else F.lit(False)
    haploid = haploid_site & F.col("male")
    alt = F.when(haploid, F.when(F.col("alt_dosage") != 1, F.expr("alt_dosage div 2"))).otherwise(F.col("alt_dosage"))
    missing = F.when(alt.isNull(), F.when(haploid, 1).otherwise(2)).otherwise(0)
    total = 2 * F.col("n") - F.when(haploid_site, F.col("n_male")).otherwise(0)
    return calls.select(
        *cols, "ancestry", alt.cast("bigint").alias("_alt"), missing.cast("bigint").alias("_missing"), total.alias("_total")
    )


def allele_freq(genotypes: DataFrame, samples: DataFrame, key: list[str], by: tuple[str, ...] = (), bucketed: bool = False) -> DataFrame:
    """Long table: ALT count, called alleles and frequency per variant, ancestry (and e.g. ``dataset``).

    ``bucketed`` is for calls and samples stored in equal buckets of ``sample_id`` (``write_buckets``): for a cohort too large to be
    broadcast, they meet where they lie.

    Variants without any carrier or missing call in an ancestry have no row there; their frequency is 0.
    """
    cols = [*key, *by]
    calls = _attach_samples(genotypes, samples, cols, _sexed(samples, key), bucketed)
    return (
        calls.groupBy(*cols, "ancestry")
        .agg(
            F.coalesce(F.sum("_alt"), F.lit(0)).alias("alt_ct"),
            (F.max("_total") - F.sum("_missing")).alias("obs_ct"),
        )
        .withColumn("alt_freq", F.try_divide(F.col("alt_ct"), F.col("obs_ct")))
    )


def _sexed(samples: DataFrame, key: list[str]) -> bool:
    return "sex" in samples.columns and "contig" in key and "pos" in key


def cohort_popmax(genotypes: DataFrame, samples: DataFrame, key: list[str], by: tuple[str, ...] = (), bucketed: bool = False) -> DataFrame:
    """Wide table ``af_<ancestry> ..., max_value`` straight from the calls.

    All ancestries are counted side by side in one aggregation, so the calls shuffle once and only after map-side
    counting. A frequency of 0 is NULL, as in ``combine_af``. Tables that hold the same call more than once (``by``,
    e.g. ``dataset``) are counted apart, and the highest frequency of each ancestry is taken. ``bucketed`` as in ``allele_freq``.
    """
    calls = _attach_samples(genotypes, samples, [*key, *by], _sexed(samples, key), bucketed)
    counts = [
        F.expr(text)
        for a in ANCESTRIES
        for text in (
            f"sum(_alt) FILTER (WHERE ancestry = '{a}') AS alt_{a}",
            f"max(_total) FILTER (WHERE ancestry = '{a}') - sum(_missing) FILTER (WHERE ancestry = '{a}') AS obs_{a}",
        )
    ]
    afs = [F.expr(f"nullif(try_divide(alt_{a}, obs_{a}), 0) AS af_{a}") for a in ANCESTRIES]
    wide = calls.groupBy(*key, *by).agg(*counts).select(*key, *afs)
    if by:
        wide = wide.groupBy(*key).agg(*[F.max(f"af_{a}").alias(f"af_{a}") for a in ANCESTRIES])
    return popmax_wide(wide)


def nonzero_af(af: DataFrame) -> DataFrame:
    """Rows with a frequency above 0; NULL and NaN go too."""
    return af.filter(nan_to_null("alt_freq") > 0)


def combine_af(af: DataFrame, key: list[str]) -> DataFrame:
    """Wide ``af_<ancestry>, gene_<ancestry>`` per variant from long frequencies, as a full outer join would give.

    Needs one grouping instead of five joins. A variant may come from several files (datasets, overlapping genes):
    the highest frequency counts, together with the alphabetically first gene text.
    """
    aggs = [f"max(alt_freq) FILTER (WHERE ancestry = '{a}') AS af_{a}" for a in ANCESTRIES]
    if "gene" in af.columns:
        aggs += [f"min(gene) FILTER (WHERE ancestry = '{a}') AS gene_{a}" for a in ANCESTRIES]
    aggs = [F.expr(text) for text in aggs]
    return nonzero_af(af).groupBy(*key).agg(*aggs)


def combine_af_joined(af: DataFrame, key: list[str]) -> DataFrame:
    """The same table from chained full outer joins; kept as a check of ``combine_af``."""
    af = nonzero_af(af)
    parts = [
        af.filter(F.col("ancestry") == a).groupBy(*key).agg(F.max("alt_freq").alias(f"af_{a}")) for a in ANCESTRIES
    ]
    return reduce(lambda x, y: x.join(y, key, "full"), parts)


def popmax_wide(wide: DataFrame) -> DataFrame:
    """Add the largest frequency over ancestries as ``max_value``."""
    return wide.withColumn("max_value", rowwise_max(*[f"af_{a}" for a in ANCESTRIES]))


def popmax(af: DataFrame, key: list[str]) -> DataFrame:
    """Largest frequency per variant from the long table."""
    return af.groupBy(*key).agg(F.max(nan_to_null("alt_freq")).alias("max_value"))


def rare(df: DataFrame, cutoff: float | Column = RARE_AF, col: str = "max_value") -> DataFrame:
    """Rows whose frequency is known and at most the cutoff."""
    return df.filter(nan_to_null(col) <= (F.lit(cutoff) if isinstance(cutoff, float) else cutoff))


def rare_ids(cohort: DataFrame, public: DataFrame, key: list[str]) -> DataFrame:
    """Keys rare in the cohort or in the public table."""
    return union_ids([cohort, public], key)
