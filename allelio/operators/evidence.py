"""Evidence rules: ClinVar classes and review state, high-PSI exons, REVEL and InterVar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelio.config import CLNSIG_BENIGN, CLNSIG_PLP, EXON_PAD, INTERVAR_PATHOGENIC, REVEL_CUTOFF, TWO_STAR
from allelio.functions.fields import any_score_ge, score
from allelio.operators.intervals import near_intervals
from allelio.operators.joins import consensus, lookup_join, override_rule, stack


def clinvar_classes(include_benign: bool = False) -> list[str]:
    return CLNSIG_PLP + CLNSIG_BENIGN if include_benign else list(CLNSIG_PLP)


def clinvar_significance(df: DataFrame, sigs: list[str] | None = None, include_benign: bool = False) -> DataFrame:
    """Rows of the wanted ClinVar classes, compared as a whole."""
    return df.filter(F.col("clnsig").isin(sigs or clinvar_classes(include_benign)))


def clinvar_two_star(df: DataFrame) -> DataFrame:
    """Rows reviewed by several submitters without conflict, or by an expert panel."""
    return df.filter(F.col("clnrevstat").isin(TWO_STAR))


def clinvar_filter(df: DataFrame, sigs: list[str] | None = None, include_benign: bool = False) -> DataFrame:
    return clinvar_two_star(clinvar_significance(df, sigs, include_benign))


def revel_pass(annovar: DataFrame, cutoff: float = REVEL_CUTOFF, col: str = "revel_scalar") -> DataFrame:
    """Rows whose scalar REVEL score reaches the cutoff."""
    return annovar.filter(score(col) >= cutoff)


def intervar_pathogenic(intervar: DataFrame, col: str = "intervar") -> DataFrame:
    """Rows whose InterVar text names a (likely) pathogenic call."""
    return intervar.filter(F.col(col).rlike(INTERVAR_PATHOGENIC))


def revel_any(scores: DataFrame, cutoff: float = REVEL_CUTOFF, col: str = "revel_score") -> DataFrame:
    """Rows in whose score list one of the first five values reaches the cutoff."""
    return scores.filter(F.col(col).isNotNull() & any_score_ge(col, cutoff))


def lof_in_high_psi(
    lof: DataFrame, exons: DataFrame, gene: str = "TTN", pad: int = EXON_PAD
) -> DataFrame:
    """LoF variants; those of one gene only near an exon in ``exons``, all others (NULL genes too) untouched."""
    own = F.col("gene").eqNullSafe(F.lit(gene))
    return stack([lof.filter(~own), near_intervals(lof.filter(own), exons, pad)])


def gene_consensus(
    missense: DataFrame, annovar: DataFrame, intervar: DataFrame, key: list[str], cutoff: float = REVEL_CUTOFF
) -> DataFrame:
    """Missense variants supported by both a REVEL score and an InterVar call."""
    return consensus(missense, [revel_pass(annovar, cutoff), intervar_pathogenic(intervar)], key)


def missense_supported(
    missense: DataFrame,
    scores: DataFrame,
    annovar: DataFrame,
    intervar: DataFrame,
    key: list[str],
    gene: str = "SCN5A",
    cutoff: float = REVEL_CUTOFF,
) -> DataFrame:
    """Missense variants by REVEL list; those of one gene by REVEL and InterVar consensus instead."""
    both = consensus(revel_pass(annovar, cutoff).select(*key), [intervar_pathogenic(intervar)], key)
    listed = revel_any(scores, cutoff).select(*key)
    marks = stack(
        [
            both.withColumns({"_both": F.lit(True), "_any": F.lit(False)}),
            listed.withColumns({"_both": F.lit(False), "_any": F.lit(True)}),
        ]
    )
    marks = marks.groupBy(*key).agg(F.max("_both").alias("_both"), F.max("_any").alias("_any"))
    flagged = lookup_join(missense, marks, key, "left", stage=True)
    return override_rule(flagged, gene, F.col("_both"), F.col("_any")).drop("_both", "_any")
