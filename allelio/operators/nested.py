"""Flattening of nested site frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelio.config import PUBLIC_ANCESTRIES
from allelio.functions.keys import _col, is_snp

FREQ_FIELDS = ["AC", "AF", "AN", "homozygote_count"]
FAFMAX_FIELDS = ["faf95_max", "faf95_max_gen_anc", "faf99_max", "faf99_max_gen_anc"]
GRPMAX_FIELDS = ["AC", "AF", "AN", "homozygote_count", "gen_anc"]
REGION_FLAGS = [
    "fail_interval_qc",
    "outside_broad_capture_region",
    "outside_ukb_capture_region",
    "not_called_in_exomes",
    "not_called_in_genomes",
]


def keep_fields(array: Column | str, fields: list[str]) -> Column:
    """Array of structs with only some fields in each element."""
    return F.transform(_col(array), lambda x: F.struct(*[x[f].alias(f) for f in fields]))


def pick_fields(struct: Column | str, fields: list[str]) -> Column:
    """Struct with only some of its fields."""
    return F.struct(*[_col(struct)[f].alias(f) for f in fields])


def array_at(array: Column | str, index: int) -> Column:
    """Element by 0-based index; NULL out of range."""
    return F.get(_col(array), F.lit(index))


def array_field(array: Column | str, field: str) -> Column:
    """Array of one field from an array of structs."""
    return F.transform(_col(array), lambda x: x[field])


def array_to_columns(array: Column | str, fields: list[str], index_map: dict[str, int]) -> list[Column]:
    """Columns ``<label>_<field>`` from labelled places of an array of structs."""
    return [array_at(array, i)[f].alias(f"{label}_{f}") for label, i in index_map.items() for f in fields]


def ancestry_index(labels: list[str] | None = None, first: int = 1) -> dict[str, int]:
    """Place of each ancestry in a frequency array whose place 0 holds the total."""
    return {label: first + i for i, label in enumerate(labels or PUBLIC_ANCESTRIES)}


def select_frequencies(df: DataFrame) -> DataFrame:
    """Key, region flags, and the joint, exome and genome frequency blocks cut to the fields in use."""
    cols = [F.col("region_flags"), F.col("freq_comparison_stats")]
    for block in ("joint", "exomes", "genomes"):
        b = F.col(block)
        cols += [
            keep_fields(b["freq"], FREQ_FIELDS).alias(f"{block}_freq"),
            b["faf"].alias(f"{block}_faf"),
            pick_fields(b["fafmax"], FAFMAX_FIELDS).alias(f"{block}_fafmax"),
            pick_fields(b["grpmax"], GRPMAX_FIELDS).alias(f"{block}_grpmax"),
        ]
    return df.select("locus", "alleles", *cols)


def flatten_frequencies(df: DataFrame, index_map: dict[str, int] | None = None) -> DataFrame:
    """One flat row per site: alleles, joint totals, group maximum, filtering frequencies, flags, per-ancestry columns.

    Takes the nested site table itself or the output of ``select_frequencies``; only the fields named here are read.
    """
    if "joint" in df.columns:
        df = select_frequencies(df)
    ref, alt = array_at("alleles", 0), array_at("alleles", 1)
    total, faf = array_at("joint_freq", 0), array_at("joint_faf", 0)
    stats = F.col("freq_comparison_stats")
    return df.select(
        "locus",
        "alleles",
        ref.alias("ref"),
        alt.alias("alt"),
        is_snp(ref, alt).alias("is_snp"),
        *[total[f].alias(f"joint_{f}") for f in ("AF", "AC", "AN")],
        *[F.col("joint_grpmax")[f].alias(f"joint_grpmax_{f}") for f in ("AF", "AC", "AN", "gen_anc")],
        *[faf[f].alias(f"joint_{f}") for f in ("faf95", "faf99")],
        *[F.col("joint_fafmax")[f].alias(f"joint_{f}") for f in FAFMAX_FIELDS],
        *[F.col("region_flags")[f].alias(f) for f in REGION_FLAGS],
        array_at(stats["contingency_table_test"], 0)["p_value"].alias("freq_cong_pval"),
        stats["cochran_mantel_haenszel_test"]["p_value"].alias("freq_cmh_pval"),
        *array_to_columns("joint_freq", ["AF", "AC", "AN"], index_map or ancestry_index()),
    )
