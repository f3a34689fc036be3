"""From annotated variant rows to one row per consequence and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelio.config import ANN_FIELDS, CATEGORY_PATTERNS, CONSEQUENCE_COLS
from allelio.functions.fields import ann_field, info_field, info_number_per_allele


def filter_pass(df: DataFrame) -> DataFrame:
    return df.filter(F.col("filter") == "PASS")


def sites_only(df: DataFrame, entry_cols: tuple[str, ...] = ("sample_id", "alt_dosage", "entries")) -> DataFrame:
    """Row fields of a variant matrix without its genotype entries."""
    return df.drop(*entry_cols)


def split_alleles(df: DataFrame, alts: str = "alts", per_allele: tuple[str, ...] = ()) -> DataFrame:
    """One row per ALT allele: ``alt``, its 0-based ``alt_index``, and per-allele columns cut to their own value.

    ``alts`` is an array or comma-joined text.
    """
    values = F.col(alts) if dict(df.dtypes)[alts].startswith("array") else F.split(F.col(alts), ",")
    kept = [c for c in df.columns if c != alts]
    out = df.select(*kept, F.posexplode(values).alias("alt_index", "alt"))
    return out.withColumns({c: info_number_per_allele(c, F.col("alt_index")) for c in per_allele}) if per_allele else out


def ann_entries(info: Column | str = "info") -> Column:
    """ANN entries of an INFO text as an array."""
    return F.split(info_field(info, "ANN"), ",")


def explode_ann(df: DataFrame, entries: Column | None = None) -> DataFrame:
    """One row per ANN entry with its named fields; a row without annotation stays, with NULL fields."""
    exploded = df.withColumn("_entry", F.explode_outer(ann_entries() if entries is None else entries))
    return exploded.withColumns({name: ann_field("_entry", name) for name in ANN_FIELDS}).drop("_entry")


def match_allele(entries: Column, alt: Column | str = "alt") -> Column:
    """Only those ANN entries that annotate this ALT allele."""
    allele = F.col(alt) if isinstance(alt, str) else alt
    return F.filter(entries, lambda e: F.get(F.split(e, r"\|"), F.lit(ANN_FIELDS["ALLELE"])) == allele)


def extract_fields(df: DataFrame) -> DataFrame:
    """Consequence layout, every column taken by name; a source without IDs gets a NULL ID."""
    row_id = F.col("id") if "id" in df.columns else F.lit(None)
    clin = {c: F.nullif(info_field("info", c), F.lit(".")) for c in ("GENEINFO", "CLNSIG", "CLNREVSTAT")}
    own = {
        "CHROM": F.col("contig"),
        "POS": F.col("pos"),
        "ID": row_id.cast("string"),
        "REF": F.col("ref"),
        "ALT": F.col("alt"),
        **{name: F.col(name) for name in ANN_FIELDS},
        **{c: F.col(c) if c in df.columns else v for c, v in clin.items()},
    }
    extra = [c for c in ("source",) if c in df.columns]
    return df.select(*extra, *[own[c].alias(c) for c in CONSEQUENCE_COLS])


def category_flags(patterns: dict[str, tuple[str, str]] | None = None) -> dict[str, Column]:
    """Boolean column per category."""
    return {name: F.col(c).rlike(p) for name, (c, p) in (patterns or CATEGORY_PATTERNS).items()}


def categorise(df: DataFrame, patterns: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per category a consequence belongs to; categories overlap, rows in none are dropped."""
    hits = F.array(*[F.when(test, F.lit(name)) for name, test in category_flags(patterns).items()])
    return df.withColumn("category", F.explode(F.filter(hits, lambda x: x.isNotNull())))
