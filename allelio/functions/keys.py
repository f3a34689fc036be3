"""Column functions for variant keys, contigs, intervals and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from allelio.config import GENE_ALIASES

BASES = "^[ACGTNM]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_interval(c: Column | str) -> Column:
    """``chr1:100-200`` or ``100-200`` to ``struct(contig, start_pos, end_pos)``; NULL fields if malformed."""
    text = F.trim(_col(c))

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(text, r"^(?:([^:]+):)?(\d+)-(\d+)$", i), F.lit(""))

    return F.struct(
        part(1).alias("contig"),
        part(2).try_cast("bigint").alias("start_pos"),
        part(3).try_cast("bigint").alias("end_pos"),
    )


def variant_id(contig="contig", pos="pos", ref="ref", alt="alt") -> Column:
    """Text key ``contig:pos:ref:alt``; NULL as soon as one part is NULL."""
    return F.concat(
        _col(contig), F.lit(":"), _col(pos).cast("string"), F.lit(":"), _col(ref), F.lit(":"), _col(alt)
    )


def norm_contig(c: Column | str, style: str = "plain") -> Column:
    """Contig without (``plain``) or with (``chr``) its prefix; only a leading ``chr`` is touched."""
    name = _col(c)
    plain = F.when(name.startswith("chr"), name.substr(F.lit(4), F.length(name))).otherwise(name)
    if style == "plain":
        return plain
    if style == "chr":
        return F.concat(F.lit("chr"), plain)
    raise ValueError(f"unknown contig style: {style}")


def contig_rank(c: Column | str) -> Column:
    """Sort value that puts chr2 before chr10 and the numbered contigs before X, Y and M."""
    plain = norm_contig(c)
    named = F.when(plain == "X", 23).when(plain == "Y", 24).when(plain.isin("M", "MT"), 25).otherwise(26)
    return F.coalesce(plain.try_cast("int"), named)


def alleles_key(c: Column | str) -> Column:
    """JSON allele list ``["A","G"]`` to ``A:G``."""
    return F.array_join(F.from_json(_col(c), "array<string>"), ":")


def split_locus(c: Column | str) -> Column:
    """``chr1:100`` to ``struct(contig, pos)``."""
    parts = F.split(_col(c), ":")
    return F.struct(F.get(parts, F.lit(0)).alias("contig"), F.get(parts, F.lit(1)).try_cast("bigint").alias("pos"))


def is_snp(ref="ref", alt="alt") -> Column:
    """Both alleles are plain bases of one length and differ in exactly one place."""
    r, a = _col(ref), _col(alt)
    plain = r.rlike(BASES) & a.rlike(BASES)
    differing = F.size(F.filter(F.zip_with(F.split(r, ""), F.split(a, ""), lambda x, y: x != y), lambda d: d))
    one_base = (F.length(r) == 1) & (F.length(a) == 1)
    return plain & F.when(one_base, r != a).when(F.length(r) == F.length(a), differing == 1).otherwise(False)


def canonical_gene(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Gene symbol with known alternative spellings replaced."""
    pairs = [F.lit(x) for kv in (aliases or GENE_ALIASES).items() for x in kv]
    gene = _col(c)
    return F.when(gene.isNotNull(), F.coalesce(F.create_map(*pairs)[gene], gene))


def strip_suffix(c: Column | str, *suffixes: str) -> Column:
    """Name without a trailing ``.raw``, ``.bed``, ``.afreq`` ...; elsewhere in the name they stay."""
    alternatives = "|".join(s.replace(".", r"\.") for s in suffixes)
    return F.regexp_replace(_col(c), f"(?:{alternatives})$", "")


def gene_from_path(c: Column | str, ancestry: str) -> Column:
    """``eur_BAG3_10_1-2_2.afreq`` to ``BAG3``; a name of another shape stays as it is."""
    return F.regexp_replace(_col(c), f"^{ancestry}_([^_]+)_.*", "$1")
