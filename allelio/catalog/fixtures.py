"""Variant tables derived from the star-schema test tables, one SQL text per view that both engines run."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from allelio.config import TIER_GENES
from allelio.session import scratch_path

# Line items that one task groups into calls, so that tasks grow in number and not in memory; so few parts need no dealing out.
LINES_PER_TASK, FEW_PARTS = 500_000, 8

# Columns in use of each test table.
BASE = {
    "customer": "c_custkey bigint, c_nationkey int",
    "supplier": "s_suppkey bigint",
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double, l_tax double",
    "documents": "doc_id bigint, text string",
}

# name -> (views it needs, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "g_gene": (
        (),
        """
SELECT * FROM (VALUES (1,'TTN'),(2,'MYH7'),(3,'LMNA'),(4,'FLNC'),(5,'DSP'),(6,'DES'),(7,'TNNT2'),(8,'SCN5A'),(9,'ACTC1'),
 (10,'PLN'),(11,'TNNC1'),(12,'BAG3'),(13,'TNNI3'),(14,'TPM1'),(15,'MYBPC3'),(16,'MYL2'),(17,'MYL3'),(18,'DSC2'),(19,'DSG2'),
 (20,'PKP2'),(21,'TMEM43'),(22,'JUP'),(23,'RBM20'),(24,'ACTN2'),(25,'OBSCN')) AS g(k, gene)""",
    ),
    "g_site": (
        ("g_gene",),
        """
SELECT p_partkey AS site_id, concat('chr', 1 + p_partkey % 22) AS contig, 10000 + (p_partkey * 7919) % 100000 AS pos,
 substr('ACGT', 1 + p_size % 4, 1) AS ref, substr('ACGT', CAST(1 + (p_size + 1 + p_partkey % 3) % 4 AS INT), 1) AS alt, g.gene,
 CASE p_type WHEN 'ECONOMY' THEN 'stop_gained' WHEN 'LARGE' THEN 'frameshift_variant'
  WHEN 'MEDIUM' THEN 'missense_variant&splice_region_variant' WHEN 'PROMO' THEN 'missense_variant'
  WHEN 'SMALL' THEN 'synonymous_variant' ELSE 'splice_donor_variant&intron_variant' END AS effect,
 CASE p_size % 7 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely_pathogenic' WHEN 2 THEN 'Pathogenic/Likely_pathogenic'
  WHEN 3 THEN 'Benign' WHEN 4 THEN 'Uncertain_significance' WHEN 5 THEN 'Conflicting_classifications_of_pathogenicity' END AS clnsig,
 CASE p_size % 3 WHEN 0 THEN 'criteria_provided,_multiple_submitters,_no_conflicts' WHEN 1 THEN 'reviewed_by_expert_panel'
  ELSE 'criteria_provided,_single_submitter' END AS clnrevstat,
 concat(g.gene, ':', 1000 + g.k, '|LOC', p_partkey % 9, ':', p_partkey % 97) AS geneinfo
FROM part JOIN g_gene g ON p_brand = concat('Brand#', g.k)""",
    ),
    "g_sample": (
        (),
        """
SELECT c_custkey AS sample_id, CASE c_nationkey % 6 WHEN 0 THEN 'eur' WHEN 1 THEN 'afr' WHEN 2 THEN 'amr' WHEN 3 THEN 'eas'
 WHEN 4 THEN 'sas' ELSE 'mid' END AS ancestry FROM customer""",
    ),
    # People with sex and parents; those with a listed parent are no founders.
    "g_person": (
        ("g_sample",),
        """
SELECT sample_id, ancestry, CASE sample_id % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS sex,
 CASE WHEN sample_id % 10 = 0 THEN concat('f', sample_id) ELSE '0' END AS father_id,
 CASE WHEN sample_id % 15 = 0 THEN concat('m', sample_id) ELSE '0' END AS mother_id FROM g_sample""",
    ),
    # Sites of which every fourth is on chromosome X, one in three of them in a pseudo-autosomal region.
    "g_xsite": (
        ("g_site",),
        """
SELECT site_id, CASE WHEN site_id % 4 = 0 THEN 'chrX' ELSE contig END AS contig,
 CASE WHEN site_id % 3 = 0 THEN pos ELSE pos + 3000000 END AS pos, ref, alt FROM g_site""",
    ),
    "g_geno": (
        (),
        """
SELECT o_custkey AS sample_id, l_partkey AS site_id,
 CASE WHEN max(l_tax) >= 0.08 THEN NULL WHEN max(l_quantity) >= 45 THEN 2 ELSE 1 END AS alt_dosage
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey""",
    ),
    "g_region": (
        ("g_gene",),
        """
SELECT g.gene, concat('chr', 1 + (s_suppkey * 5) % 22) AS contig, 10000 + (s_suppkey * 997) % 90000 AS start_pos,
 10000 + (s_suppkey * 997) % 90000 + 4000 AS end_pos FROM supplier JOIN g_gene g ON g.k = 1 + s_suppkey % 25""",
    ),
    "g_hipsi": (
        (),
        """
SELECT concat('chr', 1 + (s_suppkey * 3) % 22) AS contig, 10000 + (s_suppkey * 1013) % 90000 AS start_pos,
 10000 + (s_suppkey * 1013) % 90000 + 1500 AS end_pos FROM supplier""",
    ),
    "g_ann": (
        ("g_site",),
        """
SELECT site_id, contig, pos, ref, alt, concat('AC=', site_id % 5, ';ANN=', alt, '|', effect, '|HIGH|', gene, '|ENSG', site_id,
 '|transcript|NM_', site_id, '|protein_coding|1/2|c.', pos, ref, '>', alt, '|p.', site_id, ',', alt, '|intron_variant|MODIFIER|', gene,
 '|ENSG', site_id, '|transcript|NM_', site_id + 1, '|protein_coding|1/2|c.', pos, '+5|', ';GENEINFO=', geneinfo, ';CLNSIG=',
 coalesce(clnsig, '.')) AS info FROM g_site""",
    ),
    "g_multi": (
        ("g_site",),
        """
SELECT contig, pos, ref, concat(alt, ',', ref, 'T') AS alts, concat(1 + site_id % 4, ',', 2 + site_id % 3) AS ac, site_id
FROM g_site""",
    ),
    "g_revel": (
        ("g_site",),
        """
SELECT site_id, concat('[0.', site_id % 10, ',', CASE WHEN site_id % 4 = 0 THEN 'null' ELSE concat('0.', (site_id * 3) % 10) END,
 CASE WHEN site_id % 5 = 0 THEN ',0.1,null,0.2,0.1,0.1,0.9' WHEN site_id % 5 = 1 THEN ',0.1' ELSE '' END, ']') AS revel_score,
 CASE WHEN site_id % 6 = 0 THEN '.' ELSE concat('0.', (site_id * 7) % 10) END AS revel_scalar,
 CASE site_id % 4 WHEN 0 THEN 'InterVar: Likely pathogenic PVS1=0' WHEN 1 THEN 'InterVar: Pathogenic PVS1=1'
  WHEN 2 THEN 'InterVar: Benign' ELSE 'InterVar: Uncertain significance' END AS intervar FROM g_site""",
    ),
    "g_gnomad": (
        ("g_site",),
        """
SELECT concat(contig, ':', pos) AS locus, concat('["', ref, '","', alt, '"]') AS alleles, site_id, site_id % 50 AS ac_all,
 1000 + site_id % 7 AS an_all, site_id % 11 AS ac_afr, 200 AS an_afr,
 CASE WHEN site_id % 9 = 0 THEN NULL ELSE CAST(site_id % 40 AS DOUBLE) / 10000 END AS joint_grpmax_af FROM g_site""",
    ),
    # Variant rows as in a VCF: every third site has two ALT alleles, each ALT has its own annotation entries.
    "g_vcf": (
        ("g_site",),
        """
SELECT site_id, contig, pos, concat('rs', site_id) AS id, ref,
 CASE WHEN site_id % 3 = 0 THEN concat(alt, ',', ref, 'T') ELSE alt END AS alts,
 CASE WHEN site_id % 10 = 0 THEN 'LowQual' ELSE 'PASS' END AS filter,
 CASE WHEN site_id % 2 = 0 THEN 'exome' ELSE 'wgs' END AS source, gene, clnsig, clnrevstat, geneinfo,
 concat('AC=', site_id % 5, ';DB;ANN=', alt, '|', effect, '|HIGH|', gene, '|ENSG', site_id, '|transcript|NM_', site_id,
  '|protein_coding|1/2|c.', pos, ref, '>', alt, '|p.', site_id, ',', alt, '|intron_variant|MODIFIER|', gene, '|ENSG', site_id,
  '|transcript|NM_', site_id + 1, '|protein_coding|1/2|c.', pos, '+5|',
  CASE WHEN site_id % 3 = 0 THEN concat(',', ref, 'T|frameshift_variant|HIGH|', gene, '|ENSG', site_id, '|transcript|NM_', site_id,
   '|protein_coding|1/2|c.', pos, 'dup|p.fs') ELSE '' END,
  ';GENEINFO=', geneinfo, ';CLNSIG=', coalesce(clnsig, '.'), ';CLNREVSTAT=', clnrevstat) AS info
FROM g_site""",
    ),
    # Which disease sets a site belongs to; a site may be named more than once.
    "g_tier": (
        ("g_site",),
        """
SELECT site_id, gene, disease, CASE WHEN effect LIKE '%missense%' THEN 'missense' WHEN effect LIKE 'synonymous%' THEN 'lp_p' ELSE 'lof' END AS impact
FROM g_site JOIN (VALUES """
        + ", ".join(f"('{d}', '{g}')" for d, panel in TIER_GENES.items() for g in panel)
        + """) AS t(disease, panel_gene) ON gene = panel_gene""",
    ),
    # Frequencies of the cohort, counted in plain SQL.
    "g_af": (
        ("g_geno", "g_sample"),
        """
SELECT site_id, ancestry, CAST(coalesce(sum(alt_dosage), 0) AS BIGINT) AS alt_ct, 2 * max(n) - 2 * count(CASE WHEN alt_dosage IS NULL THEN 1 END) AS obs_ct
FROM g_geno JOIN g_sample USING (sample_id) JOIN (SELECT ancestry, count(*) AS n FROM g_sample GROUP BY ancestry) AS t USING (ancestry)
GROUP BY site_id, ancestry""",
    ),
    "g_popmax": (
        ("g_af",),
        """
SELECT site_id, max(CAST(alt_ct AS DOUBLE) / obs_ct) AS max_value FROM g_af WHERE alt_ct > 0 GROUP BY site_id""",
    ),
    # Genome: every document is a contig of its letters mapped onto the four bases.
    "g_genome": (
        (),
        """
SELECT concat('doc', doc_id) AS contig, regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz ', 'ACGTACGTACGTACGTACGTACGTACA'), '[^ACGT]', 'A'{g}) AS seq
FROM documents""",
    ),
}


def _order(names: tuple[str, ...] | list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for need in [*_order(VIEWS[n][0]), n]:
            if need not in out:
                out.append(need)
    return out


def _text(name: str, duckdb: bool) -> str:
    # DuckDB replaces only the first match unless told otherwise.
    return VIEWS[name][1].replace("{g}", ", 'g'" if duckdb else "")


def with_views(names: list[str], body: str, duckdb: bool = True, extra: str = "") -> str:
    """SQL text with the views it needs in front; ``extra`` holds further recursive terms."""
    if not names:
        return body
    terms = [f"{n} AS ({_text(n, duckdb)})" for n in _order(names)] + ([extra] if extra else [])
    return f"WITH {'RECURSIVE ' if extra else ''}{','.join(terms)}\n{body}"


@dataclass
class Fixtures:
    """Views over one folder of test tables."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(BASE[name]).parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name == "g_geno":
            return self._calls()
        return self._run(name)

    def _calls(self) -> DataFrame:
        """``g_geno``, its rows dealt out by the keys they are grouped by, in parts that follow the line items.

        Left to itself, Spark groups as many rows in a task as fit in 64 MB of compressed shuffle, some 3 million.
        """
        parts = math.ceil(self.table("lineitem").count() / LINES_PER_TASK)  # counted from file footers
        if parts <= FEW_PARTS:
            return self._run("g_geno")
        start, rest = _text("g_geno", False).split("FROM ")
        source, keys = rest.split(" GROUP BY ")
        named = {b: self.table(b) for b in ("lineitem", "orders")}
        rows = self.spark.sql("SELECT * FROM " + source.replace("lineitem", "{lineitem}").replace("orders ", "{orders} "), **named)
        dealt = rows.repartition(parts, *keys.split(", ")).select("o_custkey", "l_partkey", "l_quantity", "l_tax")
        return self.spark.sql(f"{start}FROM {{dealt}} GROUP BY {keys}", dealt=dealt)

    def _run(self, name: str) -> DataFrame:
        text = with_views([name], f"SELECT * FROM {name}", duckdb=False)
        used = [b for b in BASE if b in text]
        for b in used:
            text = _with_braces(text, b)
        return self.spark.sql(text, **{b: self.table(b) for b in used})

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)


def _with_braces(text: str, table: str) -> str:
    for word in ("FROM", "JOIN"):
        text = text.replace(f"{word} {table}", f"{word} {{{table}}}")
    return text
