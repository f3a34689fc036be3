"""Readers and writers, each as a round trip through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelio import schemas
from allelio.catalog.fixtures import Fixtures
from allelio.catalog.registry import query
from allelio.config import ANCESTRIES, CONSEQUENCE_COLS, VARIANT_KEY
from allelio.functions.keys import variant_id
from allelio.operators import frequency
from allelio.operators.intervals import filter_intervals, subset_genotypes
from allelio.operators.joins import lookup_join, stack, staged
from allelio.plans.pipelines import categorised_consequences
from allelio.session import SHUFFLES_GO, held
from allelio.sources import headers, readers, writers

DATASET = "CASE site_id % 3 WHEN 0 THEN 'acaf' WHEN 1 THEN 'exome' ELSE 'clinvar' END"
SOURCE = "CASE site_id % 2 WHEN 0 THEN 'exome' ELSE 'wgs' END"
VID = "concat(contig, ':', pos, ':', ref, ':', alt)"


def _stored_sites(fx: Fixtures) -> str:
    base = fx.scratch("sites")
    writers.save_stage(
        fx.view("g_site").select("contig", "pos", "ref", "alt", "gene", "effect"), base, "sites", sort_by=VARIANT_KEY
    )
    return f"{base}/sites"


@query("scan_sites", ["g_site"], "SELECT contig, pos, ref, alt, gene, effect FROM g_site")
def scan_sites(fx):
    return readers.read_sites(fx.spark, _stored_sites(fx))


@query(
    "scan_sites_in_regions",
    ["g_site", "g_region"],
    """SELECT contig, pos, ref, alt, gene, effect FROM g_site s WHERE EXISTS (
 SELECT 1 FROM g_region r WHERE r.contig = s.contig AND s.pos >= r.start_pos AND s.pos < r.end_pos)""",
)
def scan_sites_in_regions(fx):
    path, regions = fx.scratch("sites"), fx.view("g_region")
    writers.write_by_position(fx.view("g_site").select("contig", "pos", "ref", "alt", "gene", "effect"), path)
    return filter_intervals(readers.read_sites(fx.spark, path, regions=regions), regions)


@query(
    "scan_genotypes",
    ["g_site", "g_geno"],
    f"SELECT contig, pos, ref, alt, sample_id, alt_dosage, {DATASET} AS dataset FROM g_geno JOIN g_site USING (site_id)",
)
def scan_genotypes(fx):
    path = fx.scratch("genotypes")
    calls = fx.view("g_geno").join(fx.view("g_site"), "site_id")
    calls = calls.select(*VARIANT_KEY, "sample_id", "alt_dosage", F.expr(DATASET).alias("dataset"))
    writers.write_by_position(calls, path, by=("dataset",))
    return readers.read_genotypes(fx.spark, path, datasets=["acaf", "exome", "clinvar"])


@query(
    "scan_vcf",
    ["g_vcf"],
    """SELECT contig, pos, id, ref, string_split(alts, ',')[1] AS alt_first, length(alts) - length(replace(alts, ',', '')) + 1 AS n_alts,
 filter, info, CAST(NULL AS VARCHAR) AS qual FROM g_vcf""",
)
def scan_vcf(fx):
    path = fx.scratch("vcf")
    writers.write_vcf(fx.view("g_vcf").withColumn("alts", F.split("alts", ",")), path)
    rows = readers.read_vcf(fx.spark, path)
    return rows.select(
        "contig", "pos", "id", "ref", F.get("alts", F.lit(0)).alias("alt_first"),
        F.size("alts").cast("bigint").alias("n_alts"), "filter", "info", "qual",
    )


@query(
    "scan_tsv",
    ["g_site", "g_revel"],
    """SELECT concat(contig, ':', pos) AS locus, ref, alt, revel_score, CASE WHEN revel_scalar = '.' THEN NULL ELSE revel_scalar END AS revel_scalar
FROM g_revel JOIN g_site USING (site_id)""",
)
def scan_tsv(fx):
    path = fx.scratch("revel")
    rows = fx.view("g_revel").join(fx.view("g_site"), "site_id")
    # Blanks, "#" and ":" in header names, and one column the reader does not ask for.
    writers.write_tsv(
        rows.select(
            "intervar", F.concat_ws(":", "contig", "pos").alias("#locus"), F.col("ref").alias("Ref: base"),
            F.col("alt").alias("Alt base"), "revel_score", "revel_scalar",
        ),
        path,
    )
    columns = {
        "#locus": ("locus", "string"),
        "Ref: base": ("ref", "string"),
        "Alt base": ("alt", "string"),
        "revel_score": ("revel_score", "string"),
        "revel_scalar": ("revel_scalar", "string"),
    }
    return readers.read_tsv(fx.spark, path, columns)


def _frequency_files(fx: Fixtures) -> str:
    path = fx.scratch("afreq")
    af = frequency.allele_freq(fx.view("g_geno"), fx.view("g_sample"), ["site_id"])
    named = af.join(fx.view("g_site"), "site_id").select(
        variant_id().alias("ID"),
        F.col("alt_freq").alias("ALT_FREQS"),
        "obs_ct",
        F.concat_ws("_", "ancestry", "gene", F.lit("2.afreq")).alias("file"),
    )
    writers.write_tsv(named, path, compression="none", by=("file",))
    return path


@query(
    "scan_files_glob",
    ["g_af", "g_site"],
    f"SELECT ancestry, {VID} AS variant_id, CAST(alt_ct AS DOUBLE) / obs_ct AS alt_freq FROM g_af JOIN g_site USING (site_id)",
)
def scan_files_glob(fx):
    path = _frequency_files(fx)
    parts = [
        readers.read_glob(fx.spark, path, f"file={a}_*.afreq", schemas.AFREQ_TSV).withColumn("ancestry", F.lit(a))
        for a in ANCESTRIES
    ]
    return stack(parts).select("ancestry", "variant_id", "alt_freq")


@query(
    "file_provenance",
    ["g_af", "g_site"],
    f"SELECT ancestry, gene, {VID} AS variant_id, CAST(alt_ct AS DOUBLE) / obs_ct AS alt_freq FROM g_af JOIN g_site USING (site_id)",
)
def file_provenance(fx):
    files = readers.read_glob(fx.spark, _frequency_files(fx), "file=*.afreq", schemas.AFREQ_TSV)
    return readers.with_provenance(files, {"ancestry": "file=([a-z]+)_", "gene": "file=[a-z]+_([^_]+)_"})


@query("scan_region_panel", ["g_region"], "SELECT gene, contig, start_pos, end_pos FROM g_region")
def scan_region_panel(fx):
    path = fx.scratch("regions")
    writers.write_regions(fx.view("g_region"), path)
    return readers.read_regions(fx.spark, path)


@query(
    "scan_raw_dosage",
    ["g_geno", "g_site", "g_gene"],
    """SELECT CAST(sample_id AS VARCHAR) AS sample_id, g.gene AS variant, d.dosage
FROM (SELECT DISTINCT sample_id FROM g_geno) s JOIN g_gene g ON true
LEFT JOIN (SELECT sample_id, gene, CAST(sum(alt_dosage) AS INTEGER) AS dosage FROM g_geno JOIN g_site USING (site_id) GROUP BY sample_id, gene) d
 USING (sample_id, gene)""",
)
def scan_raw_dosage(fx):
    path = fx.scratch("raw")
    genes = [r["gene"] for r in fx.view("g_gene").collect()]  # the 25 column names of the wide file
    wide = fx.view("g_geno").join(fx.view("g_site"), "site_id").groupBy("sample_id").pivot("gene", genes)
    ids = [F.lit("0").alias("FID"), F.col("sample_id").alias("IID"), *[F.lit("0").alias(c) for c in ("PAT", "MAT", "SEX", "PHENOTYPE")]]
    wide.agg(F.sum("alt_dosage")).select(*ids, *genes).write.csv(path, sep="\t", header=True, nullValue="NA")
    return readers.read_raw(fx.spark, path)


@query("load_checkpoint", ["g_popmax"], "SELECT site_id, max_value FROM g_popmax")
def load_checkpoint(fx):
    base = fx.scratch("stages")
    af = frequency.allele_freq(fx.view("g_geno"), fx.view("g_sample"), ["site_id"])
    writers.save_stage(frequency.popmax(frequency.nonzero_af(af), ["site_id"]), base, "popmax")
    return readers.load_stage(fx.spark, base, "popmax")


@query("save_checkpoint", ["g_sample"], "SELECT sample_id, ancestry FROM g_sample")
def save_checkpoint(fx):
    return writers.save_stage(fx.view("g_sample"), fx.scratch("stages"), "samples")


@query(
    "write_sites_vcf",
    ["g_site"],
    f"SELECT gene, {SOURCE} AS source, contig, pos, ref, alt FROM g_site",
)
def write_sites_vcf(fx):
    path = fx.scratch("sites-vcf")
    writers.write_vcf(fx.view("g_site").withColumn("source", F.expr(SOURCE)), path, rows_per_file=500)
    return readers.read_vcf(fx.spark, path).select("gene", "source", "contig", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"))


HEADER = [
    "##fileformat=VCFv4.2",
    '##FILTER=<ID=LowQual,Description="Low quality, of any kind">',
    '##INFO=<ID=AC,Number=A,Type=Integer,Description="">',
    '##INFO=<ID=ANN,Description="Annotation: a | b, c",Number=.,Type=String>',
    "##contig=<ID=chr1,length=248956422>",
    "##source=a tool, with <brackets>",
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",
]


@query(
    "vcf_header_round_trip",
    ["g_vcf"],
    """SELECT g.gene, h.kind, h.id, h.number, h.description, h.line FROM (SELECT DISTINCT gene FROM g_vcf) g, (VALUES
 ('fileformat', NULL, NULL, NULL, '##fileformat=VCFv4.2'),
 ('FILTER', 'LowQual', NULL, 'Low quality, of any kind', '##FILTER=<ID=LowQual,Description="Low quality, of any kind">'),
 ('INFO', 'AC', '.', 'Description not provided', '##INFO=<ID=AC,Number=.,Type=String,Description="Description not provided">'),
 ('INFO', 'ANN', '.', 'Annotation: a | b, c', '##INFO=<ID=ANN,Description="Annotation: a | b, c",Number=.,Type=String>'),
 ('contig', 'chr1', NULL, NULL, '##contig=<ID=chr1,length=248956422>'),
 ('source', NULL, NULL, NULL, '##source=a tool, with <brackets>')) AS h(kind, id, number, description, line)""",
)
def vcf_header_round_trip(fx):
    # Files with a faulty header; read, merged over files, repaired, and written again with the same rows.
    faulty, mended = fx.scratch("faulty"), fx.scratch("mended")
    rows = fx.view("g_vcf").withColumn("alts", F.split("alts", ","))
    writers.write_vcf(rows, faulty, by=("gene",), header=HEADER)
    lines = headers.header_lines(headers.merge_headers(headers.read_header(fx.spark, faulty)))
    writers.write_vcf(readers.read_vcf(fx.spark, faulty), mended, by=("gene",), header=lines)
    found = headers.read_header(fx.spark, mended).withColumn("gene", F.regexp_extract("path", "gene=([^/]+)", 1))
    values = [headers.header_value("keys", k).alias(k.lower()) for k in ("Number", "Description")]
    return found.select("gene", "kind", "id", *values, "line").distinct()


@query(
    "scan_plink_bed",
    ["g_site", "g_geno"],
    f"""SELECT {DATASET} AS dataset, gene, contig, pos, ref, alt, {VID} AS variant_id, CAST(sample_id AS VARCHAR) AS sample_id, alt_dosage
FROM g_geno JOIN g_site USING (site_id)""",
)
def scan_plink_bed(fx):
    base = fx.scratch("plink")
    calls = fx.view("g_geno").join(fx.view("g_site"), "site_id").select(F.expr(DATASET).alias("dataset"), "gene", *VARIANT_KEY, "sample_id", "alt_dosage")
    write_plink_sets(calls, base)
    stored = readers.read_plink(fx.spark, f"{base}/*/*", with_path=True)
    return readers.with_provenance(stored, {"dataset": "([^/]+)/[^/]+$", "gene": r"([^/]+)\.\d+$"})


# A .bed file has a cell for every variant and every sample of its set: sets of so many calls keep both few, however many calls there are.
CALLS_PER_SET = 8192


def write_plink_sets(calls, base: str) -> None:
    """Stand-in input: file sets ``<dataset>/<gene>.<part>``, each with some variants and the samples that have a call in it.

    A variant is in one part. A gene of few calls has one.
    """
    import pyarrow as pa

    def write(key, table: pa.Table) -> pa.Table:
        import numpy as np
        from pyarrow import fs

        if table["sample_id"].null_count:
            raise ValueError("a call without sample")
        cols = [table[c].combine_chunks().dictionary_encode() for c in VARIANT_KEY]
        places, of = np.unique(np.stack([c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in cols], 1), axis=0, return_inverse=True)
        names = [tuple(None if i < 0 else c.dictionary[int(i)].as_py() for c, i in zip(cols, row)) for row in places]
        order = sorted(range(len(names)), key=names.__getitem__)
        line = np.empty(len(names), np.int64)
        line[order] = np.arange(len(names))
        people, column = np.unique(table["sample_id"].to_numpy(), return_inverse=True)
        code = np.array([2, 0, 1], np.uint8)[table["alt_dosage"].combine_chunks().fill_null(3).to_numpy(zero_copy_only=False) - 1]
        codes = np.full((len(names), (len(people) + 3) // 4 * 4), 3, np.uint8)
        codes[:, len(people) :] = 0
        codes[line[of.reshape(-1)], column.reshape(-1)] = code
        quads = codes.reshape(len(names), -1, 4)
        bits = (quads[:, :, 0] | quads[:, :, 1] << 2 | quads[:, :, 2] << 4 | quads[:, :, 3] << 6).astype(np.uint8)
        texts = {
            "bed": b"\x6c\x1b\x01" + bits.tobytes(),
            "bim": "".join(f"{c}\t{c}:{p}:{r}:{a}\t0\t{p}\t{a}\t{r}\n" for c, p, r, a in (names[i] for i in order)).encode(),
            "fam": "".join(f"0 {p} 0 0 0 -9\n" for p in people).encode(),
        }
        system, root = fs.FileSystem.from_uri(readers._uri(base))
        dataset, gene, part = (k.as_py() for k in key)
        system.create_dir(f"{root}/{dataset}")
        for ending, data in texts.items():
            with system.open_output_stream(f"{root}/{dataset}/{gene}.{part}.{ending}") as out:
                out.write(data)
        return pa.table({"n": [table.num_rows]})

    write.__annotations__ = {"key": tuple[pa.Scalar, ...], "table": pa.Table, "return": pa.Table}
    calls, _ = staged(calls.withColumn("gene", F.coalesce("gene", F.lit("None"))), "plink-calls")  # counted, then written
    sizes, size = staged(calls.groupBy("dataset", "gene").agg(F.ceil(F.count(F.lit(1)) / F.lit(CALLS_PER_SET)).alias("_parts")), "plink-sets")
    part = F.pmod(F.xxhash64(*VARIANT_KEY), F.col("_parts")).alias("part")
    parted = lookup_join(calls, sizes, ["dataset", "gene"], size=size).select(*calls.columns, part)
    parted.groupBy("dataset", "gene", "part").applyInArrow(write, "n long").agg(F.sum("n")).collect()


@query(
    "write_flat_tsv",
    ["g_gnomad"],
    """SELECT locus, alleles, joint_grpmax_af AS "joint_grpmax_AF" FROM g_gnomad""",
)
def write_flat_tsv(fx):
    path = fx.scratch("public")
    writers.write_tsv(fx.view("g_gnomad").withColumnRenamed("joint_grpmax_af", "joint_grpmax_AF"), path)
    return readers.read_tsv(fx.spark, path, schemas.PUBLIC_TSV)


CONSEQUENCE_SQL = """
SELECT source, contig, pos, id, ref, a.alt, a.entry, a.effect, gene, a.feature, a.hgvs_c, a.hgvs_p, geneinfo, clnsig, clnrevstat FROM (
 SELECT v.*, s.alt AS alt1, s.effect AS effect1 FROM g_vcf v JOIN g_site s USING (site_id)) x,
 LATERAL (VALUES
  (alt1, 1, effect1, concat('NM_', site_id), concat('c.', pos, ref, '>', alt1), concat('p.', site_id)),
  (alt1, 2, 'intron_variant', concat('NM_', site_id + 1), concat('c.', pos, '+5'), CAST(NULL AS VARCHAR)),
  (CASE WHEN site_id % 3 = 0 THEN concat(ref, 'T') END, 3, 'frameshift_variant', concat('NM_', site_id), concat('c.', pos, 'dup'), 'p.fs')
 ) AS a(alt, entry, effect, feature, hgvs_c, hgvs_p) WHERE a.alt IS NOT NULL"""

CATEGORY_SQL = f"""
SELECT c.category, source, contig AS "CHROM", pos AS "POS", id AS "ID", ref AS "REF", alt AS "ALT", alt AS "ALLELE", effect AS "EFFECT",
 gene AS "GENE", feature AS "FEATURE", hgvs_c AS "HGVS_C", hgvs_p AS "HGVS_P", geneinfo AS "GENEINFO", clnsig AS "CLNSIG", clnrevstat AS "CLNREVSTAT"
FROM ({CONSEQUENCE_SQL}) t JOIN (VALUES ('clinvar'), ('lof'), ('missense')) AS c(category) ON
 (c.category = 'clinvar' AND regexp_matches(clnsig, 'Pathogenic|Likely_pathogenic'))
 OR (c.category = 'lof' AND (effect LIKE '%stop_gained%' OR effect LIKE '%frameshift%' OR effect LIKE '%start_lost%' OR effect LIKE '%splice%'))
 OR (c.category = 'missense' AND effect LIKE '%missense%')"""


@query("write_categorised", ["g_vcf", "g_site"], CATEGORY_SQL)
def write_categorised(fx):
    path = fx.scratch("categories")
    rows = categorised_consequences(fx.view("g_vcf"))
    writers.write_categories(rows.withColumn("gene", F.col("GENE")), path)
    columns = {**schemas.CONSEQUENCE_TSV, "category": ("category", "string"), "source": ("source", "string")}
    columns["gene"] = ("GENE", "string")
    del columns["GENE"]
    return readers.read_tsv(fx.spark, path, columns).select("category", "source", *CONSEQUENCE_COLS)


@query(
    "write_sample_lists",
    ["g_sample"],
    'SELECT ancestry, 0 AS "FID", sample_id AS "IID" FROM g_sample',
)
def write_sample_lists(fx):
    path = fx.scratch("samples")
    writers.write_samples(fx.view("g_sample"), path)
    return fx.spark.read.schema("FID int, IID bigint, ancestry string").csv(path, sep="\t")


@query(
    "write_genotype_subset",
    ["g_geno", "g_site", "g_region"],
    f"""SELECT DISTINCT {DATASET} AS dataset, r.gene, contig, pos, site_id, sample_id, alt_dosage FROM g_geno JOIN g_site s USING (site_id)
JOIN g_region r USING (contig) WHERE pos BETWEEN start_pos AND end_pos""",
)
def write_genotype_subset(fx):
    path = fx.scratch("subset")
    sites = fx.view("g_site").select("site_id", "contig", "pos")
    regions = fx.view("g_region").select("gene", "contig", "start_pos", "end_pos")
    with held(fx.spark, SHUFFLES_GO):
        calls = subset_genotypes(fx.view("g_geno"), sites, regions, ["site_id"], listed=True, carried=("contig", "pos"))
    rows = calls.select(F.expr(DATASET).alias("dataset"), "gene", "contig", "pos", "site_id", "sample_id", "alt_dosage")
    writers.write_genotypes(rows, path)
    return fx.spark.read.parquet(path)
