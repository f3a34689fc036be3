"""Readers: every one returns a DataFrame with a fixed schema."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelio import schemas
from allelio.functions.fields import flip_dosage
from allelio.functions.keys import norm_contig, parse_interval
from allelio.operators.intervals import filter_intervals, merge_spans, place_of, prune_to_regions, stretches
from allelio.operators.joins import lookup_join
from allelio.sources import blocks

VCF_FIELDS = ["contig", "pos", "id", "ref", "alts", "qual", "filter", "info"]


def _positional(spark: SparkSession, path: str, schema: str, regions: DataFrame | None, place: bool) -> DataFrame:
    wanted = T.StructType.fromDDL(schema).names
    table = spark.read.schema(schema).parquet(path)
    if regions is not None:
        table = prune_to_regions(table, regions, either_style=True, scan=True)
    return table.select(*wanted, *[c for c in (place_of(table),) if place and c])


def read_sites(
    spark: SparkSession, path: str, schema: str = schemas.SITES, regions: DataFrame | None = None, place: bool = False
) -> DataFrame:
    """Variant sites from Parquet. A region list narrows the scan itself; exact filtering is ``filter_intervals``.

    ``place`` keeps the partition column of a table written by position, so that later steps can narrow the scan too.
    """
    return _positional(spark, path, schema, regions, place)


def read_genotypes(
    spark: SparkSession,
    path: str,
    schema: str = schemas.GENOTYPES,
    datasets: list[str] | None = None,
    regions: DataFrame | None = None,
    place: bool = False,
) -> DataFrame:
    """Long sparse calls from Parquet partitioned by ``dataset``; unwanted datasets are not opened. ``place`` as for sites."""
    calls = _positional(spark, path, schema, regions, place)
    return calls.filter(F.col("dataset").isin(datasets)) if datasets else calls


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines as ``value``, plain, ``.gz`` or ``.bgz``."""
    if path.endswith(".bgz"):
        return _block_lines(spark, path).select("value")
    return spark.read.text(path)


def _block_lines(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(blocks.BgzfText)
    return spark.read.format("bgzf_text").load(path)


def parse_vcf(lines: DataFrame) -> DataFrame:
    """Variant rows of VCF lines; genotype columns, if any, are left out. ``.`` is NULL."""
    cells = F.split("value", "\t", 9)
    extra = [c for c in lines.columns if c != "value"]
    fields = [F.nullif(F.get(cells, F.lit(i)), F.lit(".")).alias(name) for i, name in enumerate(VCF_FIELDS)]
    rows = lines.filter(~F.col("value").startswith("#") & (F.length("value") > 0)).select(*extra, *fields)
    return rows.withColumns({"pos": F.col("pos").try_cast("bigint"), "alts": F.split("alts", ",")})


def read_vcf(spark: SparkSession, path: str, regions: DataFrame | None = None) -> DataFrame:
    """VCF text to ``contig, pos, id, ref, alts[], qual, filter, info``, plus partition columns of the folder.

    ``regions`` (closed, contigs with or without ``chr``) keeps the rows whose position lies in one of them. Block-gzip files (``.bgz``, or ``.gz`` if
    they are written in blocks) with an index beside them are then read only where it says.
    """
    if regions is None:
        return parse_vcf(read_lines(spark, path))
    plain = norm_contig("contig")
    spans = regions.select(F.explode(F.array(plain, F.concat(F.lit("chr"), plain))).alias("contig"), "start_pos", "end_pos")
    lines = read_lines(spark, path)
    if path.endswith((".bgz", ".gz")):
        found = stretches(regions.select(plain.alias("contig"), "start_pos", "end_pos"))
        if found or regions.isEmpty():  # else on too many contigs to name them
            spark.dataSource.register(blocks.BgzfText)
            lines = spark.read.format("bgzf_text").option("regions", json.dumps(found)).load(path).select("value")
    return filter_intervals(parse_vcf(lines), spans, closed=True)


def read_vcf_header(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).filter(F.col("value").startswith("##"))


def _named(raw: DataFrame, columns: dict[str, tuple[str, str]], extra: list) -> DataFrame:
    return raw.select(*[F.col(f"`{h}`").try_cast(t).alias(c) for h, (c, t) in columns.items()], *extra)


#: Different headers that the files of one table may have.
MAX_HEADERS = 64


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """``path, header``: the first line of every file that ``path`` names; empty files have none."""
    if path.endswith(".bgz"):

        def first(batches):
            import pyarrow as pa

            for batch in batches:
                names = batch.column("path").to_pylist()
                yield pa.RecordBatch.from_pydict({"path": names, "header": [blocks.first_line(n) for n in names]})

        files = spark.createDataFrame([(f,) for f, _ in blocks.list_files(path)], "path string")
        return files.repartition(spark.sparkContext.defaultParallelism).mapInArrow(first, "path string, header string").filter("header <> ''")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    # Rows of a file's first block come in order.
    tops = lines.filter("start = 0").withColumn("at", F.monotonically_increasing_id())
    return tops.groupBy("path").agg(F.min_by("value", "at").alias("header"))


def _header_places(header: str, columns: list[str], path: str) -> dict[str, int]:
    names = header.split("\t")
    lost = [h for h in columns if h not in names]
    if lost:
        raise ValueError(f"no column {lost[0]!r} in {path}")
    return {h: names.index(h) for h in columns}


def read_tsv(
    spark: SparkSession, path: str, columns: dict[str, tuple[str, str]], null_value: str = ".", with_path: bool = False
) -> DataFrame:
    """Tab-separated text with a header, columns taken by header name; text that is no number becomes NULL.

    ``columns`` maps a header name to (column, type). Names with blanks, ``#`` or ``:`` are fine. Each file is read by its own
    header, so files may name their columns in any order and have others beside them; a file that lacks one of ``columns`` is refused, as are
    more than ``MAX_HEADERS`` different headers. Only a file's first line is its header, wherever else the same line stands.
    Plain, ``.gz`` and ``.bgz`` files; ``columns`` may also name the partition columns of a folder of the first two kinds.
    """
    folders = set() if path.endswith(".bgz") else set(spark.read.text(path).columns) - {"value"}
    inside = [h for h in columns if h not in folders]
    grouped = file_headers(spark, path).groupBy("header").agg(F.min("path").alias("example"), F.count(F.lit(1)).alias("files"))
    kinds = grouped.orderBy("header").limit(MAX_HEADERS + 1).collect()
    if len(kinds) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers in {path}")
    places = {r["header"]: _header_places(r["header"], inside, r["example"]) for r in kinds}
    if path.endswith(".bgz"):
        known = spark.createDataFrame([(h, *p.values()) for h, p in places.items()], T.StructType.fromDDL(", ".join(["header string", *[f"p{i} int" for i in range(len(columns))]])))
        known = lookup_join(file_headers(spark, path), known, "header").drop("header")
        rows = lookup_join(_block_lines(spark, path).filter("NOT first AND value <> ''"), known, "path", "left")
        cells = F.split("value", "\t")
        raw = rows.select("path", *[F.nullif(F.nullif(F.get(cells, F.col(f"p{i}")), F.lit(null_value)), F.lit("")).alias(h) for i, h in enumerate(columns)])
        return _named(raw, columns, ["path"] if with_path else [])

    def read(paths: str | list[str]) -> DataFrame:
        base = {"basePath": path} if folders and paths is not path else {}
        raw = spark.read.options(**base).csv(paths, sep="\t", header=True, enforceSchema=False, quote="", nullValue=null_value, emptyValue="")
        return _named(raw, columns, [F.col("_metadata.file_path").alias("path")] if with_path else [])

    if len(kinds) <= 1:
        return read(path)
    files: dict[str, list[str]] = {}
    for r in file_headers(spark, path).collect():
        files.setdefault(r["header"], []).append(r["path"])
    parts = [read(files[h]) for h in sorted(files)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_glob(spark: SparkSession, folder: str, pattern: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """All files below ``folder`` matching a name pattern as one table, with their ``path``."""
    return read_tsv(spark, f"{folder.rstrip('/')}/{pattern}", columns, with_path=True)


def with_provenance(df: DataFrame, patterns: dict[str, str], path: str = "path") -> DataFrame:
    """Columns taken from the source path by regular expression (first group); NULL where it does not match."""
    taken = {name: F.nullif(F.regexp_extract(path, regex, 1), F.lit("")) for name, regex in patterns.items()}
    return df.withColumns(taken).drop(path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Region list without header: contig, gene, ``start-end``."""
    rows = spark.read.schema(schemas.REGIONS).csv(path, sep="\t")
    span = parse_interval("region")
    return rows.select("gene", F.col("chrom").alias("contig"), span["start_pos"].alias("start_pos"), span["end_pos"].alias("end_pos"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Wide dosage table (six id columns, one column per variant) to ``sample_id, variant, dosage``.

    Lines are cut into cells, so a table may have any number of columns; the header's names meet them by place. All files
    of ``path`` must have the header of the first; a line of other length is refused.
    """
    lines = spark.read.text(path)
    top = lines.first()
    if top is None:
        return spark.createDataFrame([], "sample_id string, variant string, dosage int")
    names = top["value"].split("\t")
    schema = "place int, variant string"
    header = spark.createDataFrame([(i, n) for i, n in enumerate(names[6:])], schema)
    cells = F.split("value", "\t")
    rows = lines.filter((F.col("value") != top["value"]) & (F.col("value") != "")).select(
        F.when(F.size(cells) == len(names), cells).otherwise(F.raise_error(F.lit(f"a line has not {len(names)} cells"))).alias("cells")
    )
    long = rows.select(
        F.get("cells", F.lit(names.index("IID"))).alias("sample_id"),
        F.posexplode(F.slice("cells", 7, max(0, len(names) - 6))).alias("place", "dosage"),
    )
    return lookup_join(long, header, "place").select("sample_id", "variant", F.col("dosage").try_cast("int").alias("dosage"))


def dosage_calls(raw: DataFrame) -> DataFrame:
    """``read_raw``'s rows as calls: ``contig, pos, ref, alt, sample_id, alt_dosage``.

    A column ``1:100:A:G_G`` counts the allele behind the last ``_``; counts of REF are turned into counts of ALT. A dosage of
    0 has no row, as in every call table, and a missing one is NULL. Columns that name no variant are refused.
    """
    parts = F.split(F.regexp_replace("variant", "_[^_]*$", ""), ":")
    counted = F.regexp_extract("variant", "_([^_]*)$", 1)
    rows = raw.select(
        F.get(parts, F.lit(0)).alias("contig"),
        F.get(parts, F.lit(1)).try_cast("bigint").alias("pos"),
        F.get(parts, F.lit(2)).alias("ref"),
        F.get(parts, F.lit(3)).alias("alt"),
        "sample_id",
        "dosage",
        counted.alias("_counted"),
        "variant",
    )
    wrong = F.raise_error(F.concat(F.lit("not a counted variant: "), F.col("variant")))
    alt = F.when(F.col("_counted") == F.col("alt"), F.col("dosage")).when(F.col("_counted") == F.col("ref"), flip_dosage("dosage")).otherwise(wrong)
    return rows.withColumn("alt_dosage", alt.cast("int")).filter("alt_dosage IS NULL OR alt_dosage > 0").drop("dosage", "_counted", "variant")


def load_stage(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Named intermediate written by ``save_stage``."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}")


# --- PLINK ------------------------------------------------------------------


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one file with their 0-based number, counted per file split (one row per split is all that is moved)."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
    )
    blocks = lines.groupBy("block").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return lines.join(F.broadcast(offsets), "block").select(
        "value", (F.col("mid") - F.col("first") + F.col("offset")).alias("line")
    )


def _columns(lines: DataFrame, schema: str) -> DataFrame:
    cells = F.split(F.trim("value"), r"\s+")
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    return lines.select("line", *[F.get(cells, F.lit(i)).try_cast(t).alias(c) for i, (c, t) in enumerate(fields)])


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a ``.fam`` file in file order (``line``)."""
    rows = _columns(_numbered_lines(spark, path), schemas.FAM)
    sex = F.when(F.col("sex_code") == 1, "male").when(F.col("sex_code") == 2, "female")
    return rows.select("line", "family_id", "sample_id", "father_id", "mother_id", sex.alias("sex"))


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a ``.bim`` file in file order; allele 1 is ALT."""
    rows = _columns(_numbered_lines(spark, path), schemas.BIM)
    code = norm_contig("chrom")
    contig = F.when(code == "23", "X").when(code == "24", "Y").when(code == "25", "X").when(code == "26", "M").otherwise(code)
    return rows.select(
        "line", norm_contig(contig, "chr").alias("contig"), "pos", F.col("a2").alias("ref"), F.col("a1").alias("alt"), "variant_id"
    )


def _uri(path: str) -> str:
    return f"file:///{path[6:]}" if path.startswith("file:/") and not path.startswith("file:///") else path


SPLIT_BYTES = 16 << 20


def plink_files(spark: SparkSession, prefix: str) -> dict[str, int]:
    """Bytes of the ``.bim`` file of every file set whose name without ending matches ``prefix`` (a pattern in any part of the path)."""

    def listed(ending: str) -> dict[str, int]:
        try:
            files = spark.read.format("binaryFile").load(f"{prefix}.{ending}").select("path", "length").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            files = []
        return {_uri(r["path"]).removesuffix(f".{ending}"): r["length"] for r in files}

    found = {e: listed(e) for e in ("bed", "bim", "fam")}
    lacking = set(found["bed"]) ^ set(found["bim"]) | set(found["bed"]) ^ set(found["fam"])
    if lacking or not found["bed"]:
        raise ValueError(f"not all of .bed, .bim and .fam are there for {min(lacking, default=prefix)}")
    return found["bim"]


def plink_index(spark: SparkSession, files: dict[str, int], range_bytes: int) -> DataFrame:
    """Line index of all ``.bim`` files: ``stem, start, end, n_lines, spans`` per byte range, ``n_samples`` and ``bed_bytes`` with a file's first range.

    ``spans`` are the contigs of a range with their first and last position.
    """
    ranges = [(stem, at, min(at + range_bytes, size)) for stem, size in sorted(files.items()) for at in range(0, max(size, 1), range_bytes)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for stem, start, end in zip(*[batch.column(c).to_pylist() for c in ("stem", "start", "end")]):
                lines = blocks.lines_between(f"{stem}.bim", start, end)
                spans: dict[str, list[int]] = {}
                if lines:
                    sites = blocks.plink_sites(lines)
                    for contig in set(sites["contig"]):
                        at = sites["pos"][sites["contig"] == contig]
                        spans[contig] = [int(at.min()), int(at.max())]
                n = bed = None
                if start == 0:
                    n = len(blocks.lines_between(f"{stem}.fam", 0, 1 << 62))
                    bed = blocks.bed_size(f"{stem}.bed")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([stem]), pa.array([start]), pa.array([end]), pa.array([len(lines)]), pa.array([n], pa.int64()), pa.array([bed], pa.int64()),
                     pa.array([[(c, *s) for c, s in spans.items()]], pa.list_(pa.struct([("contig", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))],
                    names=["stem", "start", "end", "n_lines", "n_samples", "bed_bytes", "spans"],
                )

    schema = "stem string, start long, end long, n_lines long, n_samples long, bed_bytes long, spans array<struct<contig:string,first:long,last:long>>"
    listed = spark.createDataFrame(ranges, "stem string, start long, end long")
    return listed.repartition(min(len(ranges), 8 * spark.sparkContext.defaultParallelism)).mapInArrow(run, schema)


def read_plink(
    spark: SparkSession, prefix: str, split_bytes: int | None = None, regions: DataFrame | None = None, with_path: bool = False, range_bytes: int = 256 << 10
) -> DataFrame:
    """PLINK bed/bim/fam to long sparse calls; homozygous reference calls have no row, a missing call is NULL.

    ``prefix`` may be a pattern for many file sets, also in folder names; ``with_path`` adds the set's path without ending, from which
    ``with_provenance`` takes dataset and gene. Each task reads a stretch of a ``.bim`` file, found by an index of lines per
    byte range, and the bytes of the ``.bed`` file that belong to it, so calls get their variant and sample where they are decoded: nothing
    is joined. ``regions`` (closed) leaves out ranges that hold none of them, and other variants before they are decoded.
    A ``.bed`` file whose size does not fit its ``.bim`` and ``.fam`` is refused. A task holds a file set's sample ids.
    """
    wanted: dict[str, list[tuple[int, int]]] | None = None
    if regions is not None:
        wanted = {}
        spans = regions.select(norm_contig("contig", "chr").alias("contig"), "start_pos", "end_pos")
        found = merge_spans(stretches(spans))
        for c, s, e in found:
            wanted.setdefault(c, []).append((s, e))
        if not found and not regions.isEmpty():  # on too many contigs to name them
            wanted = None
    schema = "contig string, pos long, ref string, alt string, variant_id string, sample_id string, alt_dosage int, path string"
    # One row per range: as many as there are file splits.
    index = sorted(plink_index(spark, plink_files(spark, prefix), range_bytes).collect(), key=lambda r: (r["stem"], r["start"]))
    tasks, first, n, left = [], 0, 0, {}
    for r in index:
        if r["start"] == 0:
            first, n = 0, r["n_samples"]
            left[r["stem"]] = r["bed_bytes"]
        stride = (n + 3) // 4
        step = max(1, (split_bytes or SPLIT_BYTES) // max(stride, 1))
        if wanted is None or any(s <= x["last"] and x["first"] <= e for x in r["spans"] for s, e in wanted.get(x["contig"], [])):
            cuts = [(at, min(at + step, r["n_lines"])) for at in range(0, r["n_lines"], step)]
            tasks += [((b - a) * stride, (r["stem"], r["start"], r["end"], first, a, b)) for a, b in cuts]
        first += r["n_lines"]
        left[r["stem"]] -= r["n_lines"] * stride
    for stem, rest in left.items():
        if rest:
            raise ValueError(f"size of {stem}.bed does not fit the number of variants and samples")
    if not tasks:
        return spark.createDataFrame([], schema).select(*T.StructType.fromDDL(schema).names[: 8 if with_path else 7])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known: tuple[str, pa.Array] = ("", pa.array([]))
        for batch in batches:
            for stem, start, end, number, a, b in zip(*[batch.column(c).to_pylist() for c in ("stem", "start", "end", "first", "a", "b")]):
                if known[0] != stem:
                    known = (stem, pa.array([x.split()[1].decode() for x in blocks.lines_between(f"{stem}.fam", 0, 1 << 62)], pa.string()))
                lines = blocks.lines_between(f"{stem}.bim", start, end)[a:b]
                keep = np.ones(len(lines), bool)
                if wanted is not None:
                    sites = blocks.plink_sites(lines)
                    keep[:] = False
                    for contig in set(sites["contig"]):
                        here, spans = sites["contig"] == contig, wanted.get(contig, [])
                        at = np.searchsorted([s for s, _ in spans], sites["pos"], "right") - 1 if spans else np.full(len(lines), -1)
                        ends = np.array([e for _, e in spans] or [0])
                        keep |= here & (at >= 0) & (sites["pos"] <= ends[at])
                yield from blocks.plink_calls(stem, number + a, lines, known[1], keep)

    # Small sets share a task, as far as their bytes together are those of one.
    packed, number, held = [], 0, 0
    for size, t in tasks:
        if held and held + size > (split_bytes or SPLIT_BYTES):
            number, held = number + 1, 0
        packed.append((number, *t))
        held += size
    listed = spark.createDataFrame(packed, "task int, stem string, start long, end long, first long, a long, b long")
    calls = listed.repartitionById(number + 1, F.col("task")).mapInArrow(run, schema)
    return calls if with_path else calls.drop("path")
