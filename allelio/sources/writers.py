"""Writers. Those that split their output by column first rebalance on it, so that a large group is written by
several tasks and small groups do not end up as many tiny files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelio.functions.keys import contig_rank, variant_id
from allelio.operators.intervals import PLACES, place_name
from allelio.operators.joins import BROADCAST_BYTES, lookup_join, staged
from allelio.operators.tiers import id_lists
from allelio.session import SHUFFLES_GO, held, scratch_path
from allelio.sources.headers import COLUMN_LINE, FORMAT_LINE

VCF_HEADER = [FORMAT_LINE, COLUMN_LINE]
ROWS_PER_FILE = 2_000_000
# Calls with lists of genes that one task opens, and folders it writes to at once; a dictionary a column may have in each of their files.
CALLS_PER_TASK, OPEN_FOLDERS, DICTIONARY_BYTES = 500_000, 64, 128 * 1024


def balanced(df: DataFrame, *cols: str) -> DataFrame:
    return df.hint("rebalance", *cols)


def vcf_line(df: DataFrame):
    """VCF text line of a row; absent columns and NULLs are ``.``."""

    def cell(*names: str):
        known = [F.col(n).cast("string") for n in names if n in df.columns]
        return F.coalesce(*known, F.lit("."))

    alts = F.array_join("alts", ",") if "alts" in df.columns else cell("alt")
    return F.concat_ws(
        "\t", cell("contig"), cell("pos"), cell("id"), cell("ref"), alts, cell("qual"), cell("filter"), cell("info")
    )


def write_vcf(
    df: DataFrame,
    path: str,
    by: tuple[str, ...] = ("gene", "source"),
    header: list[str] | None = None,
    rows_per_file: int = ROWS_PER_FILE,
    compression: str = "gzip",
) -> None:
    """Sites-only VCF files, sorted by position, below ``<by>=.../part=...``, each with its own header.

    ``header`` comes from ``header_lines``, which merges and repairs those of the files read. A group larger than ``rows_per_file`` is spread over several parts. Header lines are rows that sort first in
    their file, so nothing but Spark's own sort and text writer is needed.
    """
    header = header or VCF_HEADER
    df, _ = staged(df, "vcf-rows")  # counted, then written
    sizes, size = staged(df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file)).alias("_parts")), "vcf-groups")
    place = F.xxhash64("contig", "pos", "ref", "alts" if "alts" in df.columns else "alt")
    rows = lookup_join(df, sizes, list(by), small=size <= BROADCAST_BYTES).select(
        *by,
        F.pmod(place, F.col("_parts")).cast("int").alias("part"),
        F.lit(len(header)).alias("_line"),
        contig_rank("contig").alias("_rank"),
        "contig",
        "pos",
        vcf_line(df).alias("value"),
    )
    lines = F.explode(F.array(*[F.struct(F.lit(i).alias("_line"), F.lit(t).alias("value")) for i, t in enumerate(header)]))
    tops = (
        sizes.select(*by, F.explode(F.sequence(F.lit(0), (F.col("_parts") - 1).cast("int"))).alias("part"), "_parts")
        .select(*by, "part", lines.alias("_h"))
        .select(
            *by, "part", "_h._line", F.lit(0).alias("_rank"), F.lit("").alias("contig"), F.lit(0).cast("bigint").alias("pos"), "_h.value"
        )
    )
    files = [*by, "part"]
    (
        rows.unionByName(tops)
        .repartition(*files)
        .sortWithinPartitions(*files, "_line", "_rank", "contig", "pos", "value")
        .select(*files, "value")
        .write.mode("overwrite")
        .partitionBy(*files)
        .text(path, compression=compression)
    )


def write_tsv(df: DataFrame, path: str, compression: str = "gzip", by: tuple[str, ...] = ()) -> None:
    """Tab-separated text with header, NULL as ``.``; text is written as it is, without quoting, and nested values as JSON."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType)]
    df = df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested})
    writer = (balanced(df, *by) if by else df).write.mode("overwrite").partitionBy(*by)
    writer.csv(path, sep="\t", header=True, nullValue=".", quote="", escapeQuotes=False, emptyValue="", compression=compression)


def write_categories(df: DataFrame, path: str, by: tuple[str, ...] = ("category", "source", "gene")) -> None:
    """Consequence rows, one folder per category, source and gene."""
    write_tsv(df, path, by=by)


def export_ids(tiers: DataFrame, path: str, key: list[str] | None = None) -> None:
    """Distinct variant IDs per impact, disease and source."""
    by = [c for c in ("impact", "disease", "source") if c in tiers.columns]
    ids = id_lists(tiers, key or ["contig", "pos", "ref", "alt"])
    if key is None:
        ids = ids.select(*by, variant_id().alias("ID"))
    write_tsv(ids, path, compression="none", by=tuple(by))


def write_samples(samples: DataFrame, path: str) -> None:
    """Sample lists (family 0, individual) per ancestry, without header."""
    rows = samples.select("ancestry", F.lit(0).alias("FID"), F.col("sample_id").alias("IID"))
    balanced(rows, "ancestry").write.mode("overwrite").partitionBy("ancestry").csv(path, sep="\t")


def write_regions(regions: DataFrame, path: str) -> None:
    """Region list without header: contig, gene, ``start-end``."""
    span = F.concat_ws("-", "start_pos", "end_pos")
    regions.select("contig", "gene", span.alias("region")).write.mode("overwrite").csv(path, sep="\t")


def write_genotypes(calls: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "gene")) -> None:
    """Region subsets of calls as Parquet per dataset and gene, sorted by position where the calls carry one.

    A column of ``by`` may hold lists: the genes a call belongs to, which has a row in the folder of each. Such calls are sorted and
    staged as they are, and the lists are opened only while the folders are written, so that no row moves more than once however
    many genes it belongs to, and no shuffle is left by then. A task writes to some folders at once; if it meets more, the rest of its
    rows are sorted by folder.
    """
    place = [c for c in ("contig", "pos", "ref", "alt") if c in calls.columns]
    lists = [c for c in by if isinstance(calls.schema[c].dataType, T.ArrayType)]
    if not lists:
        order = [*place, *[c for c in ("sample_id",) if c in calls.columns]]
        balanced(calls, *by).sortWithinPartitions(*by, *order).write.mode("overwrite").partitionBy(*by).parquet(path)
        return
    spark = calls.sparkSession
    # A site's rows stand together, sorted by sample, which packs them well.
    plain = [f.name for f in calls.schema if isinstance(f.dataType, T.AtomicType) and f.name not in (*by, *place, "sample_id")]
    order = [*[c for c in by if c not in lists], *place, *plain, *[c for c in ("sample_id",) if c in calls.columns]]
    with held(spark, SHUFFLES_GO):
        rows = save_stage(calls, scratch_path(spark, "listed-calls"), "calls", order, compression="zstd", maxRecordsPerFile=CALLS_PER_TASK)
    for c in lists:
        rows = rows.withColumn(c, F.explode(c))
    # A file is a task of its own, as opening one counts as much as a task may read.
    whole = {"spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.maxPartitionBytes")}
    with held(spark, {**whole, "spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FOLDERS)}):
        writer = rows.write.mode("overwrite").partitionBy(*by).option("parquet.dictionary.page.size", DICTIONARY_BYTES)
        writer.parquet(path, compression="zstd")


def write_by_position(df: DataFrame, path: str, by: tuple[str, ...] = (), place: str = "place_100kb") -> None:
    """Parquet in partitions of (``by``, place), sorted by position inside.

    A place is 100,000 bases of a contig (``place_100kb``) or a million (``place_mb``, for small tables). Readers that know the
    gene regions then open only the partitions these lie in. A crowded partition is written as several files.
    """
    order = [c for c in ("contig", "pos", "ref", "alt", "sample_id") if c in df.columns]
    partitions = [*by, place]
    placed = df.withColumn(place, place_name("contig", F.floor(F.col("pos") / PLACES[place]), place))
    balanced(placed, *partitions).sortWithinPartitions(*partitions, *order).write.mode("overwrite").partitionBy(*partitions).parquet(path)


def save_stage(df: DataFrame, base: str, name: str, sort_by: list[str] | None = None, **options: str | int) -> DataFrame:
    """Write a named intermediate and read it back, which also cuts its lineage.

    Sorted by (contig, pos, ...) the files carry narrow min/max statistics, so later region filters skip most of them.
    The files are cut by ranges of ``sort_by``: name enough columns to tell rows apart (``sample_id`` for calls), so
    that a frequent value does not end up in one file. ``options`` are those of Spark's writer.
    """
    path = f"{base.rstrip('/')}/{name}"
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
