"""VCF header lines as a table: what kind of line, its ID, its keys in order; merged over files, repaired, written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelio.functions.fields import header_pairs, repair_header

#: Header lines that one file may get; they are written at the top of every part.
MAX_LINES = 100_000
COLUMN_LINE = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"])
FORMAT_LINE = "##fileformat=VCFv4.2"


def parse_header(lines: DataFrame) -> DataFrame:
    """``kind, id, keys, line`` of ``##`` lines (``value``), with the other columns of ``lines``.

    ``keys`` is an array of ``key, value`` in order, quotes kept; a line without ``<..>`` has one key, its own kind.
    """
    kept = [c for c in lines.columns if c != "value"]
    line = F.col("value")
    kind = F.regexp_extract(line, "^##([^=]+)=", 1)
    own = F.array(F.struct(kind.alias("key"), F.regexp_replace(line, "^##[^=]+=", "").alias("value")))
    keys = F.when(line.rlike("^##[^=]+=<.*>$"), header_pairs(line)).otherwise(own)
    out = lines.filter(line.startswith("##")).select(*kept, kind.alias("kind"), keys.alias("keys"), line.alias("line"))
    named = F.get(F.filter("keys", lambda x: x["key"] == "ID"), F.lit(0))["value"]
    return out.select(*kept, "kind", F.when(F.col("line").rlike("^##[^=]+=<"), named).alias("id"), "keys", "line")


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """Header of every VCF file that ``path`` names: ``path, place, kind, id, keys, line``; ``place`` orders a file's lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    # Within a file's block rows come in order, and headers stand in its first blocks.
    lines = lines.withColumn("mid", F.monotonically_increasing_id()).filter(F.col("value").startswith("##"))
    return parse_header(lines.select("path", F.struct("block", "mid").alias("place"), "value"))


def merge_headers(header: DataFrame) -> DataFrame:
    """One line per kind and ID, or per line without ID: the first by path and place. Repaired on the way."""
    fixed = header.withColumn("line", repair_header("line"))
    first = fixed.groupBy("kind", F.coalesce("id", "line").alias("name")).agg(F.min_by(F.struct("path", "place", "id", "line"), F.struct("path", "place")).alias("f"))
    return first.select("kind", "f.id", "f.line", "f.path", "f.place")


def header_lines(merged: DataFrame) -> list[str]:
    """Lines for ``write_vcf``: the file format, all others in the order of the first file that has them, the column line."""
    rows = merged.filter("kind <> 'fileformat'").orderBy("path", "place").limit(MAX_LINES + 1).collect()
    if len(rows) > MAX_LINES:
        raise ValueError(f"a header of more than {MAX_LINES} lines")
    form = merged.filter("kind = 'fileformat'").orderBy(F.col("line").desc()).limit(1).collect()
    return [form[0]["line"] if form else FORMAT_LINE, *[r["line"] for r in rows], COLUMN_LINE]


def header_value(keys: Column | str, name: str) -> Column:
    """Value of one key of a parsed line, without quotes; NULL if it has none."""
    found = F.get(F.filter(F.col(keys) if isinstance(keys, str) else keys, lambda x: x["key"] == name), F.lit(0))["value"]
    return F.regexp_replace(found, '^"(.*)"$', "$1")
