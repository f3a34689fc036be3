"""Life cycle of named intermediates: a manifest tells what a stage was made of, so it is reused only if that is unchanged."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelio.sources.writers import save_stage


def input_digest(spark: SparkSession, inputs: list[DataFrame]) -> str | None:
    """Digest of the names, sizes and times of all files behind some tables; None if one of them is not read from files."""
    files = [df.inputFiles() for df in inputs]
    if not all(files):
        return None
    names = sorted({f for some in files for f in some})
    # One row per file, summed where the files are listed.
    listed = spark.read.format("binaryFile").load(names).select(F.xxhash64("path", "length", "modificationTime").alias("h"))
    found = listed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum")).first()
    return f"{found['n']}:{found['sum']}"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _manifest(spark: SparkSession, path: str) -> str | None:
    system, place = _folder(spark, path)
    return "".join(r["value"] for r in spark.read.text(path).collect()) if system.exists(place) else None


def resumed_stage(
    base: str, name: str, build: Callable[[], DataFrame], inputs: list[DataFrame], params: dict | None = None, sort_by: list[str] | None = None
) -> DataFrame:
    """The stage ``name`` below ``base``: read if its manifest names the same inputs and parameters, else built and written.

    A manifest holds the files behind ``inputs`` (names, sizes, times), their schemas and ``params`` (the code's own version among them, if
    results depend on it). It is written after the stage, so a stage that was not finished is built again. Inputs that are
    not read from files are never taken as unchanged.
    """
    spark = inputs[0].sparkSession
    digest = input_digest(spark, inputs)
    want = None
    if digest is not None:
        want = json.dumps({"files": digest, "schemas": [df.schema.json() for df in inputs], "params": params or {}}, sort_keys=True, default=str)
    path, note = f"{base.rstrip('/')}/{name}", f"{base.rstrip('/')}/_{name}.manifest"
    if want is not None and _manifest(spark, note) == want:
        return spark.read.parquet(path)
    system, place = _folder(spark, note)
    system.delete(place, True)
    out = save_stage(build(), base, name, sort_by)
    if want is not None:
        spark.createDataFrame([(want,)], "value string").coalesce(1).write.mode("overwrite").text(note)
    return out


def remove_stages(spark: SparkSession, base: str, names: list[str] | None = None) -> None:
    """Remove some stages below ``base`` with their manifests, or the whole folder."""
    paths = [base] if names is None else [f"{base.rstrip('/')}/{n}" for name in names for n in (name, f"_{name}.manifest")]
    for path in paths:
        system, place = _folder(spark, path)
        system.delete(place, True)
