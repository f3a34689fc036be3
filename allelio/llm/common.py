"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelio.session import scratch_path

#: Bytes of white space in the contracts' word patterns; ``bytes.split()`` splits at just these.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    What follows reads files, so it computes nothing twice and does not depend on executors that may be lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def raw(text: Column | str = "text") -> Column:
    """A text's UTF-8 bytes, empty where it is null; workers get bytes, so no text is decoded without need."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.cast("string").cast("binary"), F.lit(b""))


def per_text(fn: Callable[[bytes], tuple], names: list[str], types: list[pa.DataType], ddl: str):
    """Column function: ``fn`` of each text's bytes gives one value per name; evaluated once, wherever it is used."""

    def run(texts: pa.Array) -> pa.Array:
        return _struct([fn(t.as_py() or b"") for t in texts], names, types)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ddl).asNondeterministic()


def per_texts(fn: Callable[[list[str]], list[tuple]], names: list[str], types: list[pa.DataType], ddl: str, size: int = 1 << 22):
    """As ``per_text``, for functions of some texts at a time, about ``size`` characters together."""

    def run(texts: pa.Array) -> pa.Array:
        found: list[tuple] = []
        some: list[str] = []
        held = 0
        for t in texts:
            some.append((t.as_py() or b"").decode("utf-8", "replace"))
            held += len(some[-1])
            if held >= size:
                found += fn(some)
                some, held = [], 0
        return _struct(found + (fn(some) if some else []), names, types)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ddl).asNondeterministic()


def _struct(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Array:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, types, strict=True)], names)


def held_out(doc_id: str, mod: int, rest: int) -> Column:
    """True for rows whose crc32 of the id as text leaves ``rest``; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, kept: Column, per_class: int) -> DataFrame:
    """``doc_id, text, label`` (0/1) of at most ``per_class`` labelled documents of either class.

    Only label rows where ``kept`` holds and whose id is one of ``docs`` are read, so a class has ``per_class`` documents if that
    many are there. Rows of one id count as their rounded mean label; null labels and ids are left out. The choice follows a hash of the id, so it is the same in every run. The ids chosen are bounded by
    ``per_class``, so they may be broadcast; documents stay where they are.
    """
    known = (
        labels.filter(kept & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    )
    known = stage(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "known")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    classes = [known.filter(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    chosen = stage(classes[0].unionByName(classes[1]), "labelled")
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
