"""Joins of a large table to a smaller one, safe against hot keys and against a smaller side that grows.

The smaller side is broadcast only after its bytes were measured. Beyond the bound, the join shuffles on the
key plus a salt: rows of a hot key spread over several partitions and the smaller side is repeated per salt, as often
as a total of ``REPEAT_BYTES`` allows. A side too large to be repeated joins by key alone; there adaptive execution
splits the partition of a hot key. Beyond the bound a merge join is asked for: Spark's own estimate goes by the bytes of compressed
files, before the side is repeated, and would broadcast millions of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelio.session import scratch_path

BROADCAST_BYTES = 64 * 1024 * 1024
REPEAT_BYTES = 1024**3
SALTS = 16


def _size_metrics(df: DataFrame) -> list[Column]:
    texts = [f.name for f in df.schema if not isinstance(f.dataType, T.NumericType | T.BooleanType)]
    lengths = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("bigint") for c in texts]
    row = reduce(lambda a, b: a + b, lengths, F.lit(16 * len(df.columns)).cast("bigint"))
    return [F.coalesce(F.sum(row), F.lit(0)).alias("bytes")]


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the texts plus 16 per value, from one aggregation; no rows reach the driver."""
    return df.agg(*_size_metrics(df)).first()["bytes"]


def staged(df: DataFrame, name: str = "stage") -> tuple[DataFrame, int]:
    """Write a derived table to the shared folder and read it back; also its measured bytes, taken while writing.

    For a table that is computed once and read several times: the size check costs no second computation, and what
    follows no longer depends on executors that may be lost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    size = Observation()
    df.observe(size, *_size_metrics(df)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), size.get["bytes"]


def _salted(left: DataFrame, right: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    # The salt comes from the row's values, so a task that runs again after a lost executor repeats it.
    flat = [f.name for f in left.schema if isinstance(f.dataType, T.AtomicType)]
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*flat), F.lit(salts)))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left, right


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    on: list[str] | str,
    how: str = "inner",
    where: Column | None = None,
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
    stage: bool = False,
    small: bool | None = None,
    size: int | None = None,
) -> DataFrame:
    """Join ``fact`` to ``dim`` on named keys (``inner``, ``left``, ``left_semi`` or ``left_anti``).

    ``where`` is a residual condition over columns of both sides (``l.`` and ``r.``). ``stage`` writes a ``dim`` that
    is costly to compute before it is measured. ``size`` names bytes already measured, ``small`` states the outcome of a
    check already made.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if small is None:
        if stage:
            dim, size = staged(dim)
        elif size is None:
            size = measured_bytes(dim)
        small = size <= max_bytes
        salts = max(1, min(salts, REPEAT_BYTES // max(size, 1)))
    if small:
        dim = F.broadcast(dim)
    else:
        if salts > 1:
            fact, dim = _salted(fact, dim, salts)
            keys = [*keys, "_salt"]
        dim = dim.hint("merge")
    if where is None:
        return fact.join(dim, keys, how).drop("_salt")
    fact, dim = fact.alias("l"), dim.alias("r")
    cond = reduce(lambda a, b: a & b, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys], where)
    joined = fact.join(dim, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_salt")
    extra = [F.col(f"r.{c}") for c in dim.columns if c not in keys]
    return joined.select("l.*", *extra).drop("_salt")


def semi_join(df: DataFrame, ids: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows whose key is in ``ids``."""
    keys = [on] if isinstance(on, str) else list(on)
    return lookup_join(df, ids.select(*keys).distinct(), keys, "left_semi", stage=True)


def semi_join_any(df: DataFrame, id_sets: list[DataFrame], on: list[str] | str) -> DataFrame:
    """Rows whose key is in at least one of several sets: one join against their union, no OR condition."""
    keys = [on] if isinstance(on, str) else list(on)
    return semi_join(df, stack([s.select(*keys) for s in id_sets]), keys)


def consensus(df: DataFrame, id_sets: list[DataFrame], on: list[str] | str) -> DataFrame:
    """Rows whose key is in every one of several sets."""
    return reduce(lambda acc, s: semi_join(acc, s, on), id_sets, df)


def union_ids(id_sets: list[DataFrame], on: list[str] | str) -> DataFrame:
    """Distinct keys over several sets."""
    keys = [on] if isinstance(on, str) else list(on)
    return stack([s.select(*keys) for s in id_sets]).distinct()


def intersect_ids(id_sets: list[DataFrame], on: list[str] | str) -> DataFrame:
    """Distinct keys found in all sets."""
    keys = [on] if isinstance(on, str) else list(on)
    first, *rest = [s.select(*keys) for s in id_sets]
    return consensus(first.distinct(), rest, keys)


def inner_merge(tables: list[DataFrame], on: list[str] | str) -> DataFrame:
    """Rows of several tables that share a key, side by side, for the keys that are in all of them.

    One aggregation over any number of tables, with a bit per table that tells where a key is, in place of a chain of joins; hot
    keys are reduced before they move. Of several rows of a table under one key the smallest counts. Column names other than the key must
    differ. A NULL key is a key like any other.
    """
    keys = [on] if isinstance(on, str) else list(on)
    own = [[c for c in t.columns if c not in keys] for t in tables]
    names = [c for some in own for c in some]
    if len(set(names)) < len(names):
        raise ValueError("two tables have a column of the same name")
    if len(tables) > 63:
        raise ValueError("more than 63 tables")
    kinds = [T.StructType([t.schema[c] for c in some]) for t, some in zip(tables, own)]
    parts = []
    for i, (t, some) in enumerate(zip(tables, own)):
        cells = [F.struct(*some).alias(f"_t{j}") if i == j and some else F.lit(None).cast(kinds[j] if own[j] else "int").alias(f"_t{j}") for j in range(len(tables))]
        parts.append(t.select(*keys, F.lit(1 << i).cast("bigint").alias("_bit"), *cells))
    merged = stack(parts).groupBy(*keys).agg(F.bit_or("_bit").alias("_in"), *[F.min(f"_t{j}").alias(f"_t{j}") for j in range(len(tables))])
    values = [F.col(f"_t{j}.{c}").alias(c) for j, some in enumerate(own) for c in some]
    return merged.filter(F.col("_in") == (1 << len(tables)) - 1).select(*keys, *values)


def flag_in(df: DataFrame, ids: DataFrame, on: list[str] | str, name: str) -> DataFrame:
    """Add a 0/1 column that tells whether the key is in ``ids``."""
    keys = [on] if isinstance(on, str) else list(on)
    marked = ids.select(*keys).distinct().withColumn(name, F.lit(1))
    return lookup_join(df, marked, keys, "left", stage=True).withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def annotate(df: DataFrame, annotations: DataFrame, on: list[str], cols: list[str], prefer: list[Column] | None = None) -> DataFrame:
    """Left-join annotation columns on an exact key; several annotation rows of one key count as one.

    ``prefer`` orders the annotation rows of one key; by default the smallest values win.
    """
    order = prefer or [F.struct(*cols)]
    best = annotations.groupBy(*on).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_a"))
    return lookup_join(df, best.select(*on, "_a.*"), on, "left", stage=True)


def override_rule(df: DataFrame, gene: str, special: Column, default: Column, gene_col: str = "gene") -> DataFrame:
    """Keep rows by one rule for a gene and by another rule for all other genes, NULL genes included."""
    own = F.col(gene_col).eqNullSafe(F.lit(gene))
    return df.filter(F.when(own, special).otherwise(default))


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key in an explicit order; reduced map-side, so a hot key never sits in one task.

    Rows that tie on ``order`` are told apart by their other columns, so a rerun gives the same row.
    """
    rest = [c for c in df.columns if c not in key]
    ranked = [*order, *[c for c in rest if c not in order]]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*ranked)).alias("_first"))
    return best.select(*key, "_first.*").select(*df.columns)


def step_counts(steps: dict[str, DataFrame]) -> DataFrame:
    """One row per named table with its number of rows."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("step"), "n_rows") for name, df in steps.items()
    ]
    return stack(counted)


def stack(dfs: list[DataFrame]) -> DataFrame:
    """All rows of several tables, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)
