"""Tables in buckets of a key: calls and samples stored so meet without a shuffle, whatever their size."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _name(path: str) -> str:
    return f"allelio_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def write_buckets(df: DataFrame, path: str, by: str = "sample_id", buckets: int = 512) -> DataFrame:
    """Write a table below ``path`` in ``buckets`` of a hash of ``by``, one file each, sorted by it; read back as ``read_buckets`` does.

    Tables that are to meet need the same number of buckets; about 1 GB a bucket of the larger one is a good size.
    """
    spark, name = df.sparkSession, _name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.repartition(buckets, F.col(by)).write.mode("overwrite").bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
    return spark.table(name)


def read_buckets(spark: SparkSession, path: str, schema: str, by: str = "sample_id", buckets: int = 512) -> DataFrame:
    """A table that ``write_buckets`` wrote, perhaps in another session, with what Spark has to know of its buckets."""
    name = _name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
