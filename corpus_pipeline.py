"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

A stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``, whatever other columns there are and however
they are named. Each works on all that the stage before it kept. Null texts count as empty ones and very long texts are read
whole; repeated rows are rows of their own until the near duplicates; an empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelio.llm import bpe, mixing, quality, simhash, toxicity
from allelio.llm.common import stage, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of the documents given.

    Labels that give no model, as those of one class only, reject no document. A text without words is scored like others.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    if not model.fitted:
        return docs
    return docs.filter(quality.score(docs, model) >= 0.5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not mark; it learns from the labels of the documents given.

    Labels that give no model, as those of one class only, remove no document. A text without words is not toxic.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    if not model.fitted:
        return docs
    return docs.filter(toxicity.score(docs, model) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked: that with the smallest id.

    Texts without words are linked with each other. Of rows that share the id, or have none, the one with the smallest values stays.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them; where a source's target ends, the words taken.

    Documents without words give nothing to a mix of words and are not in it. A null source is a source of its own.
    """
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the text decoded from them; a null text has no ids."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("mix", mix_sources),
    ("tokens", encode),
]

#: The classifiers are trained models, which SQL cannot state; the tests compare each stage with its operator's results.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir).select(*[F.col(c) for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")])
