"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelio.llm import ann, bpe, licenses, minhash, mixing, negatives, parsing, phrases, quality, simhash, toxicity, training_order, warc
from allelio.llm.common import table


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's counts, labels and scores; its spans as their number."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("n_spans", F.size("spans")).drop("spans")


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.compare(table(spark, sf_dir, "documents"))


def training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every seventh id count under the next of ten labels."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def phrase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": license_scan,
    "op2_simhash": near_duplicates,
    "op3_warc": archives,
    "op4_training_order": training_shards,
    "op5_toxicity": toxicity_scores,
    "op6_mixing": source_mix,
    "op7_fingerprints": fingerprints,
    "op8_bpe_round_trip": bpe_round_trip,
    "op9_neighbours": neighbours,
    "op10_quality": quality_scores,
    "op11_hard_negatives": hard_negatives,
    "op12_phrases": phrase_table,
    "op13_minhash": similar_documents,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEGATIVES_SQL = """WITH v AS (
 SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
 FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
 vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""

PHRASES_SQL = f"""WITH RECURSIVE pieces AS (
 SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
 FROM words, range(1, 6) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
known AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
inside AS (SELECT DISTINCT g.lang, array_to_string(g.w[i:j], ' ') AS phrase, g.f FROM known g, range(1, 5) AS a(i), range(2, 6) AS b(j)
 WHERE i < j AND j <= g.k AND j - i + 1 < g.k),
kept AS (SELECT * FROM known p WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = p.lang AND i.phrase = p.phrase AND 100 * i.f >= 100 * p.f)),
cuts AS (SELECT p.lang, p.phrase, p.f AS a, c.cut, l.f AS l, r.f AS r, t.n,
  (1000::HUGEINT * p.f * t.n) // (l.f::HUGEINT * r.f) AS score
 FROM kept p JOIN range(1, 5) AS c(cut) ON c.cut < p.k JOIN total t ON t.lang = p.lang
 JOIN f l ON l.lang = p.lang AND l.phrase = array_to_string(p.w[1:c.cut], ' ')
 JOIN f r ON r.lang = p.lang AND r.phrase = array_to_string(p.w[c.cut + 1:p.k], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM worst QUALIFY rank <= 2000"""

SIMILAR_SQL = f"""WITH RECURSIVE words AS (
 SELECT doc_id, list_filter(string_split_regex({LOWERED}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
 FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM documents d JOIN reached r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""

#: DuckDB SQL with the same rows, where SQL can state the result.
ORACLES: dict[str, str] = {
    "op11_hard_negatives": NEGATIVES_SQL,
    "op12_phrases": PHRASES_SQL,
    "op13_minhash": SIMILAR_SQL,
}
