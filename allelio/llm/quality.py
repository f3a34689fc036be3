"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a table of scores over its bins, and so have a few pairs of features. Cyclic boosting learns the
tables: every round visits each feature in turn and adds a small tree over its bins, fitted to the gradient of the log
loss, so correlated features share their effect evenly. A score is a sum of table entries, looked up for all texts
of a batch at once. Features are counts of characters, words and lines; no label, language, source or id goes in.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelio.llm.common import held_out, labelled_sample, raw

FEATURES = [
    "log_words", "word_bytes", "distinct_words", "top_word", "repeated_pairs", "short_words", "long_words", "upper", "digits", "signs",
    "sentence_signs", "odd_signs", "spaces", "non_ascii", "line_words", "repeated_lines", "unended_lines", "byte_entropy",
]
#: Label rows of either class that a fit uses at most.
PER_CLASS = 10_000
BINS, PAIR_BINS, PAIRS = 64, 16, 8
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 240, 80, 0.08, 1.0

_CLASSES = np.zeros((256, 7))
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = [
        "A" <= _c <= "Z", "a" <= _c <= "z", "0" <= _c <= "9", _b < 128 and _c.isprintable() and not _c.isalnum() and _c != " ",
        _c in ".,;:?'\"()-" and _b < 128, _b in (9, 10, 11, 12, 13, 32), _b >= 128,
    ]


def features(text: bytes) -> list[float]:
    """Feature values in the order of ``FEATURES``; an empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    size = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digits, signs, plain, spaces, high = (counts @ _CLASSES).tolist()
    share = counts[counts > 0] / size
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 12 + [1.0] + [0.0] * 4 + [float(-(share * np.log2(share)).sum())]
    kinds = Counter(words)
    pairs = len(set(zip(words, words[1:])))  # noqa: B905
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in text.split(b"\n") if line.strip()]
    ended = sum(line.rstrip()[-1:] in (b".", b"!", b"?", b'"') for line in lines)
    return [
        float(np.log(n)), float(lengths.mean()), len(kinds) / n, max(kinds.values()) / n, 1 - pairs / max(1, n - 1), float((lengths <= 3).mean()),
        float((lengths >= 16).mean()), upper / max(1.0, upper + lower), digits / size, signs / size, plain / max(1.0, signs), (signs - plain) / n,
        spaces / size, high / size, float(np.log1p(n / len(lines))), 1 - len(set(lines)) / len(lines), 1 - ended / len(lines),
        float(-(share * np.log2(share)).sum()),
    ]


@dataclass
class Model:
    """Bin edges per feature, a table per feature and per pair, and the intercept."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    intercept: float
    #: False if the labels held no two classes, so that the scores tell nothing.
    fitted: bool = True

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features."""
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _gain(g, h):
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best place to split a run of bins, and its gain."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with up to three leaves."""
    out = np.zeros(len(g))
    gain, at = _cut(g, h)
    cuts = [0, at, len(g)] if gain > 0 else [0, len(g)]
    if gain > 0:
        below, above = _cut(g[:at], h[:at]), _cut(g[at:], h[at:])
        best = max((below[0], below[1]), (above[0], at + above[1]))
        if best[0] > 0:
            cuts = sorted({*cuts, best[1]})
    for a, b in zip(cuts, cuts[1:]):  # noqa: B905
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per cell: the best split on one feature, with a split on the other on either side of it."""
    best, out = -1.0, np.zeros(g.shape)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        sums = np.cumsum(a, 0), np.cumsum(b, 0)
        for at in range(1, len(a)):
            below = sums[0][at - 1], sums[1][at - 1]
            cuts = [_cut(*below), _cut(sums[0][-1] - below[0], sums[1][-1] - below[1])]
            gain = cuts[0][0] + cuts[1][0] + _gain(below[0].sum(), below[1].sum()) + _gain((sums[0][-1] - below[0]).sum(), (sums[1][-1] - below[1]).sum())
            if gain > best:
                found = np.zeros(a.shape)
                for part, (_, cut) in zip((slice(0, at), slice(at, None)), cuts, strict=True):
                    for side in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
                        found[part, side] = -a[part, side].sum() / (b[part, side].sum() + RIDGE)
                best, out = gain, found.T if turn else found
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the feature tables, then of the strongest pairs on what they leave."""
    n, d = x.shape
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    weight = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate))  # both classes count alike
    edges, pair_edges = [_edges(x[:, j], BINS) for j in range(d)], [_edges(x[:, j], PAIR_BINS) for j in range(d)]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], pair_edges, [], [], 0.0)
    if not n or len(set(y.tolist())) < 2:
        model.intercept = 4.0 if n and y[0] > 0 else -4.0 if n else 0.0
        model.fitted = False
        return model
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    total = np.zeros(n)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return weight * (p - y), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            size = len(model.tables[j])
            if size > 1:
                g, h = slopes()
                step = RATE * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size))
                model.tables[j] += step
                total += step[bins[j]]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(pair_edges)]
    sizes = [len(e) + 1 for e in pair_edges]

    def cells(a: int, b: int):
        g, h = slopes()
        at, shape = coarse[a] * sizes[b] + coarse[b], (sizes[a], sizes[b])
        grids = [np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]
        return at, _pair_tree(*grids), grids

    def strength(pair):
        _, tree, (g, h) = cells(*pair)
        return -float((tree * g + 0.5 * tree * tree * h).sum())

    model.pairs = sorted(combinations([j for j in range(d) if sizes[j] > 1], 2), key=strength, reverse=True)[:PAIRS]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            at, tree, _ = cells(a, b)
            model.pair_tables[k] += RATE * tree
            total += RATE * tree.reshape(-1)[at]
    return model


def train(docs: DataFrame, labels: DataFrame, kept: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Fit on label rows where ``kept`` holds (all, if not given), at most ``per_class`` of either class.

    Only the feature rows of that bounded sample reach the driver. Without labels every score is 0.5; with one class
    only, scores are all near that class.
    """

    def run(batches):
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    sample = labelled_sample(docs, labels, "quality", F.lit(True) if kept is None else kept, per_class)
    rows = sample.select("doc_id", F.col("label").cast("int").alias("label"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("x", T.ArrayType(T.DoubleType()))])).orderBy("doc_id").toArrow()
    x = np.array(found["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, found["label"].to_numpy().astype(float))


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Column with the probability that a text's label is 1; null and empty texts have the score of all-zero features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some tables of 64 bins

    def run(texts: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py()) for t in texts], float).reshape(-1, len(FEATURES))
        return pa.array(shared.value.scores(x), pa.float64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double").asNondeterministic()(raw(text))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Labels are learnt from rows whose crc32 of the id as text leaves no remainder of 1 by 3; the others are held out. Null ids
    are not held out and stay in the result; null texts count as empty; repeated rows get equal scores. Other columns
    of ``docs`` are not read. An empty table gives an empty result.
    """
    model = train(docs, labels, ~held_out("doc_id", 3, 1))
    scored = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
