"""Both classifiers: held-out accuracy on the test tables, parts against brute force, odd rows."""

import zlib
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from allelio.llm import common, quality, toxicity

SF = "/root/testdata/sf0.01"


def by_hand(a, b):
    """Kernel by listing all subsequences, scaled as the module says."""

    def parts(word):
        signs = [0 if c in "-*." else ord(c) for c in "^" + word]
        return [(tuple(signs[i] for i in at), toxicity.DECAY ** (at[2] - at[0] + 1)) for at in combinations(range(len(signs)), 3) if at[2] - at[0] < toxicity.SPAN and all(signs[i] for i in at)]

    x, y = parts(a), parts(b)
    size = np.sqrt(sum(w * w for _, w in x) * sum(w * w for _, w in y))
    return sum(v * w for s, v in x for t, w in y if s == t) / size if size else 0.0


def test_kernel_equals_listing():
    words = ["idiot", "id-iot", "i.d.i.o.t", "banana", "aaaaaaaa", "ab", "", "x", "--", "worthless", "wor*thl3ss"]
    got = toxicity.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(by_hand(a, b), abs=1e-9), (a, b)


def test_gaps_weaken_but_do_not_hide_a_word():
    near, far = toxicity.kernel(["sc*um", "s-c-u-m", "window"], ["scum"])[:, 0][:2], toxicity.kernel(["window"], ["scum"])[0, 0]
    assert 1 > near[0] > near[1] > far + 0.1


def test_scores_equal_margins_of_words():
    rnd = np.random.default_rng(0)
    model = toxicity.Model(rnd.normal(size=toxicity.ALPHABET**3), -0.1, (1.0, 0.5, 0.2))
    text = "Some words, and\nsome M O R E words here x.y.z"
    found = {w for s in toxicity.sentences(text) for w in s}
    assert "more" in found
    top = sorted([*(model.margins([w])[0] for w in found), model.bias, model.bias])[::-1]
    assert toxicity.Scorer(model).scores([text, ""])[0] == pytest.approx(1 / (1 + np.exp(-(top[0] + 0.5 * top[1] + 0.2))))


def test_trees_and_tables():
    rnd = np.random.default_rng(1)
    x = rnd.uniform(size=(3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs
    assert ((model.scores(x) >= 0.5) == (y > 0)).mean() > 0.95
    by_tables = model.intercept + sum(t[np.searchsorted(e, x[7, j], side="right")] for j, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
    by_tables += sum(t[np.searchsorted(model.pair_edges[a], x[7, a], side="right"), np.searchsorted(model.pair_edges[b], x[7, b], side="right")] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
    assert model.scores(x[7:8])[0] == pytest.approx(1 / (1 + np.exp(-by_tables)))


def held_out_accuracy(spark, sf, module, label, mod, rest):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in module.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % mod == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["predicted"], truth[i]) for i, r in got.items() if r["held_out"] and i in truth]
    return np.mean([p == t for p, t in held])


def test_quality_on_held_out_rows(spark):
    assert held_out_accuracy(spark, SF, quality, "quality", 3, 1) > 0.97


def test_toxicity_on_held_out_rows(spark):
    # A part of the toxic documents of this table holds no insult that occurs elsewhere.
    assert held_out_accuracy(spark, "/root/testdata/sf0.1", toxicity, "toxic", 5, 0) > 0.9


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, module, label):
    texts = [None, "", " \n ", "word " * 50_000, "fine text. More of it", "bad!!! $$$ scum", "bad!!! $$$ scum"]
    rows = [(i % 6, t) for i, t in enumerate(texts)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("label", F.lit(1))
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, None), (None, 1), (4, 1), (2, 0)], f"doc_id long, {label} int")
    got = module.classify(docs, labels).collect()
    assert len(got) == len(rows)
    assert len({r["score"] for r in got if r["doc_id"] == 0 and r["score"] is not None}) >= 1
    assert module.classify(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in module.classify(docs, labels.limit(0)).collect()} == {0.5}


def skewed(insults):
    """Clean texts with an insult in the first few."""
    rnd = np.random.default_rng(5)
    usual = ["".join(rnd.choice(list("etaoinsrhl"), 6)) for _ in range(300)]
    texts = [" ".join(rnd.choice(usual, 30)) for _ in range(1500 + len(insults))]
    return [f"{t} {i}" for t, i in zip(texts, insults)] + texts[len(insults) :]


@pytest.mark.parametrize("toxic_first", [True, False])
def test_few_toxic_documents_are_told_from_the_clean_ones(toxic_first):
    texts = skewed(["zuckwump", "vixbog", "jumpquaff", "gymkvex", "dwyfumb"])
    y = np.r_[np.ones(5), np.zeros(len(texts) - 5)]
    if not toxic_first:
        texts, y = texts[::-1], y[::-1]
    model = toxicity.fit([toxicity.sentences(t) for t in texts], y)
    marked = toxicity.Scorer(model).scores(texts) >= 0.5
    assert model.fitted and marked[y > 0].all() and marked[y <= 0].mean() < 0.02


@pytest.mark.parametrize("order", [1, -1])
def test_no_telling_word_gives_the_share_of_toxic_documents(order):
    model = toxicity.fit([[], [["some", "words"]], [["more", "words"]], [["words"]]][::order], np.array([1.0, 0, 0, 0])[::order])
    assert not model.fitted
    assert toxicity.Scorer(model).scores(["some words", ""]) == pytest.approx([0.25, 0.25])


@pytest.mark.parametrize("toxic", [[], [0, 0], [1, 1], [0, None]])
def test_labels_that_give_no_model_remove_no_document(spark, tmp_path, toxic):
    docs = spark.createDataFrame([(0, "some words"), (1, "more words"), (2, None)], "doc_id long, text string")
    spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 3


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_sample_is_of_labelled_documents_that_are_there(spark, label):
    docs = spark.range(0, 400, 10).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("cast(id div 10 % 2 as int)").alias(label))
    got = common.labelled_sample(docs, labels, label, F.lit(True), 15).collect()
    assert [sum(r["label"] == c for r in got) for c in (0, 1)] == [15, 15]
