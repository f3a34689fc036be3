"""Targets against filling by hand, the schedule's evenness, the mix against a walk over slots and blocks."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from allelio.llm import mixing


def by_hand(sizes, share=1.5, most=2):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        level = left / open_ if open_ else 0
        over = {s for s in names if s not in full and weight[s] * level >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {s: rnd.choice([0, 1, 50, 3000, rnd.randint(1, 10**6)]) for s in ["b", "a", "ä", "Z", "", "zz", "c", None][: rnd.randint(1, 8)]}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = by_hand(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6)


def test_schedule_is_even(spark):
    goals = spark.createDataFrame([("a", 0, 300_000, 450_000.0), ("b", 1, 90_000, 30_000.0), (None, 2, 50_000, 100_000.0), ("z", 3, 0, 0.0)], "source string, no int, source_size long, target double")
    rows = mixing.schedule(goals).orderBy("slot").collect()
    seen = {}
    for r in rows:
        assert r["rank"] == seen.get(r["no"], 0)
        seen[r["no"]] = r["rank"] + 1
        share = {0: 45 / 58, 1: 3 / 58, 2: 10 / 58}[r["no"]]
        if r["slot"] < 2000:
            assert abs(r["rank"] - share * r["slot"]) < 5
    assert seen[0] == math.ceil(300_000 / 256) + math.ceil(150_000 / 256)
    assert seen[2] == 2 * math.ceil(50_000 / 256)


def test_tiny_sources_beside_large_ones_get_all_their_ranks(spark):
    sizes = {0: 5_000_000, 1: 3_000_000, 2: 2_000_000} | {no: size for no, size in enumerate([1, 40, 40, 40, 100, 100, 200, 300], 3)}
    target = {no: float(size if no < 3 else 2 * size) for no, size in sizes.items()}
    goals = spark.createDataFrame([(str(no), no, size, target[no]) for no, size in sizes.items()], "source string, no int, source_size long, target double")
    rows = mixing.schedule(goals).orderBy("slot").collect()
    assert len({r["slot"] for r in rows}) == len(rows)
    seen = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r["rank"] == seen[r["no"]]
        seen[r["no"]] += 1
    assert seen == {no: math.ceil(size / 256) * (1 if no < 3 else 2) for no, size in sizes.items()}


def test_mix_takes_a_tiny_source_whole(spark):
    text = F.when(F.col("id") < 6, F.expr("repeat('tiny ', 40)")).otherwise(F.expr("repeat('w ', 1000)"))
    source = F.when(F.col("id") < 6, F.concat(F.lit("t"), "id")).otherwise(F.concat(F.lit("a"), F.expr("id % 3")))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), source.alias("source"), F.length(text).cast("long").alias("n_chars"))
    taken = [(r["taken"], r["target"]) for r in mixing.mix(docs).filter("doc_id < 6").collect()]
    assert taken == [(80, 80.0)] * 6
    assert mixing.apply(docs).filter("doc_id < 6").count() == 12


def documents(seed=1, n=300):
    rnd = random.Random(seed)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 100, 257, 900])), "en", rnd.choice(["hot"] * 6 + ["a", "b", None, "é"]), 3) for i in range(n)]
    return rows + [(None, None, None, None, None), (1, "x\ty\n", "en", "a", 4), (1, "x\ty\n", "en", "a", 4), (1, "x\ty\n", "en", "a", 4)]


def test_mix(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("size", F.lit("x"))
    got = mixing.mix(docs).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, mixing.mix(docs.repartition(5)).collect())))
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((i, words(t)) for i, t, *_ in rows if i is not None)
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = by_hand(sizes)
    source = {i: s for i, _, _, s, _ in rows}
    taken = {}
    for r in got:
        s = source[r["doc_id"]] if r["doc_id"] != 1 or r["size"] == 2 or True else None
        assert 0 <= r["taken"] <= 2 * r["size"]
        if r["doc_id"] != 1:
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        key = r["source_size"], round(r["target"], 3)
        taken[key] = taken.get(key, 0) + r["taken"]
    for s in sizes:
        assert abs(taken[sizes[s], round(want[s], 3)] - want[s]) <= 1, s


def test_apply_gives_the_words_taken(spark):
    rows = documents(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    out = mixing.apply(docs)
    assert out.columns == docs.columns
    got, texts = {}, {}
    for i, t, *_ in rows:
        texts.setdefault(i, set()).add(t)
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["text"] in texts[r["doc_id"]] or any((t or "").split()[: len(r["text"].split())] for t in texts[r["doc_id"]])
    assert got == {i: n for i, n in taken.items() if n}


def test_columns_may_have_any_names(spark):
    rows = documents(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.selectExpr("*", "1 AS _h1", "2 AS h1", "'x' AS `row`", "3 AS _part", "4 AS part", "5 AS cut", "6 AS `a.b`")
    out = mixing.apply(extra)
    assert out.columns == extra.columns
    assert {(r["_h1"], r["h1"], r["row"], r["_part"], r["part"], r["cut"], r["a.b"]) for r in out.collect()} == {(1, 2, "x", 3, 4, 5, 6)}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.mix(docs).count() == 0
    assert mixing.apply(docs).count() == 0
    wordless = spark.createDataFrame([(1, " ", "en", "a", 1), (2, None, "en", None, 0)], docs.schema)
    assert [(r["taken"], r["target"]) for r in mixing.mix(wordless).collect()] == [(0, 0.0), (0, 0.0)]
    assert mixing.apply(wordless).count() == 0
