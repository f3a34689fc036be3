"""The index against counting by hand; shards of any size; scores, cuts and ranks against a plain version."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from allelio.llm import phrases


def by_hand(rows, least, depth=5, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, depth + 1):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        known = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in known.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= f[p[i:j]]}
        found = []
        for p, a in known.items():
            if p not in inside:
                cuts = [(1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus(seed, n=200):
    rnd = random.Random(seed)
    vocabulary = ["The", "cat", "of", "house", "Éa", "éa", "x", "\x00y", "new", "york", "city", "hall", "z\x1c"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(0, 60)):
            parts.append(rnd.choice([*vocabulary, "new york city", "of the house x of", "\t ", ".", ", ", "\n", ";;"]))
        rows.append((rnd.choice(["en", "en", "de", None, "und", ""]), " ".join(parts)))
    return rows + [("en", None), ("fr", ""), ("fr", " . , "), ("es", "alone"), ("en", "new york city " * 2000), (None, "a\x0bb\x0cc\rd")]


@pytest.mark.parametrize("size, least", [(1 << 20, 5), (300, 3), (40, 12)])
def test_collocations(spark, size, least):
    rows = corpus(size)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("clash") for c in ("phrase", "n", "a", "words", "shard")})
    got = phrases.collocations(docs.repartition(3), least=least, size=size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == by_hand(rows, least)


def test_top_and_empty(spark):
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(docs, least=4, top=7).collect())) == by_hand(rows, 4, top=7)
    assert sorted(map(tuple, phrases.collocations(docs, least=4, depth=3).collect())) == by_hand(rows, 4, depth=3)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.filter("lang = 'fr'"), least=1).count() == 0


def test_large_numbers(spark):
    # The product passes 64 bits: 1000 * a * n with parts that are as frequent.
    text = "p q " * 60_000
    docs = spark.createDataFrame([("en", text + "r s " * 50)] * 20, "lang string, text string")
    got = [tuple(r) for r in phrases.collocations(docs.select("lang", "text"), least=900, depth=2).collect()]
    assert got == by_hand([("en", text + "r s " * 50)] * 20, 900, depth=2)


def test_index_extends_both_ways():
    rng = np.random.default_rng(5)
    for n_words in (2, 5, 40):
        ids = np.r_[0, rng.integers(0, n_words + 1, 700), 0].astype(np.int32)
        index = phrases.Index(phrases.transform(ids), phrases.transform(ids[::-1]), n_words)
        seen = {n: Counter(tuple(ids[i : i + n].tolist()) for i in range(len(ids) - n + 1)) for n in range(1, 6)}
        for turns in ("LLLL", "RRRR", "LRLR", "RLLR"):
            word, low, back, size = index.words()
            phrase = word[:, None]
            for turn in turns:
                owner, more, low, back, size = (index.left if turn == "L" else index.right)(low, back, size)
                phrase = np.c_[more, phrase[owner]] if turn == "L" else np.c_[phrase[owner], more]
                want = {p: c for p, c in seen[phrase.shape[1]].items() if 0 not in p}
                assert dict(zip(map(tuple, phrase.tolist()), size.tolist(), strict=True)) == want


def test_shards_are_held_some_at_a_time(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    docs = spark.createDataFrame(corpus(7), "lang string, text string").coalesce(1)
    written = phrases._written(phrases.shards(docs, 40))
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in written.inputFiles()]
    sizes = [g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups)]
    assert sum(sizes) == written.count() > 10 * phrases.GROUP
    assert max(sizes) <= phrases.GROUP
    assert spark.conf.get(setting) == before


def test_phrases_are_spelled_once_and_counted_by_frequent_parts(spark):
    docs = spark.createDataFrame(corpus(11), "lang string, text string")
    indexed = phrases._written(phrases.shards(docs, 60))
    assert indexed.count() > 40
    found, marks = phrases.frequent_phrases(indexed, 6, 5)
    spelled = phrases.phrase_texts(indexed, found, marks, 5).collect()
    want = {}
    for lang, text in corpus(11):
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            for n in range(2, 6):
                for i in range(len(words) - n + 1):
                    key = (lang or ("und" if lang is None else ""), " ".join(words[i : i + n]), n)
                    want[key] = want.get(key, 0) + 1
    # One row for each frequent phrase, though most are in many shards.
    assert sorted((*map(r.__getitem__, ("lang", "phrase", "words")), r["f"]) for r in spelled) == sorted((*k, f) for k, f in want.items() if f >= 6)
    # Longer phrases are counted only if their triples are frequent.
    assert phrases.phrase_counts(indexed, marks, 4, 5).count() < phrases.phrase_counts(indexed, {2: marks[2]}, 4, 5).count()


def test_equal_keys_are_told_apart_by_their_checks():
    keys, checks = np.array([-3, 5, 5, 5, 9]), np.array([1, -2, 0, 7, 4])
    place, ok = phrases._places(keys, checks, np.array([5, 5, 9, 9, -3, 6, 10, 5]), np.array([7, -2, 4, 5, 1, 0, 0, 3]))
    assert ok.tolist() == [True, True, True, False, True, False, False, False]
    assert place[ok].tolist() == [3, 1, 4, 0]
