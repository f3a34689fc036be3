"""Sets, keys and components against brute force; groups cut into parts and blocks."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelio.llm import minhash


def slow_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_hand(rows):
    sets = [slow_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    out = []
    for i, (doc, _) in enumerate(rows):
        component = least.get(root(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), component, doc is not None and doc == component))
    return sorted(out, key=repr)


def corpus(seed, groups=10, copies=14, words=120, edits=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rnd.randint(0, edits)):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            rows.append((len(rows) * 7 % 10_007, " ".join(text)))
    return rows


ODD = [(20_001, None), (20_002, ""), (20_003, " \t\n"), (20_004, "One two"), (20_005, "one  TWO"), (20_006, "one two three four five"),
       (None, "one two"), (None, "no id at all here"), (None, "no id at all here"), (5, "a b c d e f g"), (5, "a b c d e f g"),
       (20_007, "É é x y z"), (20_008, "é é x y z"), (20_009, "w " * 50_000), (20_010, "W " * 7 + "w"), (None, None)]


def test_documents(spark):
    rows = corpus(1) + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("node", "n", "sig", "component", "name", "key")})
    got = minhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert minhash.near_duplicates(docs.filter("text IS NULL")).count() == 2


@pytest.mark.parametrize("together, block", [(4, 3), (2, 1)])
def test_groups_in_parts(spark, together, block):
    # Copies with many edits: similar to some of the group only, so components stay apart and blocks meet.
    rows = corpus(2, groups=2, copies=40, words=150, edits=9)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), together, block)
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows)


def test_all_pairs_within_the_distance_meet():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 16, (1, minhash.PLACES)).astype(np.uint16)
    for n in list(range(minhash.MOST + 1)) * 20:
        other = sig.copy()
        at = rng.choice(minhash.PLACES, n, replace=False)
        other[0, at] ^= 1
        shared = np.flatnonzero(minhash.keys(sig)[0] == minhash.keys(other)[0])
        assert len(shared)
        assert minhash.first_shared(sig != other)[0] == shared[0]
    # One more spread evenly: two in each chunk and one in the rest.
    other = sig.copy()
    other[0, [c * 5 + i for c in range(12) for i in (0, 1)] + [63]] ^= 1
    assert minhash.first_shared(sig != other)[0] == -1
    assert not (minhash.keys(sig) == minhash.keys(other)).any()


def test_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 40_000).astype(np.uint64)
    found = [np.mean(minhash.signature(pool[i : i + 900]) == minhash.signature(pool[i + 100 : i + 1000])) for i in range(0, 39_000, 300)]
    assert abs(np.mean(found) - 0.8) < 0.02
