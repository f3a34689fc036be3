"""Fingerprints and components against brute force; every level of the table on its own."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from allelio.llm import simhash


def slow_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, most=3):
    """Component of each (id, fingerprint) by comparing all pairs."""
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                parent[root(b)] = root(a)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [least.get(root(f)) for _, f in rows]


TEXTS = [None, "", " \t\n", "One", "one", "two words", "a b c", "A B C d", "É é x y z", "w " * 70_000, "x y z " * 300 + "tail"]


def test_fingerprints(spark):
    rnd = random.Random(1)
    texts = TEXTS + [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 40) for _ in range(rnd.randint(1, 900))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint").collect()}
    assert got == {i: f"{slow_fingerprint(t):016x}" for i, t in enumerate(texts)}
    # The hash is Spark's own.
    assert spark.sql("select xxhash64('a b c')").first()[0] == np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)).astype(np.int64)


def clouds(seed, groups=14, n=30, most=5):
    rnd = random.Random(seed)
    out = [0, (1 << 64) - 1, 7]
    for _ in range(groups):
        centre = rnd.getrandbits(64)
        for _ in range(n):
            f = centre
            for _ in range(rnd.randint(0, most)):
                f ^= 1 << rnd.randrange(64)
            out.append(f)
    return out


def signed(values):
    return np.array(values, np.uint64).view(np.int64).tolist()


@pytest.mark.parametrize("direct", [2048, 6, 1])
def test_components_of_clouds(spark, direct):
    prints = clouds(direct)
    distinct = spark.createDataFrame([(f,) for f in signed(sorted(set(prints)))], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(distinct, direct=direct)).collect()}
    want = slow_components([(i, f) for i, f in enumerate(prints)])
    got = [found.get(f, f) for f in signed(prints)]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_links_do_not_list_pairs(spark):
    centre = random.Random(2).getrandbits(64)
    prints = [centre ^ 1 << a ^ 1 << b for a in range(60) for b in range(a)]
    distinct = spark.createDataFrame([(f,) for f in signed(prints)], "fp long")
    edges = simhash.links(distinct)
    # All pairs within three bits would be more than 300,000; each place keeps a forest.
    assert edges.count() < 68 * len(prints)
    assert all(0 < int(np.bitwise_count(np.uint64((r["a"] ^ r["b"]) & (1 << 64) - 1))) <= 3 for r in edges.collect())
    assert simhash.components(edges).select("root").distinct().count() == 1


def test_every_radius(spark):
    prints = clouds(9, groups=8, n=20, most=7)
    distinct = spark.createDataFrame([(f,) for f in signed(sorted(set(prints)))], "fp long")
    for most in (0, 1, 2, 4):
        found = {r["node"]: r["root"] for r in simhash.components(simhash.links(distinct, most=most)).collect()}
        got = [found.get(f, f) for f in signed(prints)]
        want = slow_components(list(enumerate(prints)), most)
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def near_copies():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(6):
        base = [rnd.choice(words) for _ in range(200)]
        for _ in range(8):
            text = list(base)
            for _ in range(rnd.randint(0, 2)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((rnd.randint(0, 10_000), " ".join(text)))
    return rows + [(5, None), (3, ""), (None, ""), (None, "lonely text without id"), (None, "lonely text without id"), (7, "same id"), (7, "same id"), (7, "another text of this id")]


def test_documents(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1))
    want = slow_components([(i, slow_fingerprint(t)) for i, t in rows])
    expected = sorted(((i, f"{slow_fingerprint(t):016x}", c) for (i, t), c in zip(rows, want, strict=True)), key=repr)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], slow_fingerprint(r["text"])) for r in kept.collect()), key=repr)
    groups = {}
    for (i, t), c in zip(rows, want, strict=True):
        if i == c:
            f = slow_fingerprint(t)
            root = next((k for k in groups if (k ^ f).bit_count() <= 3), f)
            groups.setdefault(root, i)
    assert len(got) == len(groups)
    assert sorted([i for i, _ in got], key=repr) == sorted(groups.values(), key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0
    plain = docs.filter("doc_id > 7").dropDuplicates(["doc_id"])
    assert sorted(r[0] for r in simhash.keep_one(plain).select("doc_id").collect()) == sorted({r[0] for r in simhash.near_duplicates(plain).select("component_id").collect()})
