"""Phrases of equal substrings, short rounds, and whole rows against a walk over the sorted documents."""

import hashlib
import random

import numpy as np
import pytest

from allelio.llm import parsing

LETTERS = "abcde é\n𝄞"


def phrases(text):
    """(start, length, name) of all phrases at all heights."""
    points = np.array([ord(c) for c in text], np.uint64)
    out, tail = [], len(points)
    for names, spans, _, _ in parsing.rounds(points, np.zeros(len(points), np.int64)):
        starts = np.cumsum(spans) - spans
        assert spans.sum() == tail
        out.append(set(zip(starts.tolist(), spans.tolist(), names.tolist())))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_rounds_shrink_and_names_tell_texts_apart(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice(LETTERS) for _ in range(3000)) + "z" * 500
    levels = phrases(text)
    assert len(levels) <= 14 and len(levels[-1]) == 1
    for level, after in zip(levels, levels[1:]):
        assert len(after) <= len(level) / 2 + 1
    texts = {}
    for height, level in enumerate(levels):
        for start, size, name in level:
            assert texts.setdefault((height, name), text[start : start + size]) == text[start : start + size]


def test_equal_substrings_share_interior_phrases():
    rnd = random.Random(9)
    common = "".join(rnd.choice(LETTERS) for _ in range(2000))
    for shift in (1, 2, 3, 17, 100):
        other = "".join(rnd.choice(LETTERS) for _ in range(shift))
        a, b = phrases("x" + common), phrases(other + common + "tail" * shift)
        for height in range(4):
            margin = 30 * 3**height
            inner = lambda level, at: {(s - at, n, name) for s, n, name in level if s - at >= margin and s - at + n <= 2000 - margin}
            assert inner(a[height], 1) == inner(b[height], shift)


def test_texts_do_not_depend_on_their_neighbours():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(LETTERS) for _ in range(rnd.choice([0, 1, 2, 3, 9, 500]))) for _ in range(60)]
    assert parsing.fingerprints(texts) == [parsing.fingerprints([t])[0] for t in texts] == parsing.fingerprints(texts, 100)
    assert all((f == "") == (t == "") for t, f in zip(texts, parsing.fingerprints(texts)))


def test_likeness_is_exact_for_texts_of_any_length():
    rnd = random.Random(6)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))

    def by_hand(text):
        levels = phrases(text)
        return {(h, name) for h, level in enumerate(levels) for _, size, name in level if size >= parsing.SPAN or len(level) == 1}

    for n in (2_000, 20_000):
        for _ in range(4):
            passage = words(60)
            a, b = (words(n) + " " + passage + " " + words(n) for _ in range(2))
            left, right = by_hand(a), by_hand(b)
            want = len(left & right) / len(left | right)
            assert want > 4e-4
            # Names have 32 bits, so a few of them may meet by chance.
            assert parsing.likeness(*parsing.fingerprints([a, b])) == pytest.approx(want, abs=1e-4)


def test_rows(spark, rows):
    rnd = random.Random(2)
    text = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "dé", "𝄞"]) + str(rnd.randint(0, 99)) for _ in range(rnd.choice([0, 1, 5, 60, 400])))
    docs = [(i * 7 % 1009, text()) for i in range(300)] + [(5000, None), (5001, ""), (None, "no id"), (4000, "x" * 300_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as fingerprint", "1 as range")
    ordered = sorted(docs, key=lambda r: (r[0] is None, r[0]))
    want = []
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        t, after = t or "", after or ""
        n = len(t) // 4
        changed = t[: len(t) - n] + after[:n]
        a, b, c = (parsing.fingerprints([x])[0] for x in (t, changed, after))
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, parsing.likeness(a, b), parsing.likeness(a, c)))
    got = rows(parsing.compare(df.repartition(3)))
    assert got == sorted(want, key=repr)
    long = [r for r in got if r[1] > 1000 and r[0] != 4000]
    assert sum(r[5] > 0.4 for r in long) > 0.9 * len(long) and all(r[6] < 0.3 for r in long)


def test_few_rows(spark):
    schema = "doc_id long, text string"
    assert parsing.compare(spark.createDataFrame([], schema)).count() == 0
    for data in ([(1, "one text")], [(None, "a"), (None, "b")], [(3, "same")] * 4, [(1, None), (2, "b")]):
        got = parsing.compare(spark.createDataFrame(data, schema)).collect()
        assert len(got) == len(data)
    assert parsing.likeness("", "") == 1.0 and parsing.likeness("", parsing.fingerprints(["a"])[0]) == 0.0
