"""Phrases against a search word by word, matching statistics against brute force, spans of whole and changed templates."""

import random
import re

import pytest

from allelio.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_by_hand(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    found = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in found}))


def some_text(rnd):
    parts = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "GNU", "é", "x7", "free", "this", "software", "is", "CC-BY", "General Public License", "ALL rights"]
    return "".join(rnd.choice(parts) + rnd.choice([" ", "\n", ".", "--", "_"]) for _ in range(rnd.randint(0, 80)))


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_base_places(piece):
    rnd = random.Random(piece)
    for _ in range(400):
        text = some_text(rnd)
        assert licenses.scan_text(text.encode(), piece=piece)[:5] == base_by_hand(text)


def test_matching_statistics():
    rnd = random.Random(3)
    for _ in range(60):
        sequences = [[rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(1, 9))] for _ in range(rnd.randint(1, 4))]
        auto = licenses.Automaton(sequences, len(sequences))
        every = {tuple(s[i:j]): set() for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for t, s in enumerate(sequences):
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    every[tuple(s[i:j])].add((t, j))
        for stretch, ends in every.items():
            state = 0
            for w in stretch:
                state = auto.next[state][auto.numbers[w]]
            assert set(auto.ends[state]) == ends
            assert auto.length[auto.link[state]] < len(stretch) <= auto.length[state]
            want = {t for t, s in enumerate(sequences) if len(s) <= len(stretch) and tuple(s) == stretch[len(stretch) - len(s) :]}
            assert {t for size, t in auto.whole[state] if size <= len(stretch)} == want


def test_spans():
    for label, text in licenses.TEMPLATES:
        n = len(WORD.findall(text.lower()))
        found = licenses.scan_text(f"so here {text} and so on".encode())
        assert (label, 2, 2 + n, 1.0) in [tuple(s.values()) for s in found[7]] and label in found[5].split(",") and found[6] == 1.0
        words = text.split()
        changed = " ".join(words[: len(words) // 2] + ["oddly"] + words[len(words) // 2 :])
        assert label in licenses.scan_text(changed.encode())[5]
    assert licenses.scan_text(b"we are permitted to use this file and the copyright of this work is subject to the terms of use")[5] == ""


@pytest.mark.parametrize("between", ["\n", " some words between ", " x" * licenses.GAP + " "])
def test_repeated_templates_are_spans_of_their_own(between):
    for label, text in licenses.TEMPLATES:
        n, gap = len(WORD.findall(text.lower())), len(WORD.findall(between))
        found = licenses.scan_text(between.join([text] * 50).encode())[7]
        assert [tuple(s.values()) for s in found if s["label"] == label] == [(label, at * (n + gap), at * (n + gap) + n, 1.0) for at in range(50)], label


def test_repeated_changed_templates_are_spans_of_their_own():
    text = dict(licenses.TEMPLATES)["bsd"]
    words = text.split()
    changed = " ".join(words[:10] + ["oddly"] + words[10:])
    found = licenses.scan_text("\n".join([changed] * 20).encode())[7]
    n = len(WORD.findall(changed.lower()))
    assert [(s["first"], s["after"]) for s in found if s["label"] == "bsd"] == [(at * n, at * n + n) for at in range(20)]


def test_rows(spark, rows):
    texts = [None, "", "cc by", "CC BY all rights reserved " * 3000, " ".join(t for _, t in licenses.TEMPLATES) * 50]
    docs = spark.createDataFrame([*enumerate(texts), (None, "cc by"), (2, "cc by")], "doc_id long, text string").selectExpr("*", "'x' as labels", "1 as score")
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        n, *rest = base_by_hand(t)
        r = got[i, n]
        assert [r["n_base"], r["first_word"], r["last_word"], r["base_labels"]] == rest and 0 <= r["score"] <= 1
    assert licenses.scan(docs).count() == len(texts) + 2
    assert licenses.scan(docs.limit(0)).count() == 0
