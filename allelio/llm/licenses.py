"""License scan by matching statistics of a generalised suffix automaton over the words of license templates.

The automaton holds every stretch of words of every template. A text's words are streamed through it; after each word the
state tells the longest stretch of any template that ends there (the matching statistic). Base phrases are templates of
their own, found wherever the statistic reaches their length. Long matches that cannot be extended are anchors; anchors of
one template that lie in order and near each other are chained, and a chain that covers enough of its template is a span.

Texts are cut into pieces at word boundaries, so besides the text itself memory is constant.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from allelio.llm.common import per_text, raw

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Sentences by which public licenses are recognised, and their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike International License"),
    ("cc-by-text", "This work is licensed under a Creative Commons Attribution International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)

#: Words of the shortest anchor; words that may lie between two anchors of a chain; share of a template that a span covers.
ANCHOR, GAP, COVER = 3, 12, 0.6
#: Bytes of a piece of text.
PIECE = 1 << 20

#: A-Z become a-z; ASCII other than letters and digits separates words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; none is cut in two."""
    open_ = b""
    for at in range(0, len(text), piece):
        part = open_ + text[at : at + piece].translate(_WORD_BYTES)
        cut = part.rfind(b" ") + 1
        if at + piece >= len(text):
            cut = len(part)
        open_ = part[cut:]
        yield part[:cut].split()


class Automaton:
    """Generalised suffix automaton over sequences of word numbers.

    ``ends[s]`` lists the places (template, words up to there) at which the stretches of state ``s`` end, ``whole[s]`` the templates
    of ``phrases`` that are suffixes of its stretches, with their lengths.
    """

    def __init__(self, sequences: list[list[bytes]], phrases: int):
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set[tuple[int, int]]] = [set()]
        for t, sequence in enumerate(sequences):
            last = 0
            for word in sequence:
                last = self._extend(last, self.numbers.setdefault(word, len(self.numbers)), own)
            state = 0
            for k, word in enumerate(sequence):
                state = self.next[state][self.numbers[word]]
                own[state].add((t, k + 1))
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:
            own[self.link[s]] |= own[s]
        self.ends = [tuple(sorted(o)) for o in own]
        self.whole: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        homes: dict[int, list[tuple[int, int]]] = {}
        for t in range(phrases):
            state = 0
            for word in sequences[t]:
                state = self.next[state][self.numbers[word]]
            homes.setdefault(state, []).append((len(sequences[t]), t))
        for s in reversed(order):
            self.whole[s] = (*homes.get(s, ()), *self.whole[self.link[s]])

    def _state(self, length: int, own: list[set[tuple[int, int]]]) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        own.append(set())
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int, own: list[set[tuple[int, int]]]) -> int:
        """A state for those stretches of ``q`` that end where ``p`` goes on with ``c``."""
        half = self._state(self.length[p] + 1, own)
        self.next[half], self.link[half], self.link[q] = dict(self.next[q]), self.link[q], half
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = half
            p = self.link[p]
        return half

    def _extend(self, last: int, c: int, own: list[set[tuple[int, int]]]) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, c, known, own)
        state, p = self._state(self.length[last] + 1, own), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q, own)
        return state


class Scanner:
    """What one text's words give: places of phrases and covered spans."""

    def __init__(self, templates: Templates):
        self.t, self.state, self.long, self.at = templates, 0, 0, 0
        self.n_base, self.first, self.last, self.base = 0, None, None, set()
        self.chains: dict[int, list[tuple[int, int, int, int]]] = {}
        self.spans: list[tuple[str, int, int, float]] = []

    def feed(self, some: list[bytes]) -> None:
        auto = self.t.automaton
        step, link, length, whole = auto.next, auto.link, auto.length, auto.whole
        number = auto.numbers.get
        state, long, start = self.state, self.long, self.at
        for i, c in enumerate(map(number, some), start):
            # A word of no template ends all matches; most words are such, or stand alone.
            if c is None:
                if long:
                    if long >= ANCHOR:
                        self._anchor(state, long, i)
                    state = long = 0
                continue
            to = step[state].get(c)
            if to is None:
                if long >= ANCHOR:
                    self._anchor(state, long, i)
                while to is None and state:
                    state = link[state]
                    long = length[state]
                    to = step[state].get(c)
            state, long = to, long + 1
            for size, t in whole[state]:
                if size <= long:
                    self.n_base += 1
                    self.last = i + 1 - size if self.last is None else max(self.last, i + 1 - size)
                    self.first = i + 1 - size if self.first is None else min(self.first, i + 1 - size)
                    self.base.add(self.t.labels[t])
        self.state, self.long, self.at = state, long, start + len(some)

    def _anchor(self, state: int, long: int, end: int) -> None:
        """Extend the chains that the stretch of ``long`` words before word ``end`` may follow, or begin one."""
        for t, k in self.t.automaton.ends[state]:
            if t < self.t.phrases:
                continue
            best = (end - long, end, k, long)
            open_ = []
            for chain in self.chains.get(t, ()):
                begin, till, upto, covered = chain
                if end - long - till > GAP:
                    self._close(t, chain)
                    continue
                open_.append(chain)
                # Words that both anchors hold, in the text or in the template, count once.
                new = min(long, end - till, k - upto)
                if new > 0 and (covered + new, begin) > (best[3], best[0]):
                    best = (begin, end, k, covered + new)
            # Of chains that end at one place of the template the one that covers most goes on; one that covers no more is done.
            for chain in open_:
                if chain[2] == k and chain[3] <= best[3]:
                    self._close(t, chain)
            self.chains[t] = [c for c in open_ if c[2] != k or c[3] > best[3]] + [best]

    def _close(self, t: int, chain: tuple[int, int, int, int]) -> None:
        begin, end, _, covered = chain
        share = covered / self.t.sizes[t]
        if share < COVER:
            return
        label = self.t.labels[t]
        # A chain inside a span of its label is part of it.
        same = [s for s in self.spans[-64:] if s[0] == label and s[1] < end and begin < s[2]]
        if same:
            at = self.spans.index(same[0])
            old = self.spans[at]
            self.spans[at] = (label, min(old[1], begin), max(old[2], end), max(old[3], share))
        else:
            self.spans.append((label, begin, end, share))

    def finish(self) -> tuple:
        if self.long >= ANCHOR:
            self._anchor(self.state, self.long, self.at)
        for t, chains in self.chains.items():
            for chain in chains:
                self._close(t, chain)
        spans = sorted(set(self.spans), key=lambda s: s[1:3] + (s[0],))
        labels = self.base | {s[0] for s in spans}
        score = 1.0 if self.base else max((s[3] for s in spans), default=0.0)
        rows = [{"label": s[0], "first": s[1], "after": s[2], "covered": s[3]} for s in spans]
        return self.at, self.n_base, self.first, self.last, ",".join(sorted(self.base)), ",".join(sorted(labels)), score, rows


class Templates:
    """Base phrases first, then the templates, with their automaton."""

    def __init__(self, base: tuple[tuple[str, str], ...], templates: tuple[tuple[str, str], ...]):
        texts = [p for p, _ in base] + [t for _, t in templates]
        sequences = [[w for some in words(t.encode()) for w in some] for t in texts]
        self.labels = [label for _, label in base] + [label for label, _ in templates]
        self.sizes = [len(s) for s in sequences]
        self.phrases = len(base)
        self.automaton = Automaton(sequences, self.phrases)


@lru_cache(maxsize=4)
def _templates(base: tuple, templates: tuple) -> Templates:
    return Templates(base, templates)


def scan_text(text: bytes, base: tuple = BASE, templates: tuple = TEMPLATES, piece: int = PIECE) -> tuple:
    """Word count, number, smallest and largest start of base places, base labels, all labels, score and spans of one text."""
    scanner = Scanner(_templates(base, templates))
    for some in words(text, piece):
        scanner.feed(some)
    return scanner.finish()


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64()), ("covered", pa.float64())])
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(_SPAN)]
_DDL = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first: long, after: long, covered: double>>"
)


def scan(docs: DataFrame, text: str | Column = "text", base: tuple = BASE, templates: tuple = TEMPLATES) -> DataFrame:
    """``doc_id`` and the columns ``NAMES``, one row per row of ``docs``; no shuffle.

    ``n_base`` counts every place of a base phrase, overlapping ones too. ``spans`` are stretches of words (from ``first`` up to
    before ``after``) whose chained matches cover at least ``COVER`` of a template. ``score`` is 1 if a base phrase is found, else
    the largest share that a span covers, else 0. A null or empty text has no words, empty labels and score 0. Repeated rows and
    null ids are kept as they are; columns other than ``doc_id`` and the text are not read.
    """

    def one(body: bytes) -> tuple:
        return scan_text(body, base, templates)

    found = per_text(one, NAMES, _TYPES, _DDL)
    return docs.select("doc_id", found(raw(text)).alias("_found")).select("doc_id", "_found.*")
