"""Toxicity: a support vector machine over a gap-weighted subsequence kernel of words, with Nyström landmarks.

Two words are alike as far as they share subsequences of three signs; a subsequence that spans more places counts less. So
``id-i*ot`` stays near ``idiot``, and unseen endings of an insult's stem stay near the endings seen. Signs that are neither
letters nor digits are gaps, and the start of a word is a sign too. Landmarks are words of the training documents; the kernel between landmarks, inverted, turns
kernel values into features (Nyström), and a linear machine separates them. Labels belong to documents, of which only some
words are at fault, so the machine is trained on single words in turns: in each labelled document that is toxic the two strongest
words so far are positive, and at most 4,000 common and 2,000 most alike words of the clean documents are negative.

Since kernel, Nyström map and machine are all linear in a word's subsequences, a fitted model is one weight per
subsequence. A document's score comes from its two strongest words, as calibrated on training documents. Sentences and the order
of words do not enter: a phrase that is toxic only as a whole, of words common in clean texts, is not seen.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelio.llm.common import held_out, labelled_sample, per_texts, raw

#: Label rows of either class that a fit uses at most.
PER_CLASS = 1_500
LANDMARKS = 384
DECAY, SPAN = 0.7, 6
#: Evidence at which a word may be a landmark for toxicity (the chance is below one in ten thousand).
CERTAIN = 15.0
ALPHABET = 64
REMEMBERED = 1 << 19
#: Landmarks and subsequences that the kernel multiplies at a time, which bounds its memory for any number and length of words.
COLUMNS, BLOCK = 128, 1 << 14
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Words written letter by letter.
SPELLED = re.compile(r"(?<!\S)\w(?:[^\w\n]{1,3}\w){2,}(?!\S)")
#: Stands before every word, so that stems count for more than the same letters inside a word; texts are split at it.
START = "\x1f"
_OFFSETS = [(a, b) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]


def _sign_table() -> np.ndarray:
    """Sign class of each code point: a-z, digits and the start of a word their own, other letters hashed, 0 for gaps."""
    points = np.arange(1 << 16, dtype=np.int64)
    out = 38 + (points * 2654435761 >> 7) % (ALPHABET - 38)
    out[:0xC0] = 0
    out[97:123] = np.arange(1, 27)
    out[48:58] = np.arange(27, 37)
    out[ord(START)] = 37
    return out


_TABLE = _sign_table()


def _signs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sign classes of all words in one array, and the word that each belongs to."""
    points = np.frombuffer(START.join(["", *words]).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    return _TABLE[points & 0xFFFF], np.repeat(np.arange(len(words)), 1 + np.fromiter(map(len, words), np.int64, len(words)))


def _triples(symbols: np.ndarray, owner: np.ndarray):
    """For each pair of distances: first places, subsequence numbers and weight of the subsequences that are all signs."""
    n, sign = len(symbols), symbols > 0
    for a, b in _OFFSETS:
        if n > b:
            whole = sign[: n - b] & sign[a : n - b + a]
            whole &= sign[b:]
            whole &= owner[: n - b] == owner[b:]
            at = np.flatnonzero(whole)
            yield at, (symbols[at] * ALPHABET + symbols[at + a]) * ALPHABET + symbols[at + b], DECAY ** (b + 1)


def profiles(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subsequences in order of words: (word number, subsequence number, weight), scaled to length one per word.

    A repeated subsequence has several entries; the length counts them apart, so it depends on the word's shape alone.
    """
    symbols, owner = _signs(words)
    found = [(owner[at], code, np.full(len(at), weight)) for at, code, weight in _triples(symbols, owner)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, code, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    row, code, weight = row[order], code[order], weight[order]
    return row, code, weight / np.sqrt(np.bincount(row, weight * weight, len(words)))[row]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel between words and landmarks, some landmarks and some subsequences at a time."""
    out = np.zeros((len(words), len(landmarks)))
    for first in range(0, len(landmarks), COLUMNS):
        some = landmarks[first : first + COLUMNS]
        row, code, weight = profiles(some)
        used, place = np.unique(code, return_inverse=True)
        if len(used):
            dense = np.zeros((len(used), len(some)))
            np.add.at(dense, (place, row), weight)
            _products(words, used, dense, out[:, first : first + COLUMNS])
    return out


def _products(words: list[str], used: np.ndarray, dense: np.ndarray, out: np.ndarray) -> None:
    """Add the products of the words' subsequences with ``dense``, a row for each of ``used``, to ``out``."""
    for at in range(0, len(words), 2000):
        row, code, weight = profiles(words[at : at + 2000])
        place = np.searchsorted(used, code)
        hit = np.flatnonzero(used[np.minimum(place, len(used) - 1)] == code)
        for lo in range(0, len(hit), BLOCK):
            part = hit[lo : lo + BLOCK]
            rows = row[part]
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            out[at + rows[starts]] += np.add.reduceat(dense[place[part]] * weight[part, None], starts, axis=0)


@dataclass
class Model:
    """Weight per subsequence, bias, and the calibration of (strongest, second strongest) to a probability.

    A model that is not ``fitted`` gives every text one score.
    """

    weights: np.ndarray
    bias: float
    calibration: tuple[float, float, float]
    fitted: bool = True

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for at in range(0, len(words), 20_000):
            symbols, owner = _signs(words[at : at + 20_000])
            value, length = np.zeros(len(symbols)), np.zeros(len(symbols))
            for place, code, weight in _triples(symbols, owner):
                value[place] += weight * self.weights[code]
                length[place] += weight * weight
            n = len(words[at : at + 20_000])
            scale = np.sqrt(np.bincount(owner, length, n))
            out[at : at + n] = np.bincount(owner, value, n) / np.where(scale > 0, scale, 1)
        return out + self.bias

    def probability(self, best: np.ndarray, second: np.ndarray) -> np.ndarray:
        a, b, c = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * best + b * second + c, -30, 30)))


def sentences(text: str) -> list[list[str]]:
    """Distinct lower-case words of each sentence; words spelled letter by letter also as one."""
    out = []
    for part in SENTENCE.split(text.lower()):
        words = set(part.split())
        words.update(re.sub(r"\W+", "", found[0]) for found in SPELLED.finditer(part))
        if words:
            out.append(sorted(words))
    return out


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Nesterov's descent."""
    z1 = np.c_[z, np.ones(len(z))]
    weight = weight / weight.sum()
    sign = np.where(y > 0, 1.0, -1.0)
    ridge = np.r_[np.full(z.shape[1], 1e-4), 0]
    size = 2 * np.linalg.eigvalsh((z1 * weight[:, None]).T @ z1)[-1] + 1e-4
    w = ahead = np.zeros(z1.shape[1])
    for k in range(steps):
        slack = np.maximum(0, 1 - sign * (z1 @ ahead))
        new = ahead - (-2 * z1.T @ (weight * sign * slack) + ridge * ahead) / size
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Calibration with slopes of at least zero; clean documents, which are the rule, weigh three times the toxic ones."""
    x1, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    weight = np.where(y > 0, 0.25 / max(1, (y > 0).sum()), 0.75 / max(1, (y <= 0).sum()))
    size = 0.25 * np.linalg.eigvalsh((x1 * weight[:, None]).T @ x1)[-1] + 1e-3
    for _ in range(1500):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        w = w - (x1.T @ (weight * (p - y)) + np.r_[1e-3 * w[:-1], 0]) / size
        w[:-1] = np.maximum(w[:-1], 0)
    return tuple(w.tolist())


def _evidence(toxic_in: np.ndarray, clean_in: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Log-likelihood ratio that a word is commoner in toxic documents, negative for words commoner in clean ones."""
    seen = toxic_in + clean_in
    expected = seen * toxic / max(1, toxic + clean)
    part = lambda o, e: o * np.log(np.where(o > 0, o, 1) / np.maximum(e, 1e-9))
    ratio = 2 * (part(toxic_in, expected) + part(clean_in, seen - expected))
    return np.where(toxic_in > expected, ratio, -ratio)


def _landmarks(vocabulary: list[str], evidence: np.ndarray, clean_in: np.ndarray) -> tuple[list[int], list[int]]:
    """Words surely commoner in toxic documents, each unlike those before it; clean words most like them; common words.

    If no word is surely commoner, those that are commoner at all stand in.
    """
    ranked = np.lexsort((np.arange(len(vocabulary)), -evidence))[: 3 * LANDMARKS]
    pool = [i for i in ranked if evidence[i] >= CERTAIN] or [i for i in ranked if evidence[i] > 0]
    names = [vocabulary[i] for i in pool]
    alike = kernel(names, names)
    chosen: list[int] = []
    for i in range(len(pool)):
        if len(chosen) < LANDMARKS // 2 and (not chosen or alike[i, chosen].max() < 0.8):
            chosen.append(i)
    picked = [pool[i] for i in chosen]
    common = np.flatnonzero(clean_in >= 1)
    common = common[np.lexsort((common, -clean_in[common]))][:8_000]
    near = kernel([vocabulary[i] for i in common], [vocabulary[i] for i in picked]).max(1, initial=0)
    hard = common[np.lexsort((common, -near))][: LANDMARKS // 4]
    return picked, list(dict.fromkeys([*hard.tolist(), *common[: LANDMARKS // 4].tolist()]))


def fit(documents: list[list[list[str]]], y: np.ndarray, turns: int = 3) -> Model:
    """Train on documents given as sentences of words; with one class only, every score is near that class.

    If no word at all is commoner in toxic documents, every score is the share of toxic ones.
    """
    toxic_share = np.clip((y > 0).mean() if len(y) else 0.5, 0.018, 0.982)
    constant = Model(np.zeros(ALPHABET**3), 0.0, (0.0, 0.0, float(np.log(toxic_share / (1 - toxic_share)))), False)
    if len(set(y.tolist())) < 2:
        return constant
    number: dict[str, int] = {}
    held = [np.unique([number.setdefault(w, len(number)) for s in doc for w in s] or [-1]) for doc in documents]
    held = [h[h >= 0] for h in held]
    vocabulary = list(number)
    count = lambda docs: np.bincount(np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64), minlength=len(vocabulary))
    toxic, clean = [h for h, v in zip(held, y, strict=True) if v > 0], [h for h, v in zip(held, y, strict=True) if v <= 0]
    toxic_in, clean_in = count(toxic), count(clean)
    evidence = _evidence(toxic_in, clean_in, len(toxic), len(clean))
    strong, other = _landmarks(vocabulary, evidence, clean_in)
    if not strong:
        return constant
    landmarks = [vocabulary[i] for i in [*strong, *other]]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    use = values > 1e-6 * values.max()
    row, code, value = profiles(landmarks)
    root = vectors[:, use] / np.sqrt(values[use])
    # Evidence ranks the words of a toxic document before there is a machine to do it.
    merit, least = evidence, CERTAIN if evidence.max() >= CERTAIN else 0.0
    negative = np.flatnonzero(clean_in > 0)
    usual = negative[np.lexsort((negative, -clean_in[negative]))][:4_000]
    model = constant
    for _ in range(turns):
        # The positive sentences of a toxic document are those of its two strongest words.
        witness = np.unique(np.concatenate([h[np.lexsort((h, -merit[h]))[:2]] for h in toxic]))
        witness = witness[(merit[witness] >= least) & (evidence[witness] > 0)]
        hard = negative[np.lexsort((negative, -merit[negative]))][:2_000]
        against = np.setdiff1d(np.union1d(usual, hard), witness)
        rows = np.r_[witness, against]
        labels = np.r_[np.ones(len(witness)), np.zeros(len(against))]
        weight = np.r_[toxic_in[witness] / max(1, toxic_in[witness].sum()), np.sqrt(clean_in[against] + 1) / max(1, np.sqrt(clean_in[against] + 1).sum())]
        w, bias = _machine(kernel([vocabulary[i] for i in rows], landmarks) @ root, labels, weight)
        weights = np.bincount(code, value * (root @ w)[row], ALPHABET**3)
        model = Model(weights, bias, (0.0, 0.0, 0.0))
        merit, least = model.margins(vocabulary), 0.0
    top = np.array([np.r_[np.sort(merit[h])[::-1][:2], [bias, bias]][:2] for h in held])
    return Model(model.weights, model.bias, _logistic(top, y))


def train(docs: DataFrame, labels: DataFrame, kept: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Fit on label rows where ``kept`` holds (all, if not given), at most ``per_class`` of either class.

    Only that bounded sample reaches the driver. Without labels every score is 0.5.
    """
    sample = labelled_sample(docs, labels, "toxic", F.lit(True) if kept is None else kept, per_class)
    rows = sample.orderBy("doc_id").toArrow()
    return fit([sentences(t) for t in rows["text"].to_pylist()], rows["label"].to_numpy().astype(float))


class Scorer:
    """Scores texts with one model; margins of words seen before are remembered, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def scores(self, texts: list[str]) -> np.ndarray:
        words = []
        for text in texts:
            found = set((text := text.lower()).split())
            if spelled := SPELLED.findall(text):
                found.update(re.sub(r"\W+", "", s) for s in spelled)
            words.append(found)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list({w for found in words for w in found if w not in known})
        known.update(zip(new, self.model.margins(new).tolist(), strict=True))
        best, second = [], []
        floor = self.model.bias
        for found in words:
            margins = [floor, floor, *map(known.__getitem__, found)]
            best.append(max(margins))
            margins.remove(best[-1])
            second.append(max(margins))
        return self.model.probability(np.array(best), np.array(second))


_SCORERS: dict[int, Scorer] = {}


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Column with the probability that a text is toxic; null and empty texts score as texts without any word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ALPHABET ** 3 weights
    key = hash((model.bias, model.calibration, model.weights.tobytes()))

    def some(texts: list[str]) -> list[tuple]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        return [(s,) for s in _SCORERS[key].scores(texts).tolist()]

    return per_texts(some, ["score"], [pa.float64()], "score double")(raw(text))["score"]


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Labels are learnt from rows whose crc32 of the id as text leaves a remainder by 5; the others are held out. Null ids are
    not held out and stay in the result; null texts count as empty; repeated rows get equal scores. Other columns of
    ``docs`` are not read. An empty table gives an empty result.
    """
    model = train(docs, labels, ~held_out("doc_id", 5, 0))
    scored = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
