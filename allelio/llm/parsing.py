"""Document fingerprints by locally consistent parsing.

A text is a sequence of names, at first its code points. In each round equal neighbours are joined to runs, deterministic coin
tossing gives every name a label below six from the names just before it, and a phrase begins at each local maximum of
the labels. A phrase's name is a hash of its members, so the next round works on a sequence at most half as long. Cuts depend
only on a few names around them: equal substrings of two texts have equal phrases but near their ends, wherever they lie.

The fingerprint keeps the hashes of the names of all phrases, at all heights, of at least ``SPAN`` code points, and that of the
whole text, so it grows with the text; likeness is the share of names that two texts have in common.

Many texts are parsed side by side in arrays; a text's phrases do not depend on the texts beside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelio.llm.common import raw

#: Code points of the shortest phrase that a fingerprint uses; hexadecimal digits of a name.
SPAN, DIGITS = 8, 8
#: Code points parsed side by side; rounds of coin tossing from 64-bit names to labels below six.
BATCH, TOSSES = 1 << 20, 4
#: Ranges of documents per shuffle partition.
RANGES = 4

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (multiply and shift)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _lowest_bit(x: np.ndarray) -> np.ndarray:
    """Place of the lowest set bit; 64 for zero."""
    low = x & (~x + _U(1))
    place = np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1
    return np.where(x == 0, 64, place)


def labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six by coin tossing; neighbours of one text differ. ``first`` marks where texts begin."""
    now = names
    for _ in range(TOSSES):
        before = np.empty_like(now)
        before[0], before[1:] = _U(0), now[:-1]
        # A text's first name is tossed against its own complement of the lowest bit.
        before[first] = now[first] ^ _U(1)
        place = _lowest_bit(now ^ before).astype(_U)
        now = (place << _U(1)) | ((now >> np.minimum(place, _U(63))) & _U(1))
    return now.astype(np.int64)


def cuts(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a phrase begins: at a text's start and at local maxima of the labels, never at its second name."""
    label = labels(names, first)
    low = np.int64(-1)
    before, after = np.empty_like(label), np.empty_like(label)
    before[0], before[1:] = low, label[:-1]
    after[-1], after[:-1] = low, label[1:]
    ends = np.empty_like(first)
    ends[-1], ends[:-1] = True, first[1:]
    after[ends] = low
    second = np.zeros_like(first)
    second[1:] = first[:-1]
    # The last name of a text never stands alone.
    return first | ((label > before) & (label >= after) & ~second & ~ends)


def _joined(names: np.ndarray, begin: np.ndarray, height: int) -> np.ndarray:
    """Names of the phrases that begin at the places ``begin``."""
    inside = np.arange(len(names), dtype=_U) - np.repeat(begin.astype(_U), np.diff(np.append(begin, len(names))))
    salted = _mix(names + _mix(inside * _U(2) + _U(1)))
    return _mix(np.add.reduceat(salted, begin) + _U(height))


def rounds(points: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases after each round: names, code points spanned, number of the text, and whether the phrase is all of it.

    ``points`` are the code points of all texts, ``text`` the number of the text of each, ascending. A text leaves once it is one phrase.
    """
    names, spans, height = _mix(points.astype(_U) + _U(1)), np.ones(len(points), np.int64), 0
    while len(names):
        height += 1
        first = np.empty(len(names), bool)
        first[0], first[1:] = True, text[1:] != text[:-1]
        fresh = first.copy()
        fresh[1:] |= names[1:] != names[:-1]
        begin = np.flatnonzero(fresh)
        if len(begin) < len(names):
            run = np.diff(np.append(begin, len(names))).astype(_U)
            names = np.where(run > 1, _mix(names[begin] ^ _mix(run + _U(height << 40))), names[begin])
            spans, text, first = np.add.reduceat(spans, begin), text[begin], first[begin]
        begin = np.flatnonzero(cuts(names, first))
        names, spans, text = _joined(names, begin, height), np.add.reduceat(spans, begin), text[begin]
        first = np.empty(len(names), bool)
        first[0], first[1:] = True, text[1:] != text[:-1]
        whole = first.copy()
        whole[:-1] &= first[1:]
        yield names, spans, text, whole
        names, spans, text = names[~whole], spans[~whole], text[~whole]


def _signatures(texts: list[str]) -> list[np.ndarray]:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    number = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    found, of = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for names, spans, text, whole in rounds(points, number):
        used = whole | (spans >= SPAN)
        found.append(_mix(names[used]) >> _U(64 - 4 * DIGITS))
        of.append(text[used])
    # Text number and name in one key: a name has half of the bits.
    keys = np.unique((np.concatenate(of).astype(_U) << _U(4 * DIGITS)) | np.concatenate(found))
    owner = (keys >> _U(4 * DIGITS)).astype(np.int64)
    names = (keys & _U((1 << 4 * DIGITS) - 1)).astype(np.uint32)
    return np.split(names, np.searchsorted(owner, np.arange(1, len(texts))))


def signatures(texts: list[str], batch: int = BATCH) -> list[np.ndarray]:
    """Distinct names of each text's phrases, ascending, ``batch`` code points side by side; none for an empty text."""
    out, some, held = [], [], 0
    for t in texts:
        some.append(t)
        held += len(t)
        if held >= batch:
            out += _signatures(some)
            some, held = [], 0
    return out + (_signatures(some) if some else [])


def digits(names: np.ndarray) -> str:
    """A signature as hexadecimal digits, ``DIGITS`` a name."""
    return names.astype(">u4").tobytes().hex()


def fingerprints(texts: list[str], batch: int = BATCH) -> list[str]:
    """The signatures of texts as hexadecimal digits; that of an empty text is empty."""
    return [digits(names) for names in signatures(texts, batch)]


def common(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the names of two signatures that are in both. Two empty ones are alike."""
    # A stable sort merges the two ascending runs.
    names = np.sort(np.concatenate((a, b)), kind="stable")
    both = int(np.count_nonzero(names[1:] == names[:-1]))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def likeness(a: str, b: str) -> float:
    """``common`` of two fingerprints."""
    return common(*(np.frombuffer(bytes.fromhex(f), ">u4").astype(np.uint32) for f in (a, b)))


def edited(text: str, after: str) -> str:
    """The last quarter of a text replaced by the first as many code points of ``after``, or all of them."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def _ranged(docs: DataFrame) -> DataFrame:
    """Rows dealt to ranges of ``doc_id``, sorted; each range is followed by the first row of the next one.

    The ranges begin at quantiles of the ids, which are ids of the table, so the row that follows a range is known before
    anything is shuffled. As many ids as there are ranges reach the driver. Rows of one id are ordered by their text's hash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw().alias("body")).withColumn("order", F.xxhash64("body"))
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / n for k in range(1, n)], 100_000).alias("at"), F.min(F.col("doc_id").cast("long")).alias("least")).first()
    bounds = np.unique(np.array([known["least"], *known["at"]] if known["at"] else [], np.int64))

    def place(ids: pa.Array) -> pa.Array:
        # Rows without id come last.
        held = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        return pa.array(np.maximum(np.searchsorted(bounds, held, "right") - 1, 0), pa.int64())

    place.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    ranges = rows.withColumn("range", F.arrow_udf(place, "long")("doc_id"))
    last = F.lit(max(len(bounds) - 1, 0)).cast("long")
    # The first rows of a range also follow the range before it, those of the first range the last one.
    opens = F.col("doc_id").isin([int(b) for b in bounds]) if len(bounds) <= 64 else F.array_contains(F.lit(bounds.tolist()).cast("array<long>"), F.col("doc_id"))
    before = F.when(F.col("range") == 0, last).otherwise(F.col("range") - 1)
    if not len(bounds):
        opens = F.lit(True)
    copies = F.when(opens, F.array(F.struct("range", F.lit(False).alias("follows")), F.struct(before.alias("range"), F.lit(True).alias("follows"))))
    copies = F.coalesce(copies, F.array(F.struct("range", F.lit(False).alias("follows"))))
    dealt = ranges.withColumn("copy", F.explode(copies)).select("doc_id", "body", "order", "copy.*")
    return dealt.repartition(max(n, 1), "range").sortWithinPartitions("range", "follows", F.col("doc_id").asc_nulls_last(), "order")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with the one after it; the texts of about ``BATCH`` code points are held at a time."""
    held: list[tuple] = []
    size = 0

    def flush(after: str | None) -> pa.RecordBatch:
        texts = [t for _, t in held]
        following = [*texts[1:], after]
        changed = [edited(t, a) for t, a in zip(texts, following)]
        prints = signatures([*texts, after, *changed])
        own, other = prints[: len(texts) + 1], prints[len(texts) + 1 :]
        columns = [
            pa.array([i for i, _ in held], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed], pa.string()),
            pa.array([digits(a) for a in own[:-1]], pa.string()),
            pa.array([digits(b) for b in other], pa.string()),
            pa.array([common(a, b) for a, b in zip(own, other)], pa.float64()),
            pa.array([common(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        ]
        names = [part.split()[0] for part in RESULT.split(", ")]
        return pa.RecordBatch.from_arrays(columns, names)

    now, done = None, False
    for batch in batches:
        columns = [batch.column(c) for c in ("range", "follows", "doc_id", "body")]
        for i in range(batch.num_rows):
            area, follows, doc, body = (c[i].as_py() for c in columns)
            if area != now:
                now, done = area, False
            if done:
                continue
            text = body.decode("utf-8", "replace")
            if held and (follows or size >= BATCH):
                yield flush(text)
                held, size = [], 0
            done = follows
            if not follows:
                held.append((doc, text))
                size += len(text)


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; the columns of ``RESULT``, one row per row of ``docs``.

    The next document is that of the next row in ascending ``doc_id``; rows of one id follow each other by a hash of their text, rows
    without id come last, and the first row follows the last one (a single row follows itself). Null texts are empty, and an
    empty text is like another empty one only. Columns other than ``doc_id`` and ``text`` are not read. Texts are shuffled once.
    """
    return _ranged(docs).select("range", "follows", "doc_id", "body").mapInArrow(_rows, RESULT)
