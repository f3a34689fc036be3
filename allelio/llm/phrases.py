"""Phrase collocations by an FM-index per shard over word ids.

Texts are cut into pieces and words, and the words of one language into shards of about ``SHARD`` ids as they stream by; texts are
never moved. Each shard is written as an index of its ids: the Burrows-Wheeler transforms of the id sequence and
of its reverse, in the order of the first ``DEPTH`` ids, which is all that phrases of ``DEPTH`` words need. A phrase is an interval in both;
one more word to its left is a step in the one and cuts the interval in the other, one more to its right the other way round.
A step is taken for all intervals of a shard at once, and gives every extension with its count.

Phrases go through the shuffle as numbers: a key of 64 bits, a check of 32 more, the count in a shard and the shard. Counts of the shards are summed, and
the smallest shard that holds a frequent phrase is asked for its text, so a phrase is spelled once, however many shards hold it. Most
phrases are rare, so lengths are counted one after the other: all pairs first, then the triples of frequent pairs, then longer phrases all of whose
triples are frequent. What is frequent is marked in a bitmap by its key, 64 bits for a mark, 256 MiB at most. Every frequent phrase is among those
counted, because its parts are at least as frequent; that others are counted too changes no sum. What a shard holds does not grow with the corpus.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelio.llm.common import raw, stage
from allelio.llm.minhash import _mix
from allelio.operators.joins import lookup_join
from allelio.session import scratch_path

#: Words of a phrase at most, occurrences at least, phrases returned per language.
DEPTH, LEAST, TOP = 5, 100, 2000
#: Ids of a shard, about; a task holds twice as many at most in unfinished shards of all languages.
SHARD = 1 << 18
#: Bytes of texts or shards that come to Python together, and of shards that the writer holds; shards (about 3 MB) of a row group, which a
#: reader holds whole.
BATCH_BYTES, GROUP = 8 << 20, 2
#: Bits of a bitmap for a mark, and at most; parts that a language's phrases are ranked in first.
MARK_BITS, MOST_BITS, PARTS = 64, 1 << 31, 64
#: Lengths that are counted together; a length from the last on counts with it.
TURNS = (2, 3, 4)

#: Ends of pieces become a byte that UTF-8 does not have.
_END = 0xFF
_BYTES = bytes(b + 32 if 65 <= b <= 90 else _END if b in b".,;:!?" or 10 <= b <= 13 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """A text's words in order, with ``b"\\xff"`` where a piece ends."""
    return text.translate(_BYTES).replace(b"\xff", b" \xff ").split()


# --- The index of a shard -------------------------------------------------------


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def _after(x: np.ndarray, n: int) -> np.ndarray:
    return np.r_[x[n:], np.zeros(min(n, len(x)), x.dtype)]


def transform(ids: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Burrows-Wheeler transform of ``ids``, suffixes in the order of their first ``depth`` ids."""
    one = ids.astype(np.int64)
    rank, known = one, 1
    while 2 * known <= depth:
        rank = _dense(rank * (int(rank.max()) + 1) + _after(rank, known))
        known *= 2
    while known < depth:
        rank = _dense(rank * (int(one.max()) + 1) + _after(one, known))
        known += 1
    return ids[np.argsort(rank, kind="stable") - 1]


class Index:
    """Bidirectional index: intervals are arrays ``low`` (forward), ``back`` (reverse) and ``size``."""

    def __init__(self, forward: np.ndarray, reverse: np.ndarray, n_words: int):
        # Id 0 ends a piece.
        self.counts = np.bincount(forward, minlength=n_words + 1)
        self.starts = np.cumsum(self.counts) - self.counts
        self.sides = [(t, self._steps(t)) for t in (forward, reverse)]

    @staticmethod
    def _steps(transformed: np.ndarray) -> np.ndarray:
        """Row of each row's extended suffix: words before its own, and its rank among equal ones."""
        steps = np.empty(len(transformed), np.int64)
        steps[np.argsort(transformed, kind="stable")] = np.arange(len(transformed))
        return steps

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words as intervals: ``word, low, back, size``."""
        word = np.flatnonzero(self.counts[1:]) + 1
        return word, self.starts[word], self.starts[word], self.counts[word]

    def _extend(self, side: int, low: np.ndarray, other: np.ndarray, size: np.ndarray):
        transformed, steps = self.sides[side]
        ends = np.cumsum(size)
        rows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - size), size)
        owner = np.repeat(np.arange(len(low)), size)
        word = transformed[rows].astype(np.int64)
        key = owner * len(self.counts) + word
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        first = np.flatnonzero(np.r_[np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
        n = np.diff(np.r_[first, len(key)])
        owner, word = np.divmod(key[first], len(self.counts))
        inside = first - (ends - size)[owner]  # occurrences of the phrase with a smaller word on this side
        real = word > 0
        return owner[real], word[real], steps[rows[first]][real], (other[owner] + inside)[real], n[real]

    def left(self, low, back, size):
        """Every phrase with one more word in front: ``owner, word, low, back, size``."""
        return self._extend(0, low, back, size)

    def right(self, low, back, size):
        """Every phrase with one more word behind it, the same way."""
        owner, word, back, low, size = self._extend(1, back, low, size)
        return owner, word, low, back, size


def _keys(hashes: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Hash of each phrase (a row of word ids) from the hashes of its words."""
    key = np.zeros(len(phrase), np.uint64)
    for ids in phrase.T:
        key = _mix(key ^ hashes[ids])
    return key


def _word_hashes(lang: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word of a language, for keys and for checks; those of id 0 are not used."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    found = b"".join(xxhash.xxh3_128_digest(w, seed) for w in words.cast(pa.binary()).to_pylist())
    both = np.frombuffer(bytes(16) + found, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


# --- Jobs over shards -----------------------------------------------------------

_SHARD = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("forward", pa.binary()), ("reverse", pa.binary())])


def _index_shards(size: int, held_most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, count()
        fresh = lambda: (defaultdict(count(1).__next__, {b"\xff": 0}), [np.zeros(1, np.int32)])
        open_: dict[str, tuple] = {}
        held: dict[str, int] = {}

        def close(lang: str) -> pa.RecordBatch:
            vocabulary, parts = open_.pop(lang)
            del held[lang]
            ids = np.concatenate(parts)
            counts = np.bincount(ids, minlength=len(vocabulary))[1:]
            both = [transform(ids).tobytes(), transform(ids[::-1]).tobytes()]
            words = [w.decode("utf-8", "replace") for w in vocabulary if w != b"\xff"]
            return pa.RecordBatch.from_pylist([dict(zip(_SHARD.names, (task + next(number), lang, words, counts.tolist(), *both)))], _SHARD)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                found = words_of(text.as_py())
                if not found:
                    continue
                vocabulary, parts = open_.setdefault(lang, fresh())
                parts.append(np.fromiter(map(vocabulary.__getitem__, (*found, b"\xff")), np.int32, len(found) + 1))
                held[lang] = held.get(lang, 0) + len(parts[-1])
                if held[lang] >= size:
                    yield close(lang)
                elif sum(held.values()) >= held_most:
                    yield close(max(held, key=held.get))
        for lang in list(open_):
            yield close(lang)

    return run


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """One row per shard: ``shard, lang, words`` (id ``i + 1`` is place ``i``), their ``counts``, and both transforms.

    A text is never cut, so one that is longer than ``size`` is a shard of its own.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    schema = "shard long, lang string, words array<string>, counts array<long>, forward binary, reverse binary"
    return docs.select(lang, raw().alias("text")).mapInArrow(_index_shards(size, 2 * size), schema)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Array, Index]]:
    """Each shard: its other columns, its words, its index."""
    for batch in batches:
        for i in range(batch.num_rows):
            words = batch.column("words")[i].values
            sides = [np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in ("forward", "reverse")]
            yield {c: batch.column(c)[i] for c in batch.schema.names}, words, Index(*sides, len(words))


def _phrases(lang: str, words: pa.Array, index: Index, marks: dict[int, np.ndarray], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases of 2, 3 .. ``depth`` words of a shard, all of whose parts of a length with ``marks`` are marked: ``phrase, key, check, n``."""
    hashes, checks = _word_hashes(lang, words)

    def marked(bitmap: np.ndarray, part: np.ndarray) -> np.ndarray:
        place = _keys(hashes, part) & np.uint64(8 * len(bitmap) - 1)
        return bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0

    word, low, back, size = index.words()
    phrase = word[:, None]
    for turn in range(depth - 1):
        owner, more, low, back, size = (index.right if turn % 2 else index.left)(low, back, size)
        phrase = np.c_[phrase[owner], more] if turn % 2 else np.c_[more, phrase[owner]]
        for length, bitmap in marks.items():
            if length <= phrase.shape[1]:
                # The other parts were parts of the shorter phrase.
                ok = marked(bitmap, phrase[:, -length:] if turn % 2 else phrase[:, :length])
                phrase, low, back, size = phrase[ok], low[ok], back[ok], size[ok]
        yield phrase, _keys(hashes, phrase).view(np.int64), _keys(checks, phrase).astype(np.uint32).view(np.int32), size


def phrase_counts(indexed: DataFrame, marks: dict[int, np.ndarray], first: int, last: int) -> DataFrame:
    """``key, check, n, shard``: each shard's phrases of ``first`` to ``last`` words, all of whose marked lengths' parts are marked."""
    shared = indexed.sparkSession.sparkContext.broadcast(marks)
    names = ["key", "check", "n", "shard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words, index in _opened(batches):
            for phrase, *found in _phrases(row["lang"].as_py(), words, index, shared.value, last):
                for at in range(0, len(phrase) if phrase.shape[1] >= first else 0, 1 << 16):
                    some = [pa.array(f[at : at + (1 << 16)]) for f in found]
                    yield pa.RecordBatch.from_arrays([*some, pa.repeat(row["shard"], len(some[0]))], names)

    return indexed.select("shard", "lang", "words", "forward", "reverse").mapInArrow(run, "key long, check int, n long, shard long")


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """Bitmap of the keys of a written table; the number of its bits is a power of two."""
    bits = 1 << 20
    while bits < min(MARK_BITS * frequent.count(), MOST_BITS):
        bits *= 2
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    placed = frequent.select(F.shiftright(place, 16).alias("chunk"), place.bitwiseAND(F.lit(0xFFFF)).cast("int").alias("bit"))

    def mark(chunk: pa.Table) -> pa.Table:
        marks = np.zeros(1 << 16, bool)
        marks[chunk.column("bit").to_numpy()] = True
        return pa.table({"chunk": chunk.column("chunk")[:1], "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    mark.__annotations__ = {"chunk": pa.Table, "return": pa.Table}
    bitmap = np.zeros(bits // 8, np.uint8)
    # At most ``bits / 8`` bytes come to the driver.
    for row in stage(placed.groupBy("chunk").applyInArrow(mark, "chunk long, marks binary"), "bitmap").toLocalIterator():
        bitmap[row["chunk"] << 13 : (row["chunk"] + 1) << 13] = np.frombuffer(row["marks"], np.uint8)
    return bitmap


def frequent_phrases(indexed: DataFrame, least: int, depth: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``key, check, f, shard`` of all phrases of 2 to ``depth`` words that occur ``least`` times, ``shard`` the smallest that holds one, and bitmaps of the shorter ones."""
    marks: dict[int, np.ndarray] = {}
    tables = []
    for first in [t for t in TURNS if t <= depth]:
        last = depth if first == TURNS[-1] else first
        counts = phrase_counts(indexed, marks, first, last)
        # A shard has each phrase once, so counting before the shuffle would only fill the memory of the task.
        summed = counts.repartition("key").groupBy("key", "check").agg(F.sum("n").alias("f"), F.min("shard").alias("shard"))
        tables.append(stage(summed.filter(F.col("f") >= least), "phrases"))
        if first < TURNS[-1]:
            marks = marks | {first: _bitmap(tables[-1])}
    return reduce(DataFrame.unionByName, tables), marks


def _places(keys: np.ndarray, checks: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each ``key`` and ``check`` stands among the sorted ``keys`` and their ``checks``, and whether it does."""
    at = np.searchsorted(keys, key)
    while True:
        here = np.minimum(at, len(keys) - 1)
        same = (at < len(keys)) & (keys[here] == key)
        late = same & (checks[here] != check)
        if not late.any():
            return here, same
        at[late] += 1


def phrase_texts(indexed: DataFrame, found: DataFrame, marks: dict[int, np.ndarray], depth: int) -> DataFrame:
    """``lang, phrase, words, f`` of the phrases in ``found`` (``key, check, f, shard``), each spelled by its shard."""
    shared = indexed.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words, index in _opened(batches):
            wanted = row["wanted"].values
            keys, checks, f = (wanted.field(c).to_numpy(zero_copy_only=False) for c in ("key", "check", "f"))
            for phrase, key, check, _ in _phrases(row["lang"].as_py(), words, index, shared.value, depth):
                place, ok = _places(keys, checks, key, check)
                phrase, place = phrase[ok], place[ok]
                for at in range(0, len(place), 1 << 15):
                    some = phrase[at : at + (1 << 15)]
                    texts = pc.binary_join_element_wise(*[words.take(pa.array(c - 1)) for c in some.T], " ")
                    same = [pa.repeat(row["lang"], len(some)), texts, pa.array(np.full(len(some), some.shape[1], np.int32)), pa.array(f[place[at : at + (1 << 15)]])]
                    yield pa.RecordBatch.from_arrays(same, ["lang", "phrase", "words", "f"])

    # A shard has no more phrases than places, so what is asked of one is bounded.
    asked = found.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("key", "check", "f"))).alias("wanted"))
    rows = lookup_join(indexed.select("shard", "lang", "words", "forward", "reverse"), asked, "shard", stage=True)
    return rows.mapInArrow(run, "lang string, phrase string, words int, f long")


# --- The operator ---------------------------------------------------------------


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows come to Python ``BATCH_BYTES`` at a time in the jobs that run here, whatever a task reads in all."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _written(indexed: DataFrame) -> DataFrame:
    """Shards as a table in row groups of ``GROUP``: writers and readers hold that many, not all shards of a file."""
    spark, path = indexed.sparkSession, scratch_path(indexed.sparkSession, "shards")
    # Without the limit of rows, a row group is not looked at before its hundredth row.
    writer = indexed.write.option("parquet.block.size", BATCH_BYTES).option("parquet.block.row.count.limit", GROUP).option("parquet.page.size.row.check.min", 1)
    with _small_batches(spark):
        writer.option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(indexed.schema).parquet(path)


def frequent(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of words and phrases that occur ``least`` times, and ``lang, n`` (all words)."""
    indexed = _written(shards(docs, size))
    counted = indexed.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("phrase"), F.col("w.counts").alias("n"))
    words = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    totals = indexed.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    with _small_batches(docs.sparkSession):
        longer = phrase_texts(indexed, *frequent_phrases(indexed, least, depth), depth)
        every = words.select("lang", "phrase", F.lit(1).alias("words"), "f").unionByName(longer)
        return stage(every, "frequent"), stage(totals, "totals")


def _joined(parts: str) -> F.Column:
    return F.expr(f"array_join({parts}, ' ')")


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, top: int = TOP, size: int = SHARD) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``depth`` words by score.

    Words are what stands between blanks and tabs within pieces, A-Z in lower case; pieces end at ``.,;:!?`` and line ends. A null language
    counts as ``und``, a null text as empty; documents without words add nothing. A phrase that occurs ``a`` times in
    ``n`` words and is cut into parts of ``l`` and ``r`` occurrences scores ``floor(1000 * a * n / (l * r))`` at its worst cut, the
    first of equal ones. Phrases inside a longer one as frequent are left out. Equal scores go by ``a``, then by the
    phrase's bytes, so ranks are unique. Repeated rows count as often as they are there; ids and other columns are not
    read. Very long texts are read whole. An empty table gives no rows.
    """
    known, totals = frequent(docs, least, depth, size)
    keys = ["lang", "phrase"]
    phrases = known.filter("words > 1").select(*keys, "words", F.split("phrase", " ").alias("w"), F.col("f").alias("a"))
    # If a longer phrase is as frequent, so is the one with a single word more.
    parts = F.array(_joined("slice(w, 1, words - 1)"), _joined("slice(w, 2, words - 1)"))
    inside = phrases.filter("words > 2").select("lang", F.explode(parts).alias("phrase"), "a")
    inside = inside.groupBy(*keys).agg(F.max("a").alias("longer"))
    kept = lookup_join(phrases, inside, keys, "left", stage=True).filter("longer IS NULL OR longer < a")
    cuts = kept.select(*keys, "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(*keys, "a", "k", _joined("slice(w, 1, k)").alias("first"), _joined("slice(w, k + 1, words - k)").alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = lookup_join(cuts, known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part], stage=True)
    cuts = lookup_join(cuts, totals, "lang", stage=True)
    exact = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {exact('a')} * {exact('n')}) div ({exact('l')} * {exact('r')})")
    worst = cuts.withColumn("score", score).groupBy(*keys, "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = worst.select(*keys, "a", "cut.l", "cut.r", "n", "cut.score")
    # A language may hold most phrases: its best are found in parts first.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parted = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
