"""Training-order materialisation: a keyed permutation gives every sequence its global slot, and slots are written in order.

Texts are encoded and cut into sequences of ``LENGTH`` ids. Sequences are numbered without gaps, and a balanced Feistel network
over the next even number of bits permutes the numbers; a result outside the numbers is permuted again until it is inside
(cycle-walking), so slots are a permutation of the numbers under a key and need no sort of random numbers and no table.

Shards hold ``SHARD`` slots each, in order, as rows of a fixed stride of little-endian unsigned 16-bit integers (a vocabulary of
up to 65,536 entries; others are refused): the sequence's length, its ids, zeros up to ``LENGTH``, and two zeros. Slot ``s`` is row ``s % SHARD`` of shard ``s // SHARD``, so a reader
goes on at any slot by one seek. A task that encodes holds some texts and their rows, not all that Spark sends it at a time;
the rows have their final form from then on. Some neighbouring shards are one partition, known from the slot alone, so the
ranges are exact and nothing is sampled. Shards are written in some passes over the rows, and the shuffle of a pass goes before the
next one begins, so on disk stand the rows, the shards, and one pass's share of a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelio.llm import bpe
from allelio.llm.common import raw, stage
from allelio.operators.joins import BROADCAST_BYTES, lookup_join, staged
from allelio.session import scratch_path
from allelio.sources.blocks import open_file
from allelio.sources.readers import _uri
from allelio.sources.stages import remove_stages

#: Ids of a sequence, sequences of a shard (about 17 MB), shards of a partition, rounds of the network, its key.
LENGTH, SHARD, TOGETHER, ROUNDS, KEY = 256, 32_768, 4, 6, 20_240_601
#: Characters of texts that are encoded together.
SOME = 1 << 21
#: Passes in which shards are written, each with an equal part of them.
PASSES = 3
#: Parts that sequences are numbered in.
PARTS = 4096
#: The zero that ends a row is the line separator of Spark's text writer.
STRIDE, END = 2 * (LENGTH + 3), "\0\0\0\0"


def feistel(numbers: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """The slots of ``numbers`` (each below ``total``): a permutation of ``0 .. total - 1``."""
    half = max(1, -(-max(total - 1, 1).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    keys = np.frombuffer(hashlib.blake2b(f"{key}".encode(), digest_size=8 * ROUNDS).digest(), "<u8")

    def turn(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & low)
        return (left << np.uint64(half)) | right

    slots = turn(numbers.astype(np.uint64))
    outside = np.flatnonzero(slots >= total)
    while len(outside):
        slots[outside] = turn(slots[outside])
        outside = outside[slots[outside] >= total]
    return slots.astype(np.int64)


def _rows(parts: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (length, ids, zeros) of all sequences of some texts; each row's text and number."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    counts = -(-sizes // length)
    text = np.repeat(np.arange(len(parts)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    rows = np.zeros((len(text), length + 1), "<u2")
    if len(text):
        ids = np.concatenate(parts)
        if ids.max() > 0xFFFF:
            raise ValueError("an id does not fit in 16 bits")
        rows[:, 0] = np.minimum(sizes[text] - number * length, length)
        inside = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = np.repeat(np.cumsum(counts) - counts, sizes)
        rows[first + inside // length, 1 + inside % length] = ids
    return rows, text, number


def sequences(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """``doc_id, h1, h2, row, seq_no, n_seqs, line`` of all sequences; a text without ids has none.

    ``line`` is a sequence as it stands in a shard, without the end. ``h1, h2`` are hashes of the document, ``row`` is its place in this table, which tells repeated rows apart. Write
    the table before it is used: a second computation may number rows otherwise.
    """
    shared = bpe._shared(docs.sparkSession, path)
    names = ["doc_id", "h1", "h2", "row", "seq_no", "n_seqs", "line"]
    heads = names[:4]

    def some(batch: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        rows, text, number = _rows(bpe.vocabulary_of(shared.value).encode_texts(texts), length)
        counts = np.bincount(text, minlength=len(texts))
        for at in range(0, len(rows), 4096):
            part = slice(at, at + 4096)
            n, size = len(rows[part]), 2 * (length + 1)
            lines = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32)), pa.py_buffer(rows[part].tobytes())])
            of = pa.array(text[part])
            own = [batch.column(c).take(of) for c in heads]
            yield pa.RecordBatch.from_arrays([*own, pa.array(number[part].astype(np.int32)), pa.array(counts[text[part]].astype(np.int32)), lines], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, begin, held = batch.column("text"), 0, 0
            texts: list[str] = []
            for i in range(batch.num_rows):
                texts.append(column[i].as_py().decode("utf-8", "replace"))
                held += len(texts[-1])
                if held >= SOME or i == batch.num_rows - 1:
                    yield from some(batch.slice(begin, len(texts)), texts)
                    texts, begin, held = [], i + 1, 0

    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    keyed = docs.select(
        id_.alias("doc_id"), F.xxhash64(id_, text).alias("h1"), F.xxhash64(text, F.lit(KEY), id_).alias("h2"), F.monotonically_increasing_id().alias("row"), raw(text).alias("text")
    )
    return keyed.mapInArrow(run, "doc_id long, h1 long, h2 long, row long, seq_no int, n_seqs int, line binary")


@contextmanager
def _shuffles_go(spark: SparkSession):
    """Within it, the shuffle files of a query go when it ends, not when the driver's heap is next collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _starts(found: DataFrame) -> tuple[DataFrame, int, int]:
    """``row, start`` of each document (written), their bytes, and the number of sequences."""
    heads = found.filter("seq_no = 0").select("row", "h1", "h2", "n_seqs", F.pmod("h1", F.lit(PARTS)).alias("part"))
    counts = heads.groupBy("part").agg(F.sum("n_seqs").alias("n"))
    # At most PARTS rows.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stage(counts.select("part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "parts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    inside = Window.partitionBy("part").orderBy("h1", "h2", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = heads.withColumn("within", F.coalesce(F.sum("n_seqs").over(inside), F.lit(0))).join(F.broadcast(counts.drop("n")), "part")
    return *staged(placed.select("row", (F.col("before") + F.col("within")).cast("long").alias("start")), "starts"), total


def _with_slots(found: DataFrame, starts: DataFrame, size: int, total: int, key: int) -> DataFrame:
    def slots(numbers: pa.Array) -> pa.Array:
        return pa.array(feistel(numbers.to_numpy(zero_copy_only=False), total, key), pa.int64())

    slots.__annotations__ = {"numbers": pa.Array, "return": pa.Array}
    numbered = lookup_join(found, starts, "row", size=size)
    return numbered.withColumn("slot", F.arrow_udf(slots, "long")(F.col("start") + F.col("seq_no"))).drop("start")


def slotted(found: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """``found`` (written) with its ``slot``, and the number of sequences.

    Documents are numbered, not sequences: a running sum of their sequences in two steps, over parts by hash and within a part, in
    the order of hashes, is the same in every run. Only the keys are shuffled for it; the ids as well once the documents' numbers are too many to
    be broadcast.
    """
    starts, size, total = _starts(found)
    return _with_slots(found, starts, size, total, key), total


def write_shards(rows: DataFrame, total: int, path: str, shard: int = SHARD, together: int = TOGETHER, passes: int = PASSES) -> None:
    """Write ``slot, line`` below ``path``, one file per shard (``shard=<number>``), sorted by slot.

    A partition holds ``together`` neighbouring shards; its number follows from the slot. ``rows`` are read once in each of the ``passes``.
    """
    sharded = rows.select(F.floor(F.col("slot") / shard).cast("long").alias("shard"), "slot", "line")
    n = max(1, -(-total // (shard * together)))
    each = -(-n // passes)
    for first in range(0, n, each):
        last = min(first + each, n)
        some = sharded if n == each else sharded.filter((F.col("shard") >= first * together) & (F.col("shard") < last * together))
        ordered = some.repartitionById(last - first, (F.floor(F.col("shard") / together) - first).cast("int")).sortWithinPartitions("shard", "slot")
        with _shuffles_go(rows.sparkSession):
            ordered.select("shard", F.col("line").cast("string").alias("value")).write.mode("append" if first else "errorifexists").partitionBy("shard").option("lineSep", END).text(path)


def _stored(spark: SparkSession, path: str, length: int, shard: int, start: int, values, schema: str) -> DataFrame:
    """``slot``, ``n_ids`` and what ``values`` makes of each sequence's ids, some rows of a shard at a time."""
    stride = length + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, name in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist()):
                with open_file(_uri(name)) as file:
                    n_rows, odd = divmod(file.size(), 2 * stride)
                    if odd:
                        raise ValueError(f"shard {number} is cut off")
                    first = max(0, start - number * shard)
                    file.seek(2 * stride * first)
                    for at in range(first, n_rows, 4096):
                        data = memoryview(file.read(2 * stride * min(4096, n_rows - at)))
                        n = np.frombuffer(data, "<u2").reshape(-1, stride)[:, 0].astype(np.int32)
                        ends = (n.astype(np.int64) * 2 + 2).tolist()
                        found = [data[i * 2 * stride + 2 : i * 2 * stride + e] for i, e in enumerate(ends)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(n)) + number * shard), pa.array(n), values(found)], ["slot", "n_ids", "value"])

    # Files are only listed by Spark: each is read from its first wanted row on, some rows at a time.
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, shard long").load(path)
    return files.filter(F.col("shard") >= start // shard).select("shard", "path").mapInArrow(run, schema)


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, shard: int = SHARD, start: int = 0) -> DataFrame:
    """``slot, n_ids, ids`` of all slots from ``start`` on; shards before it are not opened."""

    def ids(found: list[memoryview]) -> pa.Array:
        return pa.array([bytes(f) for f in found], pa.binary())

    return _stored(spark, path, length, shard, start, ids, "slot long, n_ids int, value binary").withColumnRenamed("value", "ids")


def read_digests(spark: SparkSession, path: str, length: int = LENGTH, shard: int = SHARD, start: int = 0) -> DataFrame:
    """The same slots with ``sha256`` (32 bytes) in place of the ids."""

    def digests(found: list[memoryview]) -> pa.Array:
        return pa.array([hashlib.sha256(f).digest() for f in found], pa.binary())

    return _stored(spark, path, length, shard, start, digests, "slot long, n_ids int, value binary").withColumnRenamed("value", "sha256")


def materialise(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, key: int = KEY) -> DataFrame:
    """Write all sequences of ``docs`` (``doc_id, text``) in training order below ``path`` and read them back.

    Columns: ``doc_id, seq_no, slot, shard, at_byte, n_ids, ids_sha256`` (of the ids as read), one row per sequence. Null and empty
    texts have no sequence; repeated rows have slots of their own, as have rows without id. Other columns are not read. An
    empty table gives no rows. ``path`` defaults to a new folder below the shared one.
    """
    spark = docs.sparkSession
    path, kept = path or scratch_path(spark, "shards"), scratch_path(spark, "sequences")
    sequences(docs, vocabulary).write.parquet(kept, compression="zstd")
    starts, size, total = _starts(spark.read.parquet(kept))
    if not total:
        return spark.createDataFrame([], "doc_id long, seq_no int, slot long, shard long, at_byte long, n_ids int, ids_sha256 string")
    placed = _with_slots(spark.read.parquet(kept), starts, size, total, key)
    if size > BROADCAST_BYTES:
        # Ids and slots meet by a shuffle; what comes of it takes the place of the first copy.
        first, kept = kept, scratch_path(spark, "slots")
        with _shuffles_go(spark):
            placed.select("doc_id", "seq_no", "slot", "line").write.parquet(kept, compression="zstd")
        remove_stages(spark, first)
        placed = spark.read.parquet(kept)
    manifest = stage(placed.select("doc_id", "seq_no", "slot"), "manifest")
    write_shards(placed, total, path)
    remove_stages(spark, kept)  # the ids are in the shards now
    read = read_digests(spark, path)
    place = [F.floor(F.col("slot") / SHARD).cast("long").alias("shard"), ((F.col("slot") % SHARD) * STRIDE).cast("long").alias("at_byte")]
    # Slots are unique on both sides: no key is hot.
    return manifest.join(read, "slot").select("doc_id", "seq_no", "slot", *place, "n_ids", F.lower(F.hex("sha256")).alias("ids_sha256"))
