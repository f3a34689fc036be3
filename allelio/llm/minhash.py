"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document's set holds its distinct shingles of ``SHINGLE`` words. Its signature keeps ``BITS`` bits of each of ``PLACES`` minima;
the distance of two signatures is the number of places that differ. Places are cut into chunks of five. If two signatures
differ in at most ``MOST`` places, some chunk differs in at most one of them, or the four places left over are equal
(pigeonhole), so rows are stored under each chunk with each one place left out: all pairs within the distance meet, without
exception. A pair whose sets reach the similarity has 9.6 differing places on average; more than ``MOST`` with a chance of
2.4e-6 right at the threshold and less above it.

Links are confirmed on full sets, and never listed pair by pair. Equal sets are one node from the start. First each
group of rows that meet is compared with one row, the one closest to what most of them hold; that connects nearly all copies. What is
left are groups with rows of several components. These are compared again in blocks, only across components, each
pair in the first group it shares; tasks return a spanning forest of the links they confirm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelio.llm.common import LOWER, per_text, raw, stage
from allelio.llm.simhash import components
from allelio.operators.joins import lookup_join

SHINGLE, PERCENT = 5, 85
#: Places of a signature, bits of a place, places of a chunk, and differing places that the join guarantees to find.
PLACES, BITS, CHUNK = 64, 16, 5
CHUNKS, REST = divmod(PLACES, CHUNK)
MOST = 2 * CHUNKS + (REST > 0) - 1
#: Rows that a task compares with one row at a time, rows of a block that are compared with each other, parts of a hot row's group.
TOGETHER, BLOCK, PARTS = 2048, 512, 64

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEEDS = np.frombuffer(hashlib.shake_128(b"minhash").digest(8 * PLACES), "<u8")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * _A
        x = (x ^ x >> np.uint64(27)) * _B
        return x ^ x >> np.uint64(31)


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of the whole word sequence if it is shorter, none without words."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    found = np.full(n, width, np.uint64)
    for i in range(width):
        found = _mix(found ^ each[i : i + n])
    return np.unique(found)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low bits of the least hash of all shingles under each of ``PLACES`` hash functions."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, _mix(shingles[at : at + 4096, None] ^ _SEEDS).min(0))
    return least.astype(np.uint16)


def _print(text: bytes) -> tuple:
    shingles = shingle_set(text)
    if not len(shingles):
        return 0, None, None
    return len(shingles), hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), signature(shingles).tobytes()


def prints(docs: DataFrame) -> DataFrame:
    """``doc_id, n, set_key, sig`` of every row: set size, a digest of the set and its signature; both null for an empty set."""
    fn = per_text(_print, ["n", "set_key", "sig"], [pa.int64(), pa.binary(), pa.binary()], "n long, set_key binary, sig binary")
    return docs.select("doc_id", fn(raw()).alias("p")).select("doc_id", "p.*")


# --- Which rows meet ----------------------------------------------------------


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, PLACES)


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


#: Per key of a row: the places it holds. Chunk after chunk with one place left out each, then the rest.
_HELD = [[c * CHUNK + i for i in range(CHUNK) if i != left] for c in range(CHUNKS) for left in range(CHUNK)]
_HELD += [list(range(PLACES - REST, PLACES))] if REST else []


def keys(sigs: np.ndarray) -> np.ndarray:
    """One key per row and entry of ``_HELD``."""
    out = np.empty((len(sigs), len(_HELD)), np.uint64)
    for number, held in enumerate(_HELD):
        x = np.zeros(len(sigs), np.uint64)
        for p in held:
            x = x << np.uint64(BITS) | sigs[:, p]
        out[:, number] = _mix(x ^ _SEEDS[number])
    return out


def first_shared(differ: np.ndarray) -> np.ndarray:
    """For pairs, given which places differ: the first entry of ``_HELD`` under which they meet, or -1."""
    per_chunk = differ[:, : CHUNKS * CHUNK].reshape(len(differ), CHUNKS, CHUNK)
    errors = per_chunk.sum(2)
    ok = errors <= 1
    chunk = ok.argmax(1)
    at = np.arange(len(differ))
    number = chunk * CHUNK + per_chunk[at, chunk].argmax(1)  # without an error the first place is the one left out
    number = np.where(ok[at, chunk], number, -1)
    if REST:
        number = np.where((number < 0) & ~differ[:, CHUNKS * CHUNK :].any(1), len(_HELD) - 1, number)
    return number


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            under = keys(_signatures(part.column("sig")))
            node = np.repeat(_longs(part.column("node")), under.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(under.reshape(-1).view(np.int64)), pa.array(node)], ["key", "node"])


def _company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those that share it with another row."""
    held: tuple | None = None  # the last row, and whether the one before it had its key
    for batch in batches:
        key, node = _longs(batch.column("key")), _longs(batch.column("node"))
        if not len(key):
            continue
        if held is not None:
            key, node = np.r_[held[0], key], np.r_[held[1], node]
        after = np.r_[key[1:] == key[:-1], False]
        met = after | np.r_[held is not None and held[2], after[:-1]]
        held = (key[-1], node[-1], met[-1])
        kept = np.flatnonzero(met[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(node[kept])], ["key", "node"])
    if held is not None and held[2]:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]])], ["key", "node"])


def meetings(nodes: DataFrame) -> DataFrame:
    """``key, node``: every node (``node, sig``) under every key that it shares with another one."""
    rows = nodes.select("node", "sig").mapInArrow(_stored, "key long, node long")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_company, "key long, node long")


# --- Sorted rows, group by group ----------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch], by: list[str], most: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by ``by``, some whole groups at a time, with the places where groups start and the end.

    A group of more than ``most`` rows comes in parts, of which each but the last has ``most`` rows at least.
    """
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        columns = [_longs(batch.column(c)) for c in by]
        starts = np.r_[0, np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1, batch.num_rows]
        if most is not None and starts[-1] - starts[-2] >= most:
            held = None
        else:
            held, starts = batch.slice(int(starts[-2])), starts[:-1]
        if len(starts) > 1:
            yield batch.slice(0, int(starts[-1])), starts
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _sized(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """True where set sizes allow the similarity."""
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def _usual(sigs: np.ndarray) -> int:
    """The row closest to the values that most rows hold."""
    if len(sigs) < 3:
        return 0
    ordered = np.sort(sigs, axis=0)
    at = np.arange(len(sigs))[:, None]
    begins = np.concatenate([np.ones((1, PLACES), bool), ordered[1:] != ordered[:-1]])
    run = at - np.maximum.accumulate(np.where(begins, at, 0), axis=0)  # how often the value stood before
    value = np.take_along_axis(ordered, run.argmax(0)[None, :], 0)
    return int((sigs != value).sum(1).argmin())


def _stars(together: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch, starts in _runs(batches, ["key"], together):
            key, node, n = (_longs(batch.column(c)) for c in ("key", "node", "n"))
            sigs = _signatures(batch.column("sig"))
            a, size = starts[:-1], np.diff(starts)
            two = a[size == 2]
            two = two[((sigs[two] != sigs[two + 1]).sum(1) <= MOST) & _sized(n[two], n[two + 1]) & (node[two] != node[two + 1])]
            found = [(node[two], node[two + 1])]
            for i, m in zip(a[size != 2].tolist(), size[size != 2].tolist()):
                rows = np.arange(i, i + m)
                here, n_here, sigs_here = node[rows], n[rows], sigs[rows]
                if last is not None and last[0] == key[i]:  # a further part of a group also meets the row chosen before
                    here, n_here, sigs_here = np.r_[last[1], here], np.r_[last[2], n_here], np.concatenate([last[3], sigs_here])
                p = _usual(sigs_here)
                last = (key[i], here[p : p + 1], n_here[p : p + 1], sigs_here[p : p + 1])
                near = here[((sigs_here != sigs_here[p]).sum(1) <= MOST) & _sized(n_here, n_here[p]) & (here != here[p])]
                found.append((np.full(len(near), here[p]), near))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b"])

    return run


# --- Full sets ----------------------------------------------------------------


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingles`` (sorted hashes as bytes) of ``nodes`` (``node, set_key, least``), computed from the documents they name."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("name")
    wanted = nodes.select(named("least"), "node", "set_key")

    def whole(text: bytes) -> tuple:
        shingles = shingle_set(text).tobytes()
        return hashlib.blake2b(shingles, digest_size=16).digest(), shingles

    fn = per_text(whole, ["found", "shingles"], [pa.binary(), pa.binary()], "found binary, shingles binary")
    texts = lookup_join(docs.select(named("doc_id"), raw().alias("text")), wanted.select("name").distinct(), "name", "left_semi", stage=True)
    sets = texts.select("name", fn(F.col("text")).alias("s")).select("name", "s.*")
    found = lookup_join(sets, wanted, "name", stage=True).filter("found = set_key")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def _set(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _against_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``a, part`` with the row of ``a`` itself first: links of ``a`` to the others."""
    here, own = None, None
    for batch in batches:
        a, part = _longs(batch.column("a")), _longs(batch.column("part"))
        b, sets = batch.column("b").to_pylist(), batch.column("shingles")
        found = []
        for i in range(batch.num_rows):
            if b[i] is None:
                here, own = (a[i], part[i]), np.array(_set(sets[i]))
            elif here == (a[i], part[i]) and _similar(own, _set(sets[i])):
                found.append((a[i], b[i]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])


def confirm_stars(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``a, b`` whose sets reach the similarity. A row ``a`` with many ``b`` is sent to ``PARTS`` tasks, once each."""
    parted = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)))
    others = parted.join(sets.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "shingles")
    own = parted.select("a", "part").distinct().join(sets.withColumnRenamed("node", "a"), "a")
    rows = others.unionByName(own.select("a", "part", F.lit(None).cast("long").alias("b"), "shingles"))
    ordered = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(_against_first, "a long, b long")


# --- Across components ---------------------------------------------------------


def _pairs(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group to compare: of different components, near by signature, and met here first.

    All groups at once, each row with the one ``step`` rows behind it.
    """
    key, i, j, own, root, n = (_longs(batch.column(c)) for c in ("key", "i", "j", "own", "root", "n"))
    sigs = _signatures(batch.column("sig"))
    rest = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(key)) - 1  # rows of the group behind a row
    x, step = np.flatnonzero(rest > 0), 1
    while len(x):
        y = x + step
        ok = (root[x] != root[y]) & _sized(n[x], n[y]) & ((i[x] == j[x]) | (own[x] != own[y]))
        a, b = x[ok], y[ok]
        differ = sigs[a] != sigs[b]
        near = differ.sum(1) <= MOST
        a, b, differ = a[near], b[near], differ[near]
        if len(a):
            number = (keys(sigs[a]).view(np.int64) == key[a, None]).argmax(1)
            here = first_shared(differ) == number
            yield a[here], b[here]
        step += 1
        x = x[rest[x] >= step]


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, starts in _runs(batches, ["key", "i", "j"]):
        some = np.zeros(batch.num_rows, bool)
        for a, b in _pairs(batch, starts):
            some[a] = some[b] = True
        if some.any():
            yield batch.filter(pa.array(some))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forest of the confirmed links across components of each block."""
    for batch, starts in _runs(batches, ["key", "i", "j"]):
        node, root, sets = _longs(batch.column("node")), _longs(batch.column("root")), batch.column("shingles")
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        parent: dict[tuple[int, int], tuple[int, int]] = {}

        def top(r: tuple[int, int]) -> tuple[int, int]:
            while parent.get(r, r) != r:
                r = parent[r]
            return r

        links = []
        for some, others in _pairs(batch, starts):
            for x, y in zip(some.tolist(), others.tolist()):
                a, b = top((group[x], root[x])), top((group[y], root[y]))
                if a != b and _similar(_set(sets[x]), _set(sets[y])):
                    parent[b] = a
                    links.append((int(node[x]), int(node[y])))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])


def across(met: DataFrame, nodes: DataFrame, roots: DataFrame, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, b``: confirmed links that join components (``node, root``) wherever rows of several of them meet.

    A key's rows are dealt into blocks, and each two blocks are compared by a task of their own, so no task has more
    than two blocks at a time, however many rows meet.
    """
    rooted = stage(lookup_join(met, roots, "node", "left", stage=True).withColumn("root", F.coalesce("root", "node")), "rooted")
    mixed = rooted.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("least"), F.max("root").alias("most"))
    mixed = mixed.filter("least < most").select("key", F.ceil(F.col("rows") / block).cast("long").alias("blocks"))
    rows = lookup_join(rooted, mixed, "key", stage=True).join(nodes.select("node", "n", "sig"), "node")
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks"))
    placed = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "n", "sig"]
    schema = "key long, i long, j long, own long, node long, root long, n long, sig binary"

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    left = stage(grouped(placed.select(*columns)).mapInArrow(_survivors, schema), "survivors")
    wanted = lookup_join(nodes.select("node", "set_key", "least"), left.select("node").distinct(), "node", "left_semi", stage=True)
    sets = stage(full_sets(docs, wanted), "sets")
    return grouped(left.join(sets, "node").select(*left.columns, "shingles")).mapInArrow(_forest, "a long, b long")


# --- The operator ---------------------------------------------------------------


def links(docs: DataFrame, nodes: DataFrame, together: int = TOGETHER, block: int = BLOCK) -> DataFrame:
    """``a, b``: confirmed links between nodes (``node, set_key, least, n, sig``, written) that connect all that are similar."""
    met = stage(meetings(nodes), "meetings")
    rows = met.join(nodes.select("node", "n", "sig"), "node").select("key", "node", "n", "sig")
    stars = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_stars(together), "a long, b long")
    stars = stage(stars.distinct(), "stars")
    ends = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    wanted = lookup_join(nodes.select("node", "set_key", "least"), ends, "node", "left_semi", stage=True)
    sure = stage(confirm_stars(stars, stage(full_sets(docs, wanted), "sets")), "links")
    return sure.unionByName(stage(across(met, nodes, components(sure), docs, block), "links"))


def near_duplicates(docs: DataFrame, together: int = TOGETHER, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of similarity ``PERCENT`` or more; ``kept`` tells whether it is the
    row's own. Null and empty texts, and those without words, have no shingles and are linked with nothing, not even with
    each other: they keep their own id. Equal sets are linked. Null ids never name a component; a row without id is never
    kept, and its component is null if no row of it has an id. Repeated rows stay. Very long texts are read whole. Other
    columns are not read; an empty table gives no rows.
    """
    printed = stage(prints(docs), "prints")
    some = printed.filter("set_key IS NOT NULL").groupBy("set_key", "n", "sig").agg(F.min("doc_id").alias("least"))
    nodes = stage(some.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = components(links(docs, nodes, together, block))
    # Only nodes that are linked meet the roots; all others name themselves.
    linked = lookup_join(roots, nodes.select("node", "least"), "node", stage=True)
    named = linked.groupBy("root").agg(F.min("least").alias("component"))
    of_node = stage(lookup_join(linked.select("node", "root"), named, "root", stage=True).select("node", "component"), "components")
    of_set = lookup_join(nodes.select("node", "set_key", "least"), of_node, "node", "left")
    of_set = of_set.select("set_key", F.coalesce("component", "least").alias("component"))
    found = lookup_join(printed.select("doc_id", "n", "set_key"), of_set, "set_key", "left", stage=True)
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )
