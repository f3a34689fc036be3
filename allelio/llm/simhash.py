"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into segments. Two fingerprints that differ in at most ``k`` bits differ in at most
``k // segments`` bits of some segment, so it is enough to look up, per segment, every value within that radius: each
distinct fingerprint is stored under its own segment values and asks for all values in the small balls around them. Rows that
meet under one (segment, value) are candidates; complete distances decide.

Groups of copies can be huge, so pairs are never listed. Equal fingerprints are one row from the start. Within one value a
task keeps only a spanning forest of the links it finds. A value with more rows than a task should compare is cut
again: its rows are hashed by a further segment of the remaining bits in the same way, until the remaining bits alone
bound the rows. Links then shrink to components by label propagation over written tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelio.llm.common import LOWER, per_text, raw, stage
from allelio.operators.joins import lookup_join

SHINGLE, MOST_BITS = 3, 3
#: Rows under one value that a task compares directly; beyond it they are hashed by a further segment.
DIRECT = 2048
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 (seed 42) of a text's shingles; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = min(shingle, len(words)) - 1
    stops = ends[first:].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(line[a:b], 42) for a, b in zip(starts, stops)], np.uint64, len(stops))  # noqa: B905
    counts = np.zeros((8, 8), np.int64)  # by bit of a byte, then byte
    for at in range(0, len(hashes), 255):  # 255 ones fit a byte
        some = hashes[at : at + 255]
        for bit in range(8):
            counts[bit] += np.frombuffer((some >> np.uint64(bit) & _LANES).sum(dtype=np.uint64).astype("<u8").tobytes(), np.uint8)
    majority = 2 * counts > len(hashes)
    return sum(1 << (8 * byte + bit) for bit, byte in zip(*np.nonzero(majority), strict=True))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """``doc_id, fp`` (long with the fingerprint's bits), one row per row of ``docs``; null texts count as empty."""

    def one(data: bytes) -> tuple:
        return (int(np.uint64(fingerprint(data, shingle)).astype(np.int64)),)

    return docs.select("doc_id", per_text(one, ["fp"], [pa.int64()], "fp long")(raw(text))["fp"].alias("fp"))


def _segments(bits: list[int], n: int) -> list[list[int]]:
    size, more = divmod(len(bits), n)
    out, at = [], 0
    for i in range(n):
        out.append(bits[at : at + size + (i < more)])
        at += size + (i < more)
    return [s for s in out if s]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _ball(bits: list[int], radius: int) -> np.ndarray:
    """Flips of up to ``radius`` of the bits, the empty flip first."""
    return np.array([_mask(list(c)) for r in range(radius + 1) for c in combinations(bits, r)], np.uint64)


def _mix(path: np.ndarray, number: int, value: np.ndarray) -> np.ndarray:
    """Name of a place in the table: the place above it, a segment's number and a value."""
    with np.errstate(over="ignore"):
        x = (path ^ np.uint64(0x9E3779B97F4A7C15) * np.uint64(number + 1)) * np.uint64(0xBF58476D1CE4E5B9) + value
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(29)


class Level:
    """One level of the table: which bits its segments cover, given the bits that the levels above have used."""

    def __init__(self, depth: int, most: int):
        self.most = most
        free = list(range(64))
        self.chosen: list[list[int]] = [free]
        for _ in range(depth):
            self.chosen = [half for rest in self.chosen for half in self._rest(rest)]
        self.segments = [(i, s, self._radius(r)) for i, r in enumerate(self.chosen) for s in self._cut(r)]

    def _cut(self, rest: list[int]) -> list[list[int]]:
        return _segments(rest, 2)

    def _rest(self, rest: list[int]) -> list[list[int]]:
        """What is left beside each segment."""
        return [[b for b in rest if b not in s] for s in self._cut(rest)]

    def _radius(self, rest: list[int]) -> int:
        return self.most // len(self._cut(rest))


_ROW = T.StructType([T.StructField("place", T.LongType()), T.StructField("branch", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("own", T.BooleanType())])
_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), *_ROW.fields])


def _probes(most: int, depth: int):
    """Table rows and probes of each fingerprint at a level; ``branch`` says which bits are still unused."""
    level = Level(depth, most)

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            above = batch.column("place").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            branch = batch.column("branch").to_numpy(zero_copy_only=False)
            own = batch.column("own").to_numpy(zero_copy_only=False).astype(bool)
            below = 0
            for number, (parent, bits, radius) in enumerate(level.segments):
                here = branch == parent
                if here.any():
                    flips = _ball(bits, radius)
                    value = (fp[here] & np.uint64(_mask(bits)))[:, None] ^ flips[None, :]
                    place = _mix(above[here][:, None], number, value).reshape(-1)
                    n = len(flips)
                    # A row is in the table if it was above and its value here is its own.
                    mine = np.repeat(own[here], n) & np.tile(np.arange(n) == 0, int(here.sum()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(place.view(np.int64)), pa.array(np.full(len(place), below, np.int32)), pa.array(np.repeat(fp[here], n).view(np.int64)), pa.array(mine)],
                        ["place", "branch", "fp", "own"],
                    )
                below += 1

    return run


def _forest(fp: np.ndarray, own: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within one value: table rows to table rows and to probes."""
    parent = list(range(len(fp)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in np.flatnonzero(own):
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= most)
        a = root(i)
        for j in near:
            b = root(int(j))
            if a != b:
                parent[b] = a
                if fp[i] != fp[j]:
                    links.append((int(i), int(j)))
    return links


def _links(most: int, direct: int, last: bool):
    """Stream rows sorted by place: links of each place, or its rows again if they are too many to compare here."""

    def emit(pairs, left):
        a = np.array([p[0] for p in pairs], np.uint64).view(np.int64)
        b = np.array([p[1] for p in pairs], np.uint64).view(np.int64)
        none = lambda n, t: pa.nulls(n, t)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none(len(a), pa.int64()), none(len(a), pa.int32()), none(len(a), pa.int64()), none(len(a), pa.bool_())], _EDGE.names)
        if left is not None and len(left[0]):
            n = len(left[0])
            yield pa.RecordBatch.from_arrays([none(n, pa.int64()), none(n, pa.int64()), pa.array(left[0].view(np.int64)), pa.array(left[1]), pa.array(left[2].view(np.int64)), pa.array(left[3])], _EDGE.names)

    def group(place, branch, fp, own):
        if not own.any():
            return [], None
        fp, at = np.unique(fp, return_index=True)  # np.unique keeps the first; table rows sort first within a place
        own = own[at]
        return [(fp[i], fp[j]) for i, j in _forest(fp, own, most)], None

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []  # the place still open
        size = 0
        big = None  # a place that is passed on to the next level
        for batch in batches:
            place, branch, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "branch", "fp"))
            own = batch.column("own").to_numpy(zero_copy_only=False).astype(bool)
            place, fp = place.astype(np.int64).view(np.uint64), fp.astype(np.int64).view(np.uint64)
            if not len(place):
                continue
            starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            stops = np.r_[starts[1:], len(place)]
            # Only the first and the last place of a batch can go on in another batch.
            inner = (starts > 0) & (stops < len(place))
            pairs: list[tuple[int, int]] = []
            two = starts[inner & (stops - starts == 2)]
            two = two[(own[two] | own[two + 1]) & (fp[two] != fp[two + 1])]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= most]
            pairs += list(zip(fp[two], fp[two + 1], strict=True))
            whole = inner & (stops - starts > 2)
            passed = []
            for a, b in zip(starts[whole], stops[whole], strict=True):
                part = (place[a:b], branch[a:b], fp[a:b], own[a:b])
                if b - a > direct and not last:
                    passed.append(part)
                else:
                    pairs += group(*part)[0]
            for a, b in dict.fromkeys([(starts[0], stops[0]), (starts[-1], stops[-1])]):
                part = (place[a:b], branch[a:b], fp[a:b], own[a:b])
                if big is not None and place[a] == big:
                    passed.append(part)
                    continue
                if held and held[0][0][0] != place[a]:
                    pairs += group(*(np.concatenate(x) for x in zip(*held, strict=True)))[0]
                    held, size, big = [], 0, None
                held.append(part)
                size += b - a
                if size > direct and not last:
                    passed += held
                    held, size, big = [], 0, place[a]
            left = tuple(np.concatenate(x) for x in zip(*passed, strict=True)) if passed else None
            yield from emit(pairs, left)
        if held:
            yield from emit(group(*(np.concatenate(x) for x in zip(*held, strict=True)))[0], None)

    return run


def links(distinct: DataFrame, most: int = MOST_BITS, direct: int = DIRECT) -> DataFrame:
    """``a, b``: links between different fingerprints (column ``fp``) that connect all that differ in at most ``most`` bits.

    Every link is within the distance; of a group of mutual neighbours only enough links to connect it are kept.
    """
    rows = distinct.select(F.lit(0).cast("long").alias("place"), F.lit(0).alias("branch"), "fp", F.lit(True).alias("own"))
    found = []
    for depth in range(4):  # 64, 32, 16 and 8 unused bits
        last = depth == 3
        probes = rows.mapInArrow(_probes(most, depth), _ROW)
        sorted_rows = probes.repartition("place").sortWithinPartitions("place", F.desc("own"))
        out = stage(sorted_rows.mapInArrow(_links(most, direct, last), _EDGE), "links")
        found.append(out.filter("a IS NOT NULL").select("a", "b"))
        rows = out.filter("a IS NULL").select("place", "branch", "fp", "own")
        if last or rows.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b``; the root is the component's smallest node.

    Alternates two steps until nothing changes: neighbours larger than a node take its least neighbour, then the smaller ones
    do. Each turn is written, and only the number of changed links comes to the driver.
    """
    links_ = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = links_.select("u", "v").unionByName(links_.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stage(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links_ = stage(small.filter("u <> v").distinct(), "stars")
        state = links_.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = links_.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links_.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _named(prints: DataFrame, most: int) -> DataFrame:
    """``fp, root, component`` of written ``doc_id, fp``: the least id in reach, null if all ids are null."""
    each = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(links(each.select("fp"), most))
    rooted = each.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return stage(rooted.select("fp", "root").join(least, "root").select("fp", "root", "component"), "components")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most ``most`` bits, itself included; null ids never
    name a component unless it has no other, which leaves it null. Null and empty texts have fingerprint 0 and are linked like
    others. Repeated rows stay. Other columns are not read.
    """
    prints = stage(fingerprints(docs, shingle), "fingerprints")
    named = lookup_join(prints, _named(prints, most).drop("root"), "fp", "left")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return named.select("doc_id", hexed.alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """Rows of ``docs``, all columns, one of each component: that with the smallest id.

    Of rows that share this id, and of components without any id, the row with the smallest other values stays. Texts move only
    if the ids to remove are too many to broadcast, or for rows without an id of their own.
    """
    prints = stage(fingerprints(docs, shingle), "fingerprints")
    named = _named(prints, most)
    lost = lookup_join(prints, named, "fp", "left").filter("doc_id <> component").select("doc_id")
    shared = stage(prints.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "shared")
    removed = stage(lost.unionByName(shared).distinct(), "removed")
    kept = lookup_join(docs.filter("doc_id IS NOT NULL"), removed, "doc_id", "left_anti")
    unnamed = docs.filter("doc_id IS NULL")
    if shared.isEmpty() and unnamed.select("doc_id").isEmpty():
        return kept
    # Rows without an id of their own are told apart by their fingerprints.
    odd = lookup_join(docs, shared, "doc_id", "left_semi").unionByName(unnamed)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    of_text = per_text(lambda data: (int(np.uint64(fingerprint(data, shingle)).astype(np.int64)),), ["fp"], [pa.int64()], "fp long")
    printed = odd.select(F.struct(*columns).alias("row"), of_text(raw())["fp"].alias("fp"))
    first = lookup_join(printed, named, "fp").filter(F.col("row.doc_id").eqNullSafe(F.col("component")))
    one = first.groupBy("root").agg(F.min("row").alias("row"))
    return kept.unionByName(one.select("row.*"))
