"""Hard negatives from a GNAT-style multiway hyperplane tree.

Vectors get one more component that makes all norms equal, so a score (an inner product with an anchor) is a distance, and a window of
scores is an annulus around the anchor. A node of the tree has split points far from each other; a vector goes to the
nearest one. Each split point stores the range of its distances to every sibling's subtree, taken over all rows, not only
over the sample that the points come from. A subtree is left out as soon as one split point's range and the window's annulus
cannot meet; leaves that remain are compared exactly, in integers. So nothing is lost, whatever the sample.

Each search is two steps: the anchor's own leaf gives a bound (its fifth positive, its third negative in a window), which
narrows the annulus for the search of all leaves. Equal vectors of one label are indexed once, with the smallest ids that an answer can
hold. Leaves and their anchors are cut into blocks, so a crowded leaf is many tasks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelio.llm.common import stage

#: Anchors are rows whose id is divisible by EVERY; positives of an anchor, negatives of a positive.
EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: A negative's score is at least LOWER and at most UPPER hundredths of its positive's.
LOWER, UPPER = 50, 95
#: Rows of the sample the split points come from, split points of a node, sample rows under which a node is a leaf.
SAMPLE, DEGREE, LEAF = 16_384, 24, 96
#: Rows and anchors of a block of a leaf; parts that copies of one vector are ranked in first.
ROWS, ANCHORS, PARTS = 2048, 1024, 64
#: Squared norms from here on could give scores that no long holds.
MOST_SQUARE = float(1 << 62)
#: Scores below all and above all.
LOW, HIGH = -(1 << 62), 1 << 62


def quantised(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """Distinct ``vec_id, label, q``: components ``floor(256 * x)`` as longs, shorter vectors padded with zeros."""
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vec).cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * 256).cast("double"), 2))
    known = plain.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(finite).filter(square < MOST_SQUARE)
    known = known.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * 256)).alias("q"))
    size = known.agg(F.coalesce(F.max(F.size("q")), F.lit(0)).alias("n")).first()["n"]
    return known.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("q")))).distinct()


def collapsed(points: DataFrame, keep: int) -> DataFrame:
    """``label, q, ids``: each vector once per label, with its ``keep`` smallest ids; copies are ranked in parts first."""
    order = Window.partitionBy("label", "q", "part").orderBy("vec_id")
    few = points.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS))).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= keep)
    best = few.withColumn("at", F.row_number().over(Window.partitionBy("label", "q").orderBy("vec_id"))).filter(F.col("at") <= keep)
    return best.groupBy("label", "q").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), size)


class Tree:
    """Split points of all nodes, their children, and the ranges of distances between them."""

    def __init__(self, sample: np.ndarray, square: float):
        self.square = square  # largest squared norm of all rows
        self.size = sample.shape[1]
        self.points: list[np.ndarray] = []
        #: Per node and split point: a node below, or a leaf as ``-1 - number``.
        self.below: list[list[int]] = []
        self.leaves = 0
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        #: Rows of a leaf, and 64 bits of which some stand for its labels.
        self.rows = self.labels = None
        self._grow(self.lift(sample), np.random.default_rng(11))
        self.rows, self.labels = np.zeros(self.leaves, np.int64), np.zeros(self.leaves, np.uint64)

    def lift(self, q: np.ndarray) -> np.ndarray:
        x = q.astype(np.float64)
        return np.c_[x, np.sqrt(np.maximum(self.square - (x**2).sum(1), 0))]

    def _grow(self, x: np.ndarray, rng) -> int:
        node = len(self.points)
        x = np.unique(x, axis=0)
        k = min(DEGREE, max(1, len(x) // (LEAF // 2)) if node else DEGREE, len(x))
        # Greedy: each next point is the one of some candidates that is farthest from those chosen.
        some = x[rng.choice(len(x), min(len(x), 8 * k), replace=False)]
        chosen, far = [0], _distances(some, some[:1])[:, 0]
        while len(chosen) < k:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _distances(some, some[chosen[-1:]])[:, 0])
        points = some[chosen]
        self.points.append(points)
        self.below.append([])
        self.low.append(np.full((k, k), np.inf))
        self.high.append(np.full((k, k), -np.inf))
        near = _distances(x, points).argmin(1)
        for j in range(k):
            inside = x[near == j]
            if len(inside) >= 2 * LEAF and len(inside) < len(x):
                child = self._grow(inside, rng)
            else:
                self.leaves += 1
                child = -self.leaves
            self.below[node].append(child)
        return node

    def place(self, q: np.ndarray, visit=None) -> np.ndarray:
        """Leaf of each row; ``visit`` gets each node with its rows' distances and nearest split points."""
        x, leaf = self.lift(q), np.zeros(len(q), np.int64)
        open_ = [(0, np.arange(len(q)))]
        while open_:
            node, rows = open_.pop()
            far = _distances(x[rows], self.points[node])
            near = far.argmin(1)
            if visit is not None:
                visit(node, far, near)
            for j, child in enumerate(self.below[node]):
                mine = rows[near == j]
                if len(mine) and child < 0:
                    leaf[mine] = -1 - child
                elif len(mine):
                    open_.append((child, mine))
        return leaf

    def read(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each anchor and leaf: can the leaf hold a score within one of the anchor's windows (columns of ``low``, ``high``)?"""
        x = np.c_[q.astype(np.float64), np.zeros(len(q))]
        both = (x**2).sum(1)[:, None] + self.square
        slack = 1e-6 * np.sqrt(both)
        inner = np.sqrt(np.maximum(both - 2.0 * high, 0)) - slack
        outer = np.sqrt(np.maximum(both - 2.0 * low, 0)) + slack
        empty = low > high
        inner, outer = np.where(empty, np.inf, inner), np.where(empty, -np.inf, outer)
        alive = np.zeros((len(q), self.leaves), bool)
        open_ = [(0, np.arange(len(q)), ~empty)]
        while open_:
            node, rows, windows = open_.pop()
            far = _distances(x[rows], self.points[node])
            for j, child in enumerate(self.below[node]):
                lo, hi = self.low[node][:, j], self.high[node][:, j]
                if lo[0] > hi[0]:
                    continue
                # Any split point's range may tell that no row below is within the annulus.
                reach = (far + hi).min(1)[:, None]
                least = np.maximum(far - hi, lo - far).max(1)[:, None]
                ok = windows & (reach >= inner[rows]) & (least <= outer[rows])
                some = ok.any(1)
                if some.any() and child < 0:
                    alive[rows[some], -1 - child] = True
                elif some.any():
                    open_.append((child, rows[some], ok[some]))
        return alive


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (points**2).sum(1) - 2 * (x @ points.T), 0))


def fit(points: DataFrame) -> Tree | None:
    """Tree of a sample of at most ``SAMPLE`` rows of ``q`` (by a hash of the vector), with empty ranges; None without rows."""
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    stats = points.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("square")).first()
    if not stats["n"]:
        return None
    share = min(1.0, 1.2 * SAMPLE / stats["n"])
    drawn = points.select("q", F.xxhash64("q").alias("h")).distinct().filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = [r["q"] for r in drawn.orderBy("h").limit(SAMPLE).collect()] or [points.first()["q"]]
    return Tree(np.array(sample, np.int64).reshape(len(sample), -1), stats["square"])


def _with_ranges(tree: Tree, placed: DataFrame) -> Tree:
    """The tree with ranges, rows and labels of all rows (``leaf, label, q``); each task sends one row per pair of split points."""
    shared = placed.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        index: Tree = shared.value
        low, high = [x.copy() for x in index.low], [x.copy() for x in index.high]
        rows, labels = np.zeros(index.leaves, np.int64), np.zeros(index.leaves, np.uint64)

        def visit(node: int, far: np.ndarray, near: np.ndarray) -> None:
            for j in np.unique(near):
                mine = far[near == j]
                low[node][:, j] = np.minimum(low[node][:, j], mine.min(0))
                high[node][:, j] = np.maximum(high[node][:, j], mine.max(0))

        for batch in batches:
            if batch.num_rows:
                leaf = index.place(_matrix(batch.column("q"), index.size), visit)
                np.add.at(rows, leaf, 1)
                bits = np.uint64(1) << (batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64) % 64).astype(np.uint64)
                np.bitwise_or.at(labels, leaf, bits)
        out = [(n, i, j, float(low[n][i, j]), float(high[n][i, j]), 0, 0) for n in range(len(low)) for i, j in np.argwhere(low[n] <= high[n]).tolist()]
        out += [(-1, leaf, 0, 0.0, 0.0, int(rows[leaf]), int(labels[leaf].astype(np.int64))) for leaf in np.flatnonzero(rows).tolist()]
        if out:
            types = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["node", "i", "j", "low", "high", "rows", "labels"])

    parts = placed.select("label", "q").mapInArrow(run, "node long, i long, j long, low double, high double, rows long, labels long")
    merged = parts.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows"), F.bit_or("labels").alias("labels"))
    # Bounded by the tree: DEGREE squared per node, and its leaves.
    for r in merged.collect():
        if r["node"] < 0:
            tree.rows[r["i"]], tree.labels[r["i"]] = r["rows"], np.int64(r["labels"]).astype(np.uint64)
        else:
            tree.low[r["node"]][r["i"], r["j"]], tree.high[r["node"]][r["i"], r["j"]] = r["low"], r["high"]
    return tree


_FOUND = pa.schema([("a", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


def _scan(size: int, k: int, same: bool, exact_floats: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The ``k`` best rows of one block in every window of each anchor: of its own label, or of all others."""
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        left, right = left.combine_chunks(), right.combine_chunks()
        get = lambda t, c: t.column(c).to_numpy().astype(np.int64, copy=False)
        kind = np.float64 if exact_floats else np.int64
        q, p = (_matrix(t.column("q").chunk(0), size).astype(kind) for t in (left, right))
        ids = right.column("ids").chunk(0)
        owner = np.repeat(np.arange(len(p)), ids.value_lengths().to_numpy())
        flat, first = ids.flatten().to_numpy(), np.r_[0, np.cumsum(ids.value_lengths().to_numpy())]
        anchor, own, label, other = get(left, "a"), get(left, "vec_id"), get(left, "label"), get(right, "label")
        n_windows = len(left.column("low")[0])
        low, high = _matrix(left.column("low").chunk(0), n_windows), _matrix(left.column("high").chunk(0), n_windows)
        out = []
        for at in range(0, len(q), 256):
            part = slice(at, at + 256)
            scores = (q[part] @ p.T).astype(np.int64)
            allowed = (label[part, None] == other) == same
            for w in range(n_windows):
                ok = allowed & (scores >= low[part, w, None]) & (scores <= high[part, w, None])
                if not ok.any():
                    continue
                m = min(k + 1, scores.shape[1])  # one more, as the anchor itself may be among its label's rows
                value = np.where(ok, scores, LOW - 1)
                edge = np.partition(value, scores.shape[1] - m, axis=1)[:, scores.shape[1] - m, None]
                row, col = np.nonzero(ok & (value >= edge))
                lengths = first[col + 1] - first[col]
                rows = np.repeat(row, lengths)
                spread = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first[col], lengths)
                found, score = flat[spread], np.repeat(scores[row, col], lengths)
                keep = found != own[at + rows]
                rows, found, score = rows[keep], found[keep], score[keep]
                order = np.lexsort((found, -score, rows))
                rows, found, score = rows[order], found[order], score[order]
                begins = np.searchsorted(rows, rows)
                best = np.arange(len(rows)) - begins < k
                out.append((anchor[at + rows[best]], np.full(best.sum(), w, np.int32), score[best], found[best]))
        if not out:
            return _FOUND.empty_table()
        return pa.table([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND)

    run.__annotations__ = {"left": pa.Table, "right": pa.Table, "return": pa.Table}
    return run


class Search:
    """All rows (``leaf, label, q, ids``) under a tree, searched by tables of anchors with windows."""

    def __init__(self, posts: DataFrame, tree: Tree):
        self.posts, self.tree = posts, tree
        self.spark = posts.sparkSession
        self.shared = self.spark.sparkContext.broadcast(tree)

    def _reads(self, anchors: DataFrame, same: bool) -> DataFrame:
        shared = self.shared

        def leaves(q: pa.Array, label: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
            tree: Tree = shared.value
            out: list[list[int]] = []
            n = len(low[0]) if len(low) else 0
            for at in range(0, len(q), 1024):
                part = [c.slice(at, 1024) for c in (q, label, low, high)]
                alive = tree.read(_matrix(part[0], tree.size), _matrix(part[2], n), _matrix(part[3], n))
                if same:
                    bits = np.uint64(1) << (part[1].to_numpy(zero_copy_only=False).astype(np.int64) % 64).astype(np.uint64)
                    alive &= (tree.labels[None, :] & bits[:, None]) > 0
                out += [np.flatnonzero(a).tolist() for a in alive]
            return pa.array(out, pa.list_(pa.int32()))

        leaves.__annotations__ = {"q": pa.Array, "label": pa.Array, "low": pa.Array, "high": pa.Array, "return": pa.Array}
        where = F.arrow_udf(leaves, "array<int>").asNondeterministic()("q", "label", "low", "high")
        return anchors.withColumn("leaves", where).withColumn("leaf", F.explode("leaves")).drop("leaves")

    def best(self, anchors: DataFrame, k: int, same: bool, own: bool) -> DataFrame:
        """``a, w, at, score, vec_id``: the ``k`` best rows in every window ``w`` of each anchor (``a, vec_id, label, q, leaf, low, high``).

        ``own`` searches the anchor's leaf only.
        """
        reads = anchors if own else self._reads(anchors.drop("leaf"), same)
        reads = stage(reads.select("leaf", "a", "vec_id", "label", "q", "low", "high"), "reads")
        # One row per leaf.
        asked = reads.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("ablocks"))
        sizes = [(leaf, -(-int(n) // ROWS)) for leaf, n in enumerate(self.tree.rows) if n]
        blocks = self.spark.createDataFrame(sizes, "leaf int, rblocks int").join(F.broadcast(asked), "leaf")
        blocks = F.broadcast(stage(blocks, "blocks"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = reads.join(blocks, "leaf").withColumn("ablock", F.pmod(F.xxhash64("a"), "ablocks").cast("int")).withColumn("rblock", each("rblocks"))
        right = self.posts.join(blocks, "leaf").withColumn("rblock", F.pmod(F.xxhash64("q", "label"), "rblocks").cast("int")).withColumn("ablock", each("ablocks"))
        key = ["leaf", "rblock", "ablock"]
        pairs = left.select(*key, "a", "vec_id", "label", "q", "low", "high").groupBy(*key).cogroup(right.select(*key, "label", "q", "ids").groupBy(*key))
        scan = _scan(self.tree.size, k, same, self.tree.square < float(1 << 53))
        found = pairs.applyInArrow(scan, "a long, w int, score long, vec_id long")
        order = Window.partitionBy("a", "w").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)


def mine(rows: DataFrame, vec: str = "embedding", every: int = EVERY) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are rows whose id is divisible by ``every``; an anchor's positives are the first ``POSITIVES`` other rows of its label, and each
    positive's negatives the first ``NEGATIVES`` rows of other labels whose score is within ``LOWER`` to ``UPPER`` hundredths of the
    positive's. Higher scores come first, ties by smaller id; scores are inner products of ``floor(256 * x)``.

    Rows without id, label or vector, and those with null or non-finite components take no part, nor do vectors whose squared
    norm reaches 2^62, as their scores would not fit a long. Shorter vectors count as padded with zeros, empty ones too. Rows that repeat id,
    label and vector count once; rows that share an id only are all there, but none is its own anchor's positive or negative.
    Negative and zero scores follow the same rule, which few or no rows meet. Other columns are not read; an empty table
    gives no rows.
    """
    spark = rows.sparkSession
    points = stage(quantised(rows, vec), "points")
    tree = fit(points)
    if tree is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    bare = spark.sparkContext.broadcast(tree)

    def place(q: pa.Array) -> pa.Array:
        return pa.array(bare.value.place(_matrix(q, bare.value.size)).astype(np.int32), pa.int32())

    place.__annotations__ = {"q": pa.Array, "return": pa.Array}
    leaf = F.arrow_udf(place, "int").asNondeterministic()
    posts = stage(collapsed(points, max(POSITIVES, NEGATIVES) + 1).withColumn("leaf", leaf("q")), "posts")
    search = Search(posts, _with_ranges(tree, posts))

    asked = points.filter(F.col("vec_id") % every == 0)
    asked = stage(asked.withColumn("leaf", leaf("q")).withColumn("a", F.monotonically_increasing_id()), "anchors")
    one = lambda c: F.array(F.lit(c).cast("long") if isinstance(c, int) else c)
    near = search.best(asked.withColumns({"low": one(LOW), "high": one(HIGH)}), POSITIVES, same=True, own=True)
    bound = near.filter(F.col("at") == POSITIVES).select("a", F.col("score").alias("bound"))
    # One row per anchor on both sides: no key is hot.
    bounded = asked.join(bound, "a", "left").withColumns({"low": one(F.coalesce("bound", F.lit(LOW).cast("long"))), "high": one(HIGH)}).drop("bound")
    positives = stage(search.best(bounded, POSITIVES, same=True, own=False).select("a", "at", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "positives")

    # Windows of the positives in order; an anchor with fewer has empty windows at the end.
    exact = F.struct(
        F.expr(f"-CAST(floor(CAST(-{LOWER} AS DECIMAL(3, 0)) * CAST(positive_score AS DECIMAL(20, 0)) / 100) AS BIGINT)").alias("low"),
        F.expr(f"CAST(floor(CAST({UPPER} AS DECIMAL(3, 0)) * CAST(positive_score AS DECIMAL(20, 0)) / 100) AS BIGINT)").alias("high"),
    )
    lists = positives.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("at", exact.alias("w")))).alias("ws"))
    pad = F.array_repeat(F.struct(F.lit(1).cast("long").alias("low"), F.lit(0).cast("long").alias("high")), F.lit(POSITIVES) - F.size("ws"))
    lists = lists.select("a", F.concat(F.transform("ws", lambda x: x["w"]), pad).alias("ws"))
    windows = stage(asked.join(lists, "a").select(*asked.columns, F.transform("ws", lambda x: x["low"]).alias("low"), F.transform("ws", lambda x: x["high"]).alias("high")), "windows")
    near = search.best(windows, NEGATIVES, same=False, own=True).filter(F.col("at") == NEGATIVES)
    bound = near.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("bound"))
    narrowed = windows.join(bound, "a", "left").withColumn("low", F.transform("low", lambda x, i: F.greatest(x, F.get(F.array(*[F.col("bound")[j] for j in range(POSITIVES)]), i)))).drop("bound")
    found = search.best(narrowed, NEGATIVES, same=False, own=False)
    found = found.select("a", (F.col("w") + 1).alias("at"), F.col("at").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(positives, ["a", "at"]).join(asked.select("a", F.col("vec_id").alias("anchor_id")), "a")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
