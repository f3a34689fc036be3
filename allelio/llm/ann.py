"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more component that makes all norms equal, so the largest inner product is the nearest vector. Centroids
are fitted on a bounded sample; they alone are in memory, joined to a graph of near neighbours that a beam search walks.
Every vector is written to its nearest list and, if it lies near a boundary, to up to ``COPIES`` lists whose distance is at most
``1 + EDGE`` times the nearest. A query reads the lists whose centroid is at most ``1 + REACH`` times as far as its nearest one.

Equal vectors are indexed once, with the smallest ids that an answer can hold, and lists are cut into blocks of bounded size,
so neither copies of one vector nor a crowded region land in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelio.llm.common import stage
from allelio.operators.joins import lookup_join

#: Neighbours of an answer; one id in so many is a query.
NEAREST, EVERY = 20, 20
#: Rows of the sample the centroids are fitted on, and centroids at most; rows per centroid in a sample smaller than that.
SAMPLE, CENTROIDS, PER_CENTROID = 16_384, 512, 32
#: Lists a vector may be in, and how much farther than its nearest list the others may be.
COPIES, EDGE = 4, 0.1
#: Lists a query reads at least and at most, and how much farther than its nearest list those between may be. Where these
#: hold too few vectors for an answer, it reads on.
LEAST_LISTS, LISTS, REACH = 24, 96, 0.4
#: Edges per centroid in the graph, width of the beam.
DEGREE, BEAM = 24, 128
#: Rows of a block of a list; parts that copies of one vector are ranked in apart.
BLOCK, PARTS = 4096, 64


def usable(vec: Column) -> Column:
    """True for vectors that take part: not null, not empty, all components finite and present, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """``key, vec, ids``: each vector once, with its ``keep`` smallest ids in order.

    An answer of ``keep - 1`` neighbours that leaves out the query itself holds no others, so this loses nothing. Copies are ranked in
    parts first; no task gets all copies of a vector. Vectors count as equal if all components are.
    """
    parts = Window.partitionBy("key", "part").orderBy("vec_id")
    ranked = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS)))
    few = ranked.withColumn("at", F.row_number().over(parts)).filter(F.col("at") <= keep)
    best = few.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).filter(F.col("at") <= keep)
    return best.groupBy("key").agg(F.min("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _kmeans(x: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    """Balanced centroids: distances to a centroid grow with the share of the sample it already has."""
    rng = np.random.default_rng(7)
    centers = x[rng.choice(len(x), k, replace=False)]
    weight = np.zeros(k)
    for _ in range(turns):
        cost = (centers**2).sum(1) - 2 * (x @ centers.T)
        spread = max(float(np.mean(np.abs(cost.min(1) - cost.mean(1)))), 1e-12)
        near = (cost + spread * 0.1 * weight).argmin(1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.choice(len(x), k)])
        weight = count / (len(x) / k) - 1
    return centers


class Centroids:
    """Centroids with their graph."""

    def __init__(self, centers: np.ndarray, norm: float):
        self.centers, self.norm, self.squares = centers, norm, (centers**2).sum(1)
        far = self.squares[:, None] + self.squares - 2 * centers @ centers.T
        np.fill_diagonal(far, np.inf)
        degree = min(DEGREE, len(centers) - 1)
        near = np.argsort(far, axis=1, kind="stable")[:, :degree]
        # The ring of all centroids keeps the graph connected.
        ring = np.stack([(np.arange(len(centers)) + 1) % len(centers), (np.arange(len(centers)) - 1) % len(centers)], 1)
        self.edges = np.concatenate([near, ring], 1)
        self.entries = np.arange(0, len(centers), max(1, len(centers) // 8))

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Vectors with the component that makes norms equal; queries are brought to length one and have none."""
        if query:
            return np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True) * self.norm, np.zeros((len(x), 1))], 1)
        rest = np.maximum(self.norm**2 - (x**2).sum(1), 0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], 1)

    def search(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row the ``most`` nearest centroids that a beam search finds, and their distances; missing ones are infinitely far.

        All rows walk the graph together: each turn opens every row's nearest centroid not yet opened, until the beam holds none.
        """
        n, k = len(x), len(self.centers)
        own = (x**2).sum(1)
        far = np.full((n, k), np.inf)
        opened = np.zeros((n, k), bool)
        far[:, self.entries] = own[:, None] + self.squares[self.entries] - 2 * x @ self.centers[self.entries].T
        live, width = np.arange(n), min(BEAM, k)
        while len(live):
            here = far[live]
            edge = np.partition(here, width - 1, axis=1)[:, width - 1]
            here[opened[live]] = np.inf
            at = here.argmin(1)
            best = here[np.arange(len(live)), at]
            go = np.isfinite(best) & (best <= edge)
            live, at = live[go], at[go]
            opened[live, at] = True
            to = self.edges[at]
            dots = np.einsum("nd,nkd->nk", x[live], self.centers[to])
            far[live[:, None], to] = own[live, None] + self.squares[to] - 2 * dots
        order = np.argsort(far, axis=1, kind="stable")[:, : min(most, k)]
        return order, np.sqrt(np.maximum(np.take_along_axis(far, order, 1), 0))


def fit(vectors: DataFrame) -> Centroids | None:
    """Centroids of a sample of at most ``SAMPLE`` distinct vectors (by a hash of the vector); None for an empty table."""
    stats = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")).first()
    if not stats["n"]:
        return None
    share = min(1.0, 1.2 * SAMPLE / stats["n"])
    part = vectors.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("key", "vec").orderBy("key").limit(SAMPLE)
    x = np.array([r["vec"] for r in part.collect()], np.float64)
    if not len(x):
        return None
    norm = float(np.sqrt(stats["norm"]))
    lifted = np.concatenate([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))[:, None]], 1)
    k = max(1, min(CENTROIDS, len(x) // PER_CENTROID))
    return Centroids(_kmeans(lifted, k), norm)


def _assigned(df: DataFrame, shared, sizes: np.ndarray | None = None, need: int = 0) -> DataFrame:
    """``list`` and the columns of ``df`` (``key, vec`` and more), one row per list a vector is in or a query reads.

    For queries, ``sizes`` has the number of vectors per list, and lists are read until they hold ``need`` at least.
    """
    query = sizes is not None
    least, most, slack = (LEAST_LISTS, LISTS, REACH) if query else (1, COPIES, EDGE)

    def place(vecs: pa.Array) -> pa.Array:
        index: Centroids = shared.value
        found: list[list[int]] = []
        for at in range(0, len(vecs), 2048):
            part = vecs.slice(at, 2048)
            x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
            lists, far = index.search(index.lift(x, query), len(index.centers) if query else most)
            near = far <= far[:, :1] * (1 + slack)
            near[:, :least], near[:, most:] = True, False
            if query:
                near |= np.cumsum(sizes[lists], axis=1) - sizes[lists] < need
            found += [row[ok].tolist() for row, ok in zip(lists, near)]
        return pa.array(found, pa.list_(pa.int32()))

    place.__annotations__ = {"vecs": pa.Array, "return": pa.Array}
    return df.withColumn("lists", F.arrow_udf(place, "array<int>").asNondeterministic()("vec")).withColumn("list", F.explode("lists")).drop("lists")


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on, so that they depend on the two vectors only."""
    return np.cumsum(a * b, axis=1)[:, -1]


FOUND = pa.schema([("query_key", pa.binary()), ("key", pa.binary()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])


def _scan(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The ``k`` best vectors of one block for each query that reads it, with ties at the last place."""
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        matrix = lambda t: np.stack([np.asarray(v, np.float64) for v in t.column("vec").to_pylist()])
        p, ids, keys = matrix(right), right.column("ids").to_pylist(), right.column("key").to_pylist()
        out_q, out_k, out_s, out_i = [], [], [], []
        for at in range(0, left.num_rows, 512):
            part = left.slice(at, 512)
            q, names = matrix(part), part.column("key").to_pylist()
            scores = q @ p.T
            m = min(k, scores.shape[1])
            edge = np.partition(scores, scores.shape[1] - m, axis=1)[:, scores.shape[1] - m]
            # Products of a matrix may be off in the last bits.
            row, col = np.nonzero(scores >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None])
            exact = _dots(q[row], p[col])
            out_q += [names[i] for i in row]
            out_k += [keys[j] for j in col]
            out_i += [ids[j] for j in col]
            out_s += exact.tolist()
        return pa.table([pa.array(c, f.type) for c, f in zip((out_q, out_k, out_s, out_i), FOUND)], schema=FOUND)

    run.__annotations__ = {"left": pa.Table, "right": pa.Table, "return": pa.Table}
    return run


def search(rows: DataFrame, vec: str = "embedding", every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows found for each row whose id is divisible by ``every``.

    The order is by inner product in double precision, then by id. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do rows without id; rows that repeat an id and a vector count once. If vectors differ in
    length, those of one length are searched among themselves. Other columns are not read. An empty table gives no rows.
    """
    spark = rows.sparkSession
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"))
    # Adding zero makes -0.0 and 0.0 one value before the hash.
    plain = plain.filter(F.col("vec_id").isNotNull() & usable(F.col("vec"))).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    keyed = plain.withColumn("key", F.unhex(F.sha2(F.to_json(F.struct("vec")).cast("binary"), 256))).distinct()
    vectors = stage(distinct_vectors(keyed, k + 1), "vectors")
    result = [_of_length(spark, keyed, vectors, r["n"], every, k) for r in vectors.groupBy(F.size("vec").alias("n")).count().orderBy("n").collect()]
    if not result:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = result[0]
    for more in result[1:]:
        out = out.unionByName(more)
    return out


def _of_length(spark, keyed: DataFrame, vectors: DataFrame, n: int, every: int, k: int) -> DataFrame:
    vectors = vectors.filter(F.size("vec") == n)
    index = fit(vectors)
    # At most CENTROIDS vectors and their graph.
    shared = spark.sparkContext.broadcast(index)
    posts = stage(_assigned(vectors, shared), "postings")
    # Lists and their sizes: at most CENTROIDS rows.
    counts = posts.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    sizes = np.zeros(len(index.centers), np.int64)
    for r in counts.collect():
        sizes[r["list"]] = r["n"]
    blocks = F.broadcast(counts.select("list", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")))
    posts = posts.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    asked = keyed.filter((F.size("vec") == n) & (F.col("vec_id") % every == 0)).select("vec_id", "key")
    wanted = stage(asked, "queries")
    queries = vectors.join(wanted.select("key").distinct(), "key", "left_semi").select("key", "vec")
    # A vector is in at most COPIES lists, so these hold k + 1 different ones.
    reads = _assigned(queries, shared, sizes, COPIES * (k + 1)).join(blocks, "list")
    reads = reads.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    left, right = reads.select("list", "block", "key", "vec").groupBy("list", "block"), posts.select("list", "block", "key", "vec", "ids").groupBy("list", "block")
    found = left.cogroup(right).applyInArrow(_scan(k + 1), "query_key binary, key binary, score double, ids array<long>")
    # A vector found in several lists counts once; a query has at most LISTS lists, their blocks and k + 1 vectors (and ties) of each.
    once = found.groupBy("query_key", "key").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    spread = once.select("query_key", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_key").orderBy(F.col("score").desc(), "vec_id")
    top = spread.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
    answers = top.groupBy("query_key").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("best"))
    joined = lookup_join(wanted.select(F.col("vec_id").alias("query_id"), F.col("key").alias("query_key")), answers, "query_key", stage=True)
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    ranked = joined.select("query_id", F.posexplode(others).alias("rank", "found"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "found.vec_id", "found.score")
