"""Exact top-k by inner product, with a ball tree in each shard.

Vectors are dealt into shards of a bounded number of rows; a shard builds a ball tree. A block of queries walks a
tree together: at each node only those go on whose upper bound, the product with the centre plus the query's norm
times the radius, reaches their current k-th score, and the child with the higher bound is visited first. The first
wave sends a query block to one shard; the k-th scores that it finds go with the block into the second wave, to all
other shards, and prune there from the start. Scores are sums of products of integers and exact: where the norms say
that a score may need more than 53 bits, leaves are compared in 64-bit integers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stresslens.llm.common import cut

#: Rows of a shard and of a block of queries, about; rows of a leaf.
SHARD, BLOCK, LEAF = 16384, 2048, 128


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray | None
    children: tuple[Node, Node] | None


def tree(x: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """A ball tree over the rows of x: a node is halved between two points far from each other."""
    rows = np.arange(len(x)) if rows is None else rows
    points = x[rows]
    centre = points.mean(0)
    away = np.sqrt(((points - centre) ** 2).sum(1))
    # the bound must never be too low for rounding
    node = Node(centre, float(away.max()) * (1 + 1e-9) + 1e-6, rows, None)
    if len(rows) <= LEAF or away.max() == 0:
        return node
    a = points[int(away.argmax())]
    from_a = ((points - a) ** 2).sum(1)
    b = points[int(from_a.argmax())]
    side = np.argsort(from_a - ((points - b) ** 2).sum(1), kind="stable")
    half = len(rows) // 2
    node.rows = None
    node.children = (tree(x, rows[side[:half]]), tree(x, rows[side[half:]]))
    return node


#: Below every score.
NONE = -(1 << 63)


class Best:
    """The k best (score, smaller id first) of each query of a block; rows and own tell a query's own row among the vectors."""

    def __init__(self, q: np.ndarray, own: np.ndarray, k: int, least: np.ndarray, wide: bool):
        self.q, self.own, self.k, self.least, self.wide = q.astype(np.float64), own, k, least, wide
        self.exact = q if wide else self.q
        self.norm = np.sqrt((self.q**2).sum(1)) * (1 + 1e-9)
        self.scores = np.full((len(q), k), NONE)
        self.found = np.zeros((len(q), k), np.int64)

    def bound(self, node: Node, who: np.ndarray) -> np.ndarray:
        # never too low for rounding, however large the numbers
        reach = float(np.sqrt((node.centre**2).sum())) + node.radius
        return self.q[who] @ node.centre + self.norm[who] * (node.radius + 1e-12 * reach) + 1e-6

    def walk(self, node: Node, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, who: np.ndarray) -> None:
        who = who[self.bound(node, who) >= self.least[who]]
        if not len(who):
            return
        if node.children:
            a, b = node.children
            first = self.bound(a, who) >= self.bound(b, who)
            for some, order in ((who[first], (a, b)), (who[~first], (b, a))):
                for child in order if len(some) else ():
                    self.walk(child, x, ids, rows, some)
            return
        for at in range(0, len(node.rows), 4096):  # a node of equal rows may be large
            some = node.rows[at : at + 4096]
            self.take(x[some], ids[some], rows[some], who)

    def take(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, who: np.ndarray) -> None:
        s = (self.exact[who] @ x.T).astype(np.int64)
        s[rows[None, :] == self.own[who][:, None]] = NONE
        better = (s >= np.maximum(self.least[who], NONE + 1)[:, None]).any(1)
        who, s = who[better], s[better]
        scores = np.concatenate([self.scores[who], s], 1)
        found = np.concatenate([self.found[who], np.broadcast_to(ids, s.shape)], 1)
        order = np.lexsort((found, -scores - 1), axis=1)[:, : self.k]  # less one: the least number has no opposite
        self.scores[who], self.found[who] = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)
        self.least[who] = np.maximum(self.least[who], self.scores[who, self.k - 1])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.int64).reshape(len(flat), -1)


def top_k(vectors: DataFrame, asked: Column | str, k: int, rows: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of the highest inner product with each query, other than its own row.

    vectors: vec_id, v (array<long>, nothing null). Queries are the rows for which asked is true. Vectors are compared
    with queries of the same number of components. Rows that share a vec_id are different candidates and different
    queries, each answered under that id; a null vec_id is last among ties. Fewer than k candidates are all returned,
    no vectors give no rows. Scores that may not fit 63 bits are refused with an OverflowError.
    """
    if k < 1:
        raise ValueError("k must be positive")
    asked = F.expr(asked) if isinstance(asked, str) else asked
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, e: t + e.cast("double") * e.cast("double")))
    v = cut(vectors.select("vec_id", "v", F.size("v").alias("dim"), F.coalesce(asked, F.lit(False)).alias("asked"), norm.alias("norm")).withColumn("row", F.monotonically_increasing_id()))
    reach = v.agg(F.max("norm").alias("x"), F.max(F.when(F.col("asked"), F.col("norm"))).alias("q")).first()
    most = (reach.x or 0.0) * (reach.q or 0.0)
    if most >= 2.0**62:
        raise OverflowError("scores may need more than 63 bits")
    wide = most >= 2.0**52
    q = cut(v.where("asked").select("row", F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dim")))
    v = v.select("vec_id", "v", "dim", F.col("row").alias("at"))
    shards, blocks = max(1, -(-v.count() // rows)), max(1, -(-q.count() // block))
    v = v.withColumn("shard", F.pmod(F.xxhash64("vec_id", "at"), F.lit(shards)).cast("int"))
    q = q.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks)).cast("int"))
    home = F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("row", "vec_id", "score")})
        x, none = _matrix(left.column("v")), np.iinfo(np.int64).max
        ids = np.asarray(left.column("vec_id").fill_null(none), np.int64)
        best = Best(_matrix(right.column("q")), np.asarray(right.column("row"), np.int64), k, right.column("least").to_numpy().astype(np.int64, copy=True), wide)
        floats = x.astype(np.float64)
        best.walk(tree(floats), x if wide else floats, ids, np.asarray(left.column("at"), np.int64), np.arange(len(best.q)))
        i, j = np.nonzero(best.scores > NONE)
        found = best.found[i, j]
        return pa.table({"row": best.own[i], "vec_id": pa.array(found, mask=found == none), "score": best.scores[i, j]})

    def wave(asked: DataFrame, copies: Column) -> DataFrame:
        """asked: row, q, dim, block, shard, least; copies: the blocks that a vector's shard is needed for."""
        left = v.withColumn("block", F.explode(copies)).groupBy("dim", "shard", "block")
        return left.cogroup(asked.groupBy("dim", "shard", "block")).applyInArrow(search, "row long, vec_id long, score long")

    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    homes = F.filter(every, lambda b: F.pmod(F.xxhash64(b), F.lit(shards)).cast("int") == F.col("shard"))
    nothing = F.lit(NONE).cast("long")
    first = cut(wave(q.select("row", "q", "dim", "block", home.alias("shard"), nothing.alias("least")), homes))
    least = first.groupBy(F.col("row").alias("of")).agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("of", "least")
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != home)
    more = q.join(least, F.col("row") == F.col("of"), "left").select("row", "q", "dim", "block", F.coalesce("least", nothing).alias("least")).withColumn("shard", F.explode(others))
    away = F.filter(every, lambda b: F.pmod(F.xxhash64(b), F.lit(shards)).cast("int") != F.col("shard"))
    found = first.unionByName(wave(more, away)) if shards > 1 else first

    # each shard returns k rows a query at most; their best k are kept in one aggregate
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").isNull().alias("last"), "vec_id")))
    merged = found.groupBy("row").agg(F.slice(best, 1, k).alias("best")).join(q.select(F.col("row").alias("of"), "query_id"), F.col("row") == F.col("of"))
    return merged.select("query_id", F.posexplode("best").alias("i", "b")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component; vectors that are null, empty or hold null or non-finite components are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = embeddings.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where((F.size("embedding") > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))))
    return fine.select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))
