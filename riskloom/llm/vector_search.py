"""Nearest neighbours by vantage-point trees, one per shard (operator 10).

Nearness is the largest inner product.  With every candidate x extended by
``sqrt(M - |x|^2)`` (M: the largest squared norm) and the query by 0, a larger
inner product is a smaller Euclidean distance, so the triangle inequality
holds.  A shard's tree splits its vectors at the median distance from a
vantage point; a query skips the far side if the split lies further off than
``factor`` times its current k-th distance.  Factor one is exact search, a
smaller one skips more.  ``FACTOR`` is one.

Every candidate is in exactly one shard (hash of the id), every query block
meets every shard, and a task holds one shard and one block, whatever the size
of the table.  Scores are summed in the order of the components, in double
precision, on the original vectors; ties go to the smaller id.

Defined results: rows whose id or vector is null, whose vector is empty, zero
or has null or non-finite components take no part; vectors of different
lengths are not compared; repeated ids count once (the smallest vector).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8_192
QUERY_BLOCK = 4_096
LEAF = 128
FACTOR = 1.0


def usable(vector: str) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed component by component, the same for a pair wherever it stands."""
    out = np.zeros((len(queries), len(rows)))
    for d in range(queries.shape[1]):
        out += np.multiply.outer(queries[:, d], rows[:, d])
    return out


class Tree:
    """Vantage-point tree over the extended vectors of one shard."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, largest: float, leaf: int = LEAF) -> None:
        self.ids, self.rows, self.leaf, self.largest = ids, rows, leaf, largest
        extra = np.sqrt(np.maximum(0.0, largest - (rows * rows).sum(axis=1)))
        self.extended = np.column_stack([rows, extra])
        self.root = self.build(np.arange(len(ids)), np.random.default_rng(7))

    def build(self, members: np.ndarray, rng: np.random.Generator):
        if len(members) <= self.leaf:
            return members
        vantage = members[rng.integers(len(members))]
        d = np.sqrt(((self.extended[members] - self.extended[vantage]) ** 2).sum(axis=1))
        split = np.median(d)
        near = d < split
        if not near.any():  # more than half of the vectors are equal to the vantage point
            near = d <= split
            if near.all():
                return members
        return vantage, float(split), float(d[near].max()), self.build(members[near], rng), self.build(members[~near], rng)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = FACTOR):
        """(scores, ids), k columns, best first; missing ones are -inf."""
        self.q_ids, self.q, self.k, self.factor = query_ids, queries, k, factor
        self.q_norm = (queries * queries).sum(axis=1)
        self.q_extended = np.column_stack([queries, np.zeros(len(queries))])
        self.best = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        if len(queries):
            self.visit(self.root, np.arange(len(queries)))
        return self.best, self.found

    def radius(self, active: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far, rounded up a little so that rounding cannot hide a tie."""
        d2 = self.largest + self.q_norm[active] - 2 * self.best[active, -1]
        return np.sqrt(np.maximum(0.0, d2)) * (1 + 1e-9) + 1e-7

    def visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            for at in range(0, len(node), self.leaf):  # a node of equal vectors may be long
                self.take(node[at:at + self.leaf], active)
            return
        vantage, split, inner, near, far = node
        d = np.sqrt(((self.q_extended[active] - self.extended[vantage]) ** 2).sum(axis=1))
        inside = d < split
        first, last = active[inside], active[~inside]
        self.visit(near, first)
        self.visit(far, last)
        self.visit(far, first[split - d[inside] <= self.factor * self.radius(first)])
        self.visit(near, last[d[~inside] - inner <= self.factor * self.radius(last)])

    def take(self, members: np.ndarray, active: np.ndarray) -> None:
        s = products(self.q[active], self.rows[members])
        s[self.q_ids[active][:, None] == self.ids[members][None, :]] = -np.inf
        better = (s >= self.best[active, -1][:, None]) & (s > -np.inf)
        rows, cols = better.any(axis=1), better.any(axis=0)
        if not rows.any():
            return
        at = active[rows]
        scores = np.concatenate([self.best[at], s[rows][:, cols]], axis=1)
        ids = np.concatenate([self.found[at], np.broadcast_to(self.ids[members[cols]], (len(at), int(cols.sum())))], axis=1)
        ids[scores == -np.inf] = np.iinfo(np.int64).max
        order = np.lexsort((ids, -scores), axis=-1)[:, : self.k]
        self.best[at] = np.take_along_axis(scores, order, axis=1)
        self.found[at] = np.take_along_axis(ids, order, axis=1)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS,
            query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that ``queries`` (a condition on vec_id) picks."""
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                           F.col("embedding").cast("array<double>").alias("embedding"))
            .where(F.col("vec_id").isNotNull() & usable("embedding"))
            .groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
            .withColumn("size", F.size("embedding")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    total = rows.agg(F.count("*").alias("n"), F.count(F.when(queries, 1)).alias("q"), F.max(norm).alias("m")).first()
    shards, blocks = max(1, -(-total["n"] // shard_rows)), max(1, -(-total["q"] // query_block))
    largest = float(total["m"] or 0.0)
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select(place(shards).alias("shard"), all_of(blocks).alias("block"), "size", F.lit(False).alias("asks"),
                             "vec_id", "embedding")
    asking = rows.where(queries).select(all_of(shards).alias("shard"), place(blocks).alias("block"), "size",
                                        F.lit(True).alias("asks"), "vec_id", "embedding")

    def work(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("vec_id"))
        asks = np.asarray(table.column("asks").combine_chunks().to_numpy(zero_copy_only=False), dtype=bool)
        flat = table.column("embedding").combine_chunks()
        data = np.asarray(flat.flatten()).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        own, ask = order[~asks[order]], order[asks[order]]
        if not len(own) or not len(ask):
            return pa.table({n: pa.array([], t) for n, t in (("query_id", pa.int64()), ("vec_id", pa.int64()),
                                                              ("score", pa.float64()))})
        scores, found = Tree(ids[own], data[own], largest).search(ids[ask], data[ask], k, factor)
        good = scores > -np.inf
        return pa.table({"query_id": np.broadcast_to(ids[ask][:, None], scores.shape)[good], "vec_id": found[good],
                         "score": scores[good]})

    hits = (candidates.unionAll(asking).groupBy("shard", "block", "size")
            .applyInArrow(work, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
