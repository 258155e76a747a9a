"""Nearest neighbours by vantage-point trees per shard (operator 7).

Rows are dealt to shards of about ``shard_rows`` by hash of their id, queries to
blocks of about ``query_rows``; each pair of shard and block is one group, which
builds the shard's tree and searches it with the whole block at a time.  A tree
node keeps a vantage point and the range of distances of its inner and outer
half; a half is left out for a query when the triangle inequality shows that it
holds nothing as near as the query's worst of ``k``.  ``factor`` divides that
worst distance: 1 is exact, more visits less.

Nearness is the largest inner product.  Candidates get one more coordinate that
brings them all to the same length, so that the largest product is the smallest
distance and the triangle inequality holds.  Returned products are computed from
the original vectors in double precision; ties go to the smaller id.

Nulls and odd rows: vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, take no part; vectors of another length than
a query's are not its candidates.  Repeated equal rows count once; a query never
finds its own id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import written
from waymark.llm.vector_dedup import as_matrix, usable

SHARD_ROWS, QUERY_ROWS, LEAF = 8192, 4096, 64
_NO_ID = np.iinfo(np.int64).max


class Tree:
    """Vantage-point tree over the rows of ``points``; rows keep their numbers."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.root = self._grow(np.arange(len(points)), np.random.default_rng(len(points)))

    def _grow(self, rows: np.ndarray, rng: np.random.Generator):
        if len(rows) <= self.leaf:
            return rows
        at = int(rng.integers(len(rows)))
        vantage, rest = rows[at], np.delete(rows, at)
        d = np.sqrt(np.maximum(((self.points[rest] - self.points[vantage]) ** 2).sum(axis=1), 0))
        middle = np.partition(d, len(d) // 2)[len(d) // 2]
        inside = d < middle
        if not inside.any():
            inside = d <= middle
        if inside.all():
            # All at one distance: no range to tell them apart.
            return rows
        halves = []
        for half in (inside, ~inside):
            halves.append((float(d[half].min()), float(d[half].max()), self._grow(rest[half], rng)))
        return int(vantage), halves


class Search:
    """The ``k`` best rows of a tree for a block of queries, all queries walking together."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, factor: float, leaf: int = LEAF):
        longest = float((x**2).sum(axis=1).max())
        extra = np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))
        self.x, self.ids, self.q, self.q_ids, self.k, self.factor = x, ids, q, q_ids, k, factor
        self.tree = Tree(np.column_stack([x, extra]), leaf)
        self.extra, self.lengths = extra, (q**2).sum(axis=1) + longest
        self.slack = 1e-9 * (1 + np.sqrt(self.lengths) ** 2)
        self.best = np.full((len(q), k), -np.inf)
        self.best_ids = np.full((len(q), k), _NO_ID)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        self._visit(self.tree.root, np.arange(len(self.q)))
        return self.best, self.best_ids

    def _worst(self, at: np.ndarray) -> np.ndarray:
        """Distance of the worst kept row, with room for rounding."""
        squared = self.lengths[at] - 2 * self.best[at, -1] + self.slack[at]
        return np.sqrt(np.maximum(squared, 0)) / self.factor + np.sqrt(self.slack[at])

    def _offer(self, rows: np.ndarray, at: np.ndarray) -> None:
        for i in range(0, len(rows), 512):
            some = rows[i : i + 512]
            rough = self.q[at] @ self.x[some].T
            r, c = np.nonzero((rough >= (self.best[at, -1] - self.slack[at])[:, None]) & (self.q_ids[at][:, None] != self.ids[some][None, :]))
            if not len(r):
                continue
            hit, r_new = np.unique(r, return_inverse=True)
            score = np.full((len(hit), len(some)), -np.inf)
            who = np.full((len(hit), len(some)), _NO_ID)
            score[r_new, c] = np.einsum("ij,ij->i", self.q[at[r]], self.x[some[c]])
            who[r_new, c] = self.ids[some[c]]
            mine = at[hit]
            score, who = np.hstack([self.best[mine], score]), np.hstack([self.best_ids[mine], who])
            order = np.lexsort((who, -score), axis=1)[:, : self.k]
            self.best[mine], self.best_ids[mine] = np.take_along_axis(score, order, 1), np.take_along_axis(who, order, 1)

    def _visit(self, node, at: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, np.ndarray):
            self._offer(node, at)
            return
        vantage, halves = node
        self._offer(np.array([vantage]), at)
        d = np.sqrt(np.maximum(((self.q[at] - self.x[vantage]) ** 2).sum(axis=1) + self.extra[vantage] ** 2, 0))
        near_first = d <= (halves[0][1] + halves[1][0]) / 2
        for nearer, order in ((near_first, (0, 1)), (~near_first, (1, 0))):
            mine, dist = at[nearer], d[nearer]
            for h in order:
                low, high, child = halves[h]
                worst = self._worst(mine)
                open_ = (dist - worst <= high) & (dist + worst >= low)
                self._visit(child, mine[open_])


def _search(k: int, factor: float, leaf: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        out = []
        if shard.num_rows and block.num_rows:
            sizes, q_sizes = (np.array([len(v) for v in t.column("vec")]) for t in (shard, block))
            ids, q_ids = np.asarray(shard.column("id")), np.asarray(block.column("id"))
            for width in np.unique(q_sizes):
                rows, asked = np.flatnonzero(sizes == width), np.flatnonzero(q_sizes == width)
                if not len(rows):
                    continue
                x, q = (as_matrix(t.column("vec").take(pa.array(i)), int(width)) for t, i in ((shard, rows), (block, asked)))
                best, who = Search(x, ids[rows], q, q_ids[asked], k, factor, leaf).run()
                r, c = np.nonzero(who != _NO_ID)
                out.append(pa.table({"query_id": q_ids[asked][r], "id": who[r, c], "score": best[r, c]}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` best, nearest first."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"), is_query.alias("asks"))
    rows = written(rows.filter(usable(F.col("vec")) & F.col("id").isNotNull()).dropDuplicates(["id", "vec"]), "vectors")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // query_rows))
    hashed = lambda salt, of: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(of - 1).cast("bigint")))
    candidates = rows.select("id", "vec", hashed(1, shards).alias("shard"), every(blocks).alias("block"))
    queries = rows.filter("asks").select("id", "vec", hashed(2, blocks).alias("block"), every(shards).alias("shard"))
    found = candidates.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(_search(k, factor, leaf), "query_id bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
