"""Exact nearest chunks by cosine distance, for one query or many.

Every task scores its own vectors against the queries with one matrix product
and keeps ``k`` rows per query, so only tasks x k x queries rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import fixed
from waymark.operators.ordering import keep_first
from waymark.session import rows_if_small

#: Queries that travel with the plan, bytes of a block of queries or a tile of vectors, and scores a task holds at once.
MAX_INLINE_QUERIES, TILE_BYTES, MOST_SCORES = 4096, 32_000_000, 4_000_000
_HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())])
_HIT_DDL = "query_id bigint, vec_id bigint, distance double"


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.full_like(m, np.nan), where=norms > 0)


class _Best:
    """The k nearest vectors per query seen so far by one task: ties by id, undefined distances last.

    Vectors are scored in slices of bounded size; of a slice only what is no
    farther than a query's k-th best so far, and its own k-th best, is looked at
    again.
    """

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.query, self.ids, self.distance = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.bound = np.full(len(query_ids), np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        height = max(self.k, MOST_SCORES // max(1, len(self.query_ids)))
        for start in range(0, len(ids), height):
            self._add(ids[start : start + height], vectors[start : start + height])

    def _add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = 1.0 - self.queries @ vectors.T
        rank = np.where(np.isnan(scores), np.inf, scores)
        if rank.shape[1] > self.k:
            kth = np.partition(rank, self.k - 1, axis=1)[:, self.k - 1]
            self.bound = np.minimum(self.bound, kth)
        query, place = np.nonzero(rank <= self.bound[:, None])
        query, found, distance = (np.concatenate(c) for c in ((self.query, query), (self.ids, ids[place]), (self.distance, scores[query, place])))
        order = np.lexsort((found, np.where(np.isnan(distance), np.inf, distance), query))
        query = query[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        order, self.query = order[keep], query[keep]
        self.ids, self.distance = found[order], distance[order]
        full = np.flatnonzero((np.arange(len(query)) - first)[keep] == self.k - 1)
        ends = self.distance[full]
        self.bound[self.query[full]] = np.where(np.isnan(ends), np.inf, ends)

    def batch(self) -> pa.RecordBatch:
        columns = [self.query_ids[self.query], self.ids, self.distance]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_HIT)


def _partial(vectors: DataFrame, rows: Sequence, k: int) -> DataFrame:
    query_ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
    queries = _matrix(pa.array([list(r["embedding"]) for r in rows], type=pa.list_(pa.float32())))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        best = _Best(query_ids, queries, k)
        for b in batches:
            if b.num_rows:
                best.add(b.column("vec_id").to_numpy(zero_copy_only=False), _matrix(b.column("embedding")))
        yield best.batch()

    return vectors.select("vec_id", "embedding").mapInArrow(score, _HIT_DDL)


def _partial_blocks(vectors: DataFrame, queries: DataFrame, k: int, query_block: int, tile_rows: int) -> DataFrame:
    """The same partial hits when the queries are too many to ship with the plan.

    Queries are dealt into blocks of about ``query_block`` and vectors into tiles
    of about ``tile_rows``, both by hash and by their counts, so a group holds
    one block and one tile whatever the tables hold.
    """
    n_blocks, tiles = (max(1, -(-df.count() // size)) for df, size in ((queries, query_block), (vectors, tile_rows)))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
    left = dealt.select("block", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("salt"), "query_id", "embedding")
    right = vectors.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int").alias("salt"), "vec_id", "embedding",
    )

    def score(qs: pa.Table, vs: pa.Table) -> pa.Table:
        if not qs.num_rows or not vs.num_rows:
            return _HIT.empty_table()
        qs, vs = qs.combine_chunks(), vs.combine_chunks()
        best = _Best(qs["query_id"].to_numpy(), _matrix(qs["embedding"].chunk(0)), k)
        best.add(vs["vec_id"].to_numpy(), _matrix(vs["embedding"].chunk(0)))
        return pa.Table.from_batches([best.batch()])

    return left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(score, _HIT_DDL)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = fixed.VECTOR_TOP_K,
    max_inline: int = MAX_INLINE_QUERIES,
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, distance): the ``k`` nearest vectors of every query.

    ``vectors`` holds (vec_id, embedding), ``queries`` (query_id, embedding).
    Ties end on ``vec_id``.  Up to ``max_inline`` queries of together at most
    ``tile_bytes`` travel with the plan; more meet the vectors in groups of a
    block of queries and a tile of vectors, either of about ``tile_bytes``.
    """
    width = 8 * (queries.agg(F.max(F.size("embedding"))).first()[0] or 1)
    inline = max(1, min(max_inline, tile_bytes // width))
    rows = rows_if_small(queries.select("query_id", "embedding"), inline)
    if rows is None:
        hits = _partial_blocks(vectors, queries, k, inline, max(1, tile_bytes // width))
    elif not rows:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, distance double")
    else:
        hits = _partial(vectors, rows, k)
    order = [F.isnan("distance"), F.col("distance"), F.col("vec_id")]
    best = keep_first(hits, ["query_id"], order, k)
    return best.select(
        "query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("rank"), "vec_id", "distance"
    )


def in_sources(chunks: DataFrame, sources: Sequence[str] | None, column: str = "source") -> DataFrame:
    """Chunks of the given sources; none given means all."""
    return chunks.filter(F.col(column).isin(list(sources))) if sources else chunks


def cosine_distance(a: Column, b: Column) -> Column:
    """Cosine distance of two array columns, for plans that stay in SQL."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
