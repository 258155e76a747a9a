"""Embedding near-dedup by PCA-ordered tiled comparison (operator 5).

Two vectors are linked when their cosine in double precision is at least
``threshold``.  Equal vectors become one class first, so copies cost one row.
Unit vectors are turned into the PCA basis of a bounded sample (any basis gives
the same links, this one only stops sooner).  Linked vectors differ by at most
sqrt(2 - 2 threshold) in every coordinate, so vectors are put into cells of that
width by their first two coordinates and only meet their own and the eight
neighbouring cells.  A cell is split by hash into tiles of about ``tile`` rows;
a pair of tiles is one group, so a cell with most of the rows is many groups.

Within a pair of tiles the leading dimensions' products are added up first; the
rest of a product is at most the product of the two suffixes' norms, and pairs
that cannot reach the threshold any more are dropped before the next dimensions.
The pairs left are confirmed on the original vectors.  A tile pair returns link
counts and one label per linked row, never the pairs.

Nulls and odd rows: vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, link with nothing; so do vectors of different
lengths.  A row without an id has a null component and is kept.  Repeated rows
count as one vector.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import components, written

TILE, SAMPLE, STEPS = 4096, 4_000, (8, 16, 32)
_ROWS_AT_ONCE, _SLACK = 512, 1e-9


def usable(vector: Column) -> Column:
    """Non-null, finite, and not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def as_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat, dtype=np.float64).reshape(-1, width)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def basis(rows: DataFrame, sample: int) -> dict[int, np.ndarray]:
    """Per vector length, directions by falling energy, from at most ``sample`` vectors chosen by hash."""
    got = rows.select("vec").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().column("vec").to_pylist()
    by_width: dict[int, list] = {}
    for v in got:
        by_width.setdefault(len(v), []).append(v)
    out = {}
    for width, of in by_width.items():
        y = unit(np.array(of, np.float64))
        out[width] = np.linalg.eigh(y.T @ y)[1][:, ::-1].copy()
    return out


def linked(a: np.ndarray, b: np.ndarray, turn: np.ndarray | None, threshold: float):
    """Index pairs (i, j) with cosine >= threshold, in blocks of rows of ``a``."""
    ua, ub = unit(a), unit(b)
    ya, yb = (ua, ub) if turn is None else (ua @ turn, ub @ turn)
    width = a.shape[1]
    cuts = [0, *(s for s in STEPS if s < width), width]
    tails = [[np.sqrt((y[:, c:] ** 2).sum(axis=1)) for c in cuts] for y in (ya, yb)]
    for start in range(0, len(a), _ROWS_AT_ONCE):
        rows, cols = np.arange(start, min(start + _ROWS_AT_ONCE, len(a))), np.arange(len(b))
        sums = np.zeros((len(rows), len(cols)))
        alive = None
        for k in range(len(cuts) - 1):
            sums += ya[rows, cuts[k] : cuts[k + 1]] @ yb[cols, cuts[k] : cuts[k + 1]].T
            alive = sums + tails[0][k + 1][rows][:, None] * tails[1][k + 1][cols][None, :] >= threshold - _SLACK
            keep_r, keep_c = alive.any(axis=1), alive.any(axis=0)
            if not keep_r.any():
                break
            rows, cols = rows[keep_r], cols[keep_c]
            sums, alive = sums[np.ix_(keep_r, keep_c)], alive[np.ix_(keep_r, keep_c)]
        if alive is None or not alive.any():
            continue
        i, j = np.nonzero(alive)
        i, j = rows[i], cols[j]
        for at in range(0, len(i), 100_000):
            p, q = i[at : at + 100_000], j[at : at + 100_000]
            sure = np.einsum("ij,ij->i", ua[p], ub[q]) >= threshold
            # Rounding of the unit vectors could decide a tie: the original vectors do.
            close = np.flatnonzero(np.abs(np.einsum("ij,ij->i", ua[p], ub[q]) - threshold) < 1e-12)
            for c in close:
                x, y = a[p[c]], b[q[c]]
                sure[c] = float(x @ y) / (math.sqrt(float(x @ x)) * math.sqrt(float(y @ y))) >= threshold
            yield p[sure], q[sure]


def _labels(ids_a: np.ndarray, ids_b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smaller node of the same component) pairs that connect what the links (i, j) connect."""
    nodes, at = np.unique(np.concatenate([ids_a[i], ids_b[j]]), return_inverse=True)
    u, v = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(threshold: float, turns: dict[int, np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        tile = np.asarray(group.column("tile"))
        width = len(group.column("vec")[0])
        x = as_matrix(group.column("vec"), width)
        ids, copies = np.asarray(group.column("id")), np.asarray(group.column("copies"))
        first = tile == low
        a, b = np.flatnonzero(first), np.flatnonzero(first if low == high else ~first)
        links = np.zeros(len(ids), np.int64)
        out = [(np.empty(0, np.int64),) * 2]
        if len(a) and len(b):
            for i, j in linked(x[a], x[b], turns.get(width), threshold):
                i, j = a[i], b[j]
                other = i != j
                i, j = i[other], j[other]
                np.add.at(links, i, copies[j])
                if low != high:
                    np.add.at(links, j, copies[i])
                if len(i):
                    out.append(_labels(ids, ids, i, j))
        node, label = (np.concatenate(c) for c in zip(*out))
        met = np.flatnonzero(links)
        none = pa.nulls(len(node), pa.int64())
        counts = pa.table({"id": ids[met], "links": links[met], "label": pa.nulls(len(met), pa.int64())})
        return pa.concat_tables([counts, pa.table({"id": node, "links": none, "label": label})])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component_id, kept), one row per input row."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    fit = usable(F.col("vec")) & F.col("id").isNotNull()
    classes = written(rows.filter(fit).distinct().groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    turns = basis(classes, sample)
    width = max(math.sqrt(max(2 - 2 * threshold, 0.0)) + 1e-6, 1 / 500)
    celled = written(classes.mapInArrow(_cells(turns, width), "id bigint, copies bigint, vec array<double>, dim int, x int, y int"), "vector-cells")

    # Per vector length at most (2 / width + 2)^2 cells, each with its number of tiles.
    cells = celled.groupBy("dim", "x", "y").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(tile))).cast("int").alias("tiles"))
    tile_id = lambda x, y, sub: (F.col(x) + 1024).cast("bigint") * F.lit(1 << 52) + (F.col(y) + 1024).cast("bigint") * F.lit(1 << 41) + sub
    mine = celled.join(cells, ["dim", "x", "y"]).select("id", "copies", "vec", "dim", "x", "y", tile_id("x", "y", F.pmod(F.xxhash64("id"), F.col("tiles"))).alias("tile"))
    shift = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = cells.select("dim", F.col("x").alias("ox"), F.col("y").alias("oy"), "tiles").withColumn("dx", F.explode(shift)).withColumn("dy", F.explode(shift))
    near = near.select("dim", (F.col("ox") + F.col("dx")).alias("x"), (F.col("oy") + F.col("dy")).alias("y"), "ox", "oy", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("sub"))
    near = near.select("dim", "x", "y", tile_id("ox", "oy", F.col("sub")).alias("other"))
    paired = mine.join(near, ["dim", "x", "y"]).select("id", "copies", "vec", "dim", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    found = written(paired.groupBy("dim", "low", "high").applyInArrow(_compare(threshold, turns), "id bigint, links bigint, label bigint"), "vector-links")

    links = found.filter("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    found_components = components(found.filter("label is not null").distinct(), "id", "label").withColumnRenamed("node", "id")
    by_class = classes.join(links, "id", "left").join(found_components, "id", "left").select(
        F.col("vec").alias("v"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("component")
    )
    out = rows.withColumn("key", F.when(fit, F.col("vec"))).join(by_class, F.col("key") == F.col("v"), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _cells(turns: dict[int, np.ndarray], width: float):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sizes = np.diff(np.asarray(b.column("vec").offsets))
            spot = np.zeros((b.num_rows, 2), np.int32)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                y = unit(as_matrix(b.column("vec").take(pa.array(at)), int(d)))
                if int(d) in turns:
                    y = y @ turns[int(d)][:, :2]
                spot[at, : min(2, d)] = np.floor(y[:, :2] / width)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("copies"), b.column("vec"), pa.array(sizes.astype(np.int32)), pa.array(spot[:, 0]), pa.array(spot[:, 1])],
                ["id", "copies", "vec", "dim", "x", "y"],
            )

    return run
