"""Mixing sources to target weights by balanced sampling, the cube method (operator 2).

Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3 ...  They share
the wanted total by weight; a source's target stops at ``most`` times its size
and what is over goes to the others by weight.  A document of a source is taken
``floor(rate)`` times, and once more with probability ``rate - floor(rate)``.

Those draws are not independent.  Flight: in blocks of a source, a pool of
documents moves its probabilities along the null space of (documents, tokens)
until one reaches 0 or 1, so both totals of the block stay exactly as they were;
at most two documents of a block, its smallest, stay open.  The open ones of all blocks form
new blocks, round after round, until one block per source is left; there the
landing gives up first the document total, then the token total, and at last
flips one or two of that block's documents if that brings the tokens nearer.

Rows equal in id, text and source are one document of the flight: ``n`` such rows
are wanted ``n * rate`` times together, and what is drawn is dealt out among them,
to each the same or one more to the first ones.  Blocks are hashes of the id and
text and hold about ``block`` of these documents, so a source with most of the
rows is many blocks and a row that repeats very often weighs one.  Draws come from
a generator seeded by source, block and round: reruns agree.

Nulls and odd rows: a null text has size 0; null sources are one source; rows
that repeat an id with other texts are drawn each for itself.  A source without
tokens has target 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from numpy.random import Generator, PCG64
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import written
from waymark.operators.ordering import number_all, number_in_group

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 2_000
#: Open documents among which one move is made.
POOL = 64
_EPS = 1e-9


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size) rows."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    numbered = number_all(sources, [F.col("source").asc_nulls_last()], "_no")
    table = written(numbered.select("source", "source_size", "n_docs", F.get(cycle, ((F.col("_no") - 1) % len(weights)).cast("int")).alias("w")), "sources")
    limit = F.col("source_size") * F.lit(float(most))
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        full = F.col("w") * F.lit(level) >= limit
        r = table.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("w"))), F.count_if(full)).first()
        if not r[1] or r[2] == capped:
            break
        level, capped = (total - (r[0] or 0.0)) / r[1], r[2]
    return table.select("source", "source_size", "n_docs", F.least(F.col("w") * F.lit(level), limit).alias("target"))


def fly(p: list[float], size: list[int], rng: Generator, land: bool) -> np.ndarray:
    """Moves open probabilities to 0 or 1 with the sums of ``p`` and of ``p * size`` unchanged.

    ``size`` falls.  Of a pool of open documents the largest one that can move
    does so, along its projection on the null space, while the others make up
    for it: large documents are settled while many small ones are still open.  At
    most two stay open, the smallest; ``land`` settles those as well.
    """
    p, size = np.array(p, float), np.array(size, float)
    p[p < _EPS], p[p > 1 - _EPS] = 0.0, 1.0
    waiting, at = np.flatnonzero((p > 0) & (p < 1)), POOL
    pool = waiting[:at]
    while len(pool) > 2 or (land and len(pool)):
        u = _direction(size[pool])
        x = p[pool]
        with np.errstate(divide="ignore", invalid="ignore"):
            ups = np.where(u > 0, (1 - x) / u, np.where(u < 0, -x / u, np.inf))
            downs = np.where(u > 0, x / u, np.where(u < 0, (x - 1) / u, np.inf))
        up, down = ups.min(), downs.min()
        rises = rng.random() * (up + down) < down
        x = x + (up if rises else -down) * u
        x[(ups if rises else downs).argmin()] = round(x[(ups if rises else downs).argmin()])
        x[x < _EPS], x[x > 1 - _EPS] = 0.0, 1.0
        p[pool] = x
        pool = pool[(x > 0) & (x < 1)]
        more = POOL - len(pool)
        pool, at = np.concatenate([pool, waiting[at : at + more]]), at + more
    return p


def _direction(size: np.ndarray) -> np.ndarray:
    """A move that keeps the number and the sizes' sum, led by the first document that can; with two or one left, less is kept."""
    n = len(size)
    if n == 1:
        return np.ones(1)
    if n == 2:
        return np.array([size[1], -size[0]]) if size.any() else np.array([1.0, -1.0])
    mean = size.mean()
    off = size - mean
    spread = off @ off
    if spread <= 1e-9 * max(1.0, mean * mean):
        off, spread = np.zeros(n), 1.0
    # 1 - leverage: how much of a document's own move the two sums leave.
    free = 1 - 1 / n - off * off / spread
    lead = int(np.argmax(free > 1e-3)) if (free > 1e-3).any() else int(free.argmax())
    u = -1 / n - off[lead] * off / spread
    u[lead] += 1
    u[np.abs(u) < 1e-12] = 0.0
    return u


def nearer(p: np.ndarray, drawn: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``drawn`` with the one or two open documents flipped that bring the tokens nearest to what was wanted.

    A source with few documents has no small ones to make up for a large one, so
    the landing alone can miss by much.
    """
    open_, size = np.flatnonzero((p > 0) & (p < 1)), size.astype(float)
    missing = float(p @ size - drawn @ size)
    flips = (1 - 2 * drawn[open_]) * size[open_]
    if not len(open_):
        return drawn
    best, chosen = abs(missing), []
    one = np.abs(missing - flips)
    if one.min() < best:
        best, chosen = one.min(), [int(one.argmin())]
    order = np.argsort(flips)
    ranked = flips[order]
    for shift in (-1, 0):
        partner = np.clip(np.searchsorted(ranked, missing - flips) + shift, 0, len(ranked) - 1)
        two = np.where(order[partner] == np.arange(len(flips)), np.inf, np.abs(missing - flips - ranked[partner]))
        if two.min() < best:
            best, chosen = two.min(), [int(two.argmin()), int(order[partner[two.argmin()]])]
    drawn = drawn.copy()
    drawn[open_[chosen]] = 1 - drawn[open_[chosen]]
    return drawn


def _flight(round_no: int, land: bool, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "h", "p"], ascending=[False, True, True], kind="stable")
        rng = Generator(PCG64(xxhash.xxh3_64_intdigest(f"{seed}|{round_no}|{key[0]!r}|{key[1]}".encode("utf-8", "surrogatepass"))))
        p, size = rows["p"].to_numpy(float), rows["size"].to_numpy()
        drawn = fly(p, size, rng, land)
        return rows.assign(p=nearer(p, drawn, size) if land else drawn)

    return run


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & left["source"].eqNullSafe(right["source"]) & (left["text_hash"] == right["text_hash"])


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, text_hash) per row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("text_hash")), "sizes")


def mix(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(id, source, text_hash, source_size, target, n, drawn, no) per set of ``n`` equal rows, drawn ``drawn`` times together; ``no`` names the set."""
    sets = written(sizes.groupBy("id", "source", "size", "text_hash").agg(F.count(F.lit(1)).alias("n")), "sets")
    goal = written(targets(sets.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most), "targets")
    rate = F.when(F.col("target") >= F.lit(float(most)) * F.col("source_size"), F.when(F.col("source_size") > 0, F.lit(float(most))).otherwise(0.0)).otherwise(F.col("target") / F.col("source_size"))
    over = (rate - F.floor(rate)) * F.col("n")
    rows = sets.join(goal, sets["source"].eqNullSafe(goal["source"])).select(
        "id", sets["source"], "size", "text_hash", "n", "source_size", "target", (F.floor(rate) * F.col("n") + F.floor(over)).cast("bigint").alias("whole"), (over - F.floor(over)).alias("p"),
        F.xxhash64("id", "text_hash").alias("h"), F.ceil(F.col("n_docs") / F.lit(float(block))).cast("bigint").alias("blocks"),
    )
    open_rows, done = rows, []
    for round_no in range(64):
        land = open_rows.filter("blocks > 1").isEmpty()
        cell = F.pmod(F.xxhash64("h", F.lit(round_no)), F.col("blocks")).alias("cell")
        flown = written(open_rows.select("*", cell).groupBy("source", "cell").applyInPandas(_flight(round_no, land, seed), open_rows.select("*", cell).schema).drop("cell"), "flight")
        if land:
            done.append(flown)
            break
        done.append(flown.filter("p = 0 or p = 1"))
        # At most two rows of a cell stay open.
        still = flown.filter("p > 0 and p < 1").withColumn("blocks", F.ceil(F.col("blocks") * F.lit(2.0 / block)).cast("bigint"))
        open_rows = still
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    drawn = F.col("whole") + F.col("p").cast("bigint")
    return written(out.select("id", "source", "text_hash", "source_size", "target", "n", drawn.alias("drawn"), F.monotonically_increasing_id().alias("no")), "drawn")


def _dealt(rows: DataFrame, drawn: DataFrame, columns: list[Column], label: str) -> DataFrame:
    """``columns`` and the copies of each row of ``rows`` (id, source, text_hash and more); the copies of a set sum to what it drew.

    Only rows of sets whose draws do not divide by their rows are numbered, in blocks.
    """
    even, odd = drawn.filter("drawn % n = 0"), drawn.filter("drawn % n <> 0")
    each = F.expr("drawn div n")
    out = rows.join(even, _same(rows, even)).select(*columns, each.alias("copies"))
    if odd.isEmpty():
        return out
    held = written(rows.join(odd, _same(rows, odd)).select(F.struct(*columns).alias("row"), "no", "n", "drawn", F.monotonically_increasing_id().alias("at")), label)
    nth = number_in_group(held, ["no"], "at", "nth")
    return out.unionByName(nth.select("row.*", (each + F.expr("CAST(nth <= drawn % n AS BIGINT)")).alias("copies")))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    rows = sized(docs, id_col, text_col, source_col)
    drawn = mix(rows, **options)
    dealt = _dealt(rows, drawn, [rows["id"].alias(id_col), rows["size"], F.col("source_size"), F.col("target")], "repeats")
    return dealt.select(id_col, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture itself: every row as often as it was drawn, with its own columns."""
    drawn = mix(sized(docs, id_col, text_col, source_col), **options).filter("drawn > 0")
    own = F.struct(*(F.col(c) for c in docs.columns)).alias("own")
    keyed = docs.select(own, F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash"))
    dealt = _dealt(keyed, drawn, [keyed["own"]], "repeats")
    return dealt.select("own", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("own.*")
