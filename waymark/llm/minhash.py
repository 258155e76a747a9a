"""MinHash near-dedup with SuperMinHash signatures (operator 9).

A document's set is its distinct ``k``-word shingles; with fewer words the whole
sequence is one shingle; without words the set is empty and links with nothing.
Two documents are linked when intersection / union >= ``percent`` / 100 on the
full sets.  Steps:

1. one pass over the texts: set size, two 64-bit sums that name the set, and
   the keys of 42 bands of 6 registers from a SuperMinHash signature;
2. equal sets become one class with the smallest id as its representative, so
   copies cost one row each and never meet;
3. a star per bucket: every representative is compared with the bucket's hub, the
   one that shares most bucket places with others; this is linear in the bucket;
4. components of the confirmed links.  Where a bucket still holds several
   components, pairs between different ones follow, so no link between them is
   lost.  What two documents share is at most the smaller of their overlaps with
   the hub, plus the shingles outside the hub that they may share; a 512-bit map
   of the latter bounds it, and only pairs that can still reach the threshold
   leave the join and are confirmed;
5. components of all links.

A Bloom filter of bounded size holds the ids whose full sets are needed, so texts
are never shuffled; what it lets through beside them only costs time.

A pair at similarity 0.8 shares no band with probability (1 - 0.8^6)^42 = 3e-6.
Links are confirmed on the sets as 64-bit hashes of the shingles.

Nulls and odd rows: a null or blank text has an empty set.  A row without an id
keeps null as its component and is kept.  Rows that repeat an id are one node of
the graph; each such row is returned with its own set's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import GOLDEN, WordHashes, components, mix, small_batches, words_of, written

REGISTERS, BANDS, ROWS = 256, 42, 6
#: Words of the map of a document's shingles outside the hub.
MAP_WORDS = 8
#: The Bloom filter grows with the ids it holds up to this many bits (16 MB).
BLOOM_BITS = 1 << 27
_UNIT = 8192
_P1, _P2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_BAND_WEIGHTS = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
_BAND_TAGS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _P2)


def shingle_set(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    size = min(k, n)
    h = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h = mix((h ^ word_hashes[i : n - size + 1 + i]) * _P1 + GOLDEN)
    return np.unique(h)


def super_minhash(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """Signatures of non-empty sets, one row of ``m`` registers each.

    Every element draws a permutation of the registers step by step
    (Fisher-Yates) and writes ``step + uniform`` to the register it meets, so
    its ranks are correlated and the estimate varies less than with independent
    hashes.  A set stops after the step at which all its registers are smaller
    than the next step's values.  Elements are worked in units of bounded size.
    """
    h = np.full((len(sets), m), np.inf)
    flat, top = h.reshape(-1), np.full(len(sets), np.inf)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    for start in range(0, len(elements), _UNIT):
        x, own = elements[start : start + _UNIT], owners[start : start + _UNIT]
        slots = np.arange(own[0], own[-1] + 1)
        order = np.tile(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (len(x), 1))
        rows = np.arange(len(x))
        for step in range(m):
            live = top[own] > step
            if not live.all():
                x, own, rows = x[live], own[live], rows[live]
            if not len(x):
                break
            draw = mix(x + np.uint64((step + 1) * int(GOLDEN) & (1 << 64) - 1))
            value = step + (draw >> np.uint64(32)).astype(np.float64) / 2.0**32
            k = step + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - step) >> np.uint64(32)).astype(np.intp)
            register = order[rows, k]
            order[rows, k] = order[rows, step]
            np.minimum.at(flat, own * m + register, value)
            top[slots] = h[slots].max(axis=1)
    return h


def band_keys(signatures: np.ndarray) -> np.ndarray:
    bits = signatures[:, : BANDS * ROWS].copy().view(np.uint64).reshape(len(signatures), BANDS, ROWS)
    return mix(mix(bits * GOLDEN + _P1) @ _BAND_WEIGHTS ^ _BAND_TAGS).view(np.int64)


def _sets(batch: pa.RecordBatch, k: int, hashes: WordHashes) -> list[np.ndarray]:
    return [shingle_set(hashes.of(words_of(t)), k) for t in batch.column(1).to_pylist()]


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        hashes = WordHashes()
        for b in small_batches(batches, "text"):
            sets = _sets(b, k, hashes)
            filled = [i for i, s in enumerate(sets) if len(s)]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            one, two = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            for i in filled:
                one[i], two[i] = mix(sets[i] ^ _P1).sum().view(np.int64), mix(sets[i] ^ _P2).sum().view(np.int64)
            keys = band_keys(super_minhash([sets[i] for i in filled])).reshape(-1)
            ends = np.zeros(len(sets) + 1, np.int32)
            ends[1:] = np.cumsum(np.where(n > 0, BANDS, 0))
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(one), pa.array(two), lists], ["id", "n", "one", "two", "bands"])

    return run


def _full_sets(k: int, held: Callable[[pa.RecordBatch], pa.Array]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        hashes = WordHashes()
        wanted = (b.filter(held(b)) for b in batches)
        for b in small_batches(wanted, "text"):
            sets = _sets(b, k, hashes)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "set"])

    return run


class _Bloom:
    """Ids that are in question, or a few more; two bits per id."""

    def __init__(self, ids: DataFrame, n: int):
        self.bits = min(BLOOM_BITS, 1 << max(16, int(n * 16).bit_length()))
        spots = ids.select(F.explode(F.array(*(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(self.bits)) for salt in (1, 2)))).alias("spot"))
        words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("set")).toArrow()
        self.words = np.zeros(self.bits >> 6, np.int64)
        self.words[np.asarray(words.column("word"))] = np.asarray(words.column("set"))

    def sets_of(self, texts: DataFrame, k: int) -> DataFrame:
        """The full sets of the rows whose id may be held; one Python step filters and hashes."""
        shared, bits = texts.sparkSession.sparkContext.broadcast(self.words), self.bits
        hashed = texts.filter("id is not null").select("id", "text", *(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(bits)).alias(f"s{salt}") for salt in (1, 2)))

        def held(b: pa.RecordBatch) -> pa.Array:
            may = np.ones(b.num_rows, bool)
            for name in ("s1", "s2"):
                spot = np.asarray(b.column(b.schema.get_field_index(name)))
                may &= (shared.value[spot >> 6] >> (spot & 63) & 1) == 1
            return pa.array(may)

        return hashed.mapInArrow(_full_sets(k, held), "id bigint, set array<bigint>")


def _sets_of(ids: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(id, set) at least of the wanted ids, written."""
    ids = written(ids.distinct(), "ids")
    return written(_Bloom(ids, ids.count()).sets_of(texts, k), "sets")


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Per pair (a, b) with both sets: sizes, overlap, and the map of a's shingles outside b."""
    for b in batches:
        out: list[list] = [[] for _ in range(5)]
        sa, sb = b.column(2), b.column(3)
        for i in range(b.num_rows):
            x, y = (np.asarray(c[i].values) for c in (sa, sb))
            inside = np.isin(x, y, assume_unique=True)
            rest = x[~inside].view(np.uint64) % np.uint64(64 * MAP_WORDS)
            bits = np.zeros(64 * MAP_WORDS, np.uint8)
            bits[rest.astype(np.intp)] = 1
            for column, value in zip(out, (len(x), len(y), len(x) - len(rest), np.packbits(bits).view(np.int64), len(rest) - int(bits.sum()))):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(out, kinds))], ["a", "b", "na", "nb", "common", "map", "twice"])


def _compared(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, na, nb, common, map, twice): what each pair's full sets share."""
    pairs = written(pairs, "pairs")
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), texts, k)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    return written(both.select("a", "b", "sa", "sb").mapInArrow(_overlaps, "a bigint, b bigint, na bigint, nb bigint, common bigint, map array<bigint>, twice bigint"), "compared")


def _similar(common: Column, na: Column, nb: Column, percent: int) -> Column:
    """100 * common >= percent * union."""
    return F.lit(100 + percent) * common >= F.lit(percent) * (na + nb)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per input row."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = written(
        texts.mapInArrow(_sketches(shingle_words), "id bigint, n bigint, one bigint, two bigint, bands array<bigint>"), "sketches"
    )
    full = sketches.filter("n > 0 and id is not null")
    classes = full.groupBy("one", "two", "n").agg(F.min("id").alias("rep"))
    members = written(full.join(classes, ["one", "two", "n"]).select("id", "rep", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands")), "classes")
    rows = members.filter("bands is not null").select("id", F.explode("bands").alias("key")).distinct()
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = written(rows.join(sizes, "key"), "buckets")
    places = shared.groupBy("id").agg(F.sum("size").alias("places"))
    hubs = shared.join(places, "id").groupBy("key").agg(F.max(F.struct("places", (-F.col("id")).alias("id"))).alias("hub"))
    seats = written(shared.join(hubs.select("key", (-F.col("hub.id")).alias("hub")), "key"), "seats")

    star = _compared(seats.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), texts, shingle_words)
    similar = _similar(F.col("common"), F.col("na"), F.col("nb"), percent)
    links = star.filter(similar).select("a", "b")
    pairs = _open_pairs(seats.filter("size > 2"), star, components(links, "a", "b"), percent)
    more = _compared(pairs, texts, shingle_words).filter(similar).select("a", "b")
    found = components(links.union(more), "a", "b").withColumnRenamed("node", "rep")

    by_id = members.select("id", "rep").join(found, "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("id", "n").join(_one_node_per_id(by_id), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _open_pairs(seats: DataFrame, star: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in one bucket that may still be similar, the hub's own apart.

    The rows outside the hub's component meet the bucket's other rows.
    """
    component = F.coalesce("component", "id")
    labelled = seats.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "hub", component.alias("component"))
    mains = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.when(F.col("id") == F.col("hub"), F.col("component"))).alias("main"))
    facts = star.select(F.col("a").alias("id"), F.col("b").alias("hub"), F.col("na").alias("n"), "common", "map", "twice")
    rows = labelled.join(mains.filter("low <> high").select("key", "main"), "key").filter("id <> hub").join(facts, ["id", "hub"])
    named = lambda p: [F.col(c).alias(p + c) for c in ("id", "component", "n", "common", "map", "twice")]
    strays = rows.filter("component <> main").select("key", *named("u_"))
    others = rows.select("key", "main", *named("x_"))
    u, x = (lambda c: F.col(f"u_{c}")), (lambda c: F.col(f"x_{c}"))
    maps = [F.bit_count(F.get(u("map"), F.lit(i)).bitwiseAND(F.get(x("map"), F.lit(i)))) for i in range(MAP_WORDS)]
    outside = F.least(sum(maps[1:], maps[0]) + F.least(u("twice"), x("twice")), u("n") - u("common"), x("n") - x("common"))
    once = (u("component") != x("component")) & ((x("component") == F.col("main")) | (x("id") < u("id")))
    may = _similar(F.least(u("common"), x("common")) + outside, u("n"), x("n"), percent)
    return strays.join(others, "key").filter(once & may).select(F.least("u_id", "x_id").alias("a"), F.greatest("u_id", "x_id").alias("b")).distinct()


def _one_node_per_id(by_id: DataFrame) -> DataFrame:
    """One component per id; ids that repeat with different sets tie their components together."""
    by_id = written(by_id, "members")
    spans = by_id.groupBy("id").agg(F.min("component").alias("component"), F.max("component").alias("other"))
    if spans.filter("component <> other").isEmpty():
        return spans.select("id", "component")
    tied = components(by_id.select("id", "component"), "id", "component")
    return spans.select("id").join(tied, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))
