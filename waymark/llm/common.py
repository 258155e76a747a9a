"""What several operators share: reading, written steps, words, hashes, components."""

from __future__ import annotations

import ctypes
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import work_folder

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that travel to a Python worker at once while a step is written; texts are long.
MOST_BATCH_ROWS = 1_000


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a step that a lost executor does not undo.

    Arrow batches are kept small for the time of the write, so that neither side
    of a Python step holds many texts.
    """
    spark = df.sparkSession
    path = work_folder(spark, label)
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, min(int(before), MOST_BATCH_ROWS) if int(before) > 0 else MOST_BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that may be broadcast to a join.
MOST_BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, weight: Column | None = None, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """``df``, a written step, marked for broadcast if it has at most ``most`` rows, or ``weight`` in all; else as it is, to be shuffled.

    It keeps the other side's texts where they are.
    """
    n = df.agg(F.count(F.lit(1)) if weight is None else F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if n <= most else df


def bucket(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``; 0 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(0))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, as UTF-8.

    Both steps work on bytes, where only ASCII letters and ASCII white space count.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def trim() -> None:
    """Give memory that is not in use back to the system; workers outlive their tasks and are many."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)
#: Memories of words that a task fills; they are emptied when its batches end.
_MEMORIES: list[weakref.ref] = []


class WordHashes(dict):
    """64-bit hashes of words; forgets all when full and at the end of a task, so a worker's memory stays bounded."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most
        _MEMORIES.append(weakref.ref(self))

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def per_batch(run: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := run(b)) is not None:
                yield out

    return apply


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of one string or binary column."""
    for b in batches:
        at = b.schema.get_field_index(column)
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(at)), 0), dtype=np.int64))
        start = 0
        while start < b.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + most_bytes, "right")))
            yield b.slice(start, end - start)
            start = end
    for memory in _MEMORIES:
        held = memory()
        if held is not None:
            held.clear()
    _MEMORIES.clear()
    trim()


def count_bound(counts: DataFrame, most: int, column: str = "c") -> int:
    """The smallest count such that at most ``most`` rows have it or more, from a histogram by powers of 2^(1/16)."""
    step, c = F.floor(F.log2(column) * 16), F.col(column)
    hist = counts.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).orderBy(F.desc("b")).collect()
    total, low = 0, hist[0]["high"] + 1 if hist else 1
    for r in hist:
        total += r["n"]
        if total > most:
            break
        low = r["low"]
    return low


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge to another node.

    Alternating star contraction: each node hands its neighbours to its smallest
    neighbour until all edges point at their component's smallest node.  Each
    round is two groupings with partial minima and two joins, so a node with
    very many edges is never gathered in one place; each round's edges are
    written to the shared folder.
    """
    x, y = F.col(a), F.col(b)
    now = written(edges.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    seen = _fingerprint(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = written(small.distinct(), "edges")
        last, seen = seen, _fingerprint(now)
        if seen == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
