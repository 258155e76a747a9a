"""Filling groups in order up to a width: pieces of a text, chunks of a section, published lists.

A group takes the next item as long as it stays within ``cap``.  Where the group
that begins at an item ends is one search in the running sum of widths, so the
groups of a text are a chain of jumps.

``pack_rows`` fills groups over rows of any number.  Rows are sorted over all
tasks and written once.  A task then tells, for every item that may be the first
to begin a group in its part, how the chain from there leaves the part; there
are at most as many as fit into one group.  The driver joins those few numbers
per part, and each task fills its own part from the state it is entered with.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import cut_lineage

_WIDTHS = ("_begin", "_more", "_test")


def jumps(begin: np.ndarray, more: np.ndarray, test: np.ndarray, forced: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(where the group that begins at each item ends, sum of ``more`` before each item and behind the last).

    A group that begins at i is ``begin[i]`` wide and grows by ``more`` of what
    joins it; k joins if the width so far and ``test[k]`` (at most ``more[k]``)
    stay within ``cap`` and k is not ``forced`` to begin a group.
    """
    n = len(begin)
    upto = np.append(0, np.cumsum(more))
    ends = np.searchsorted(upto[:-1] + test, cap - begin + upto[1:], "right")
    stops = np.where(forced, np.arange(n), n)
    next_stop = np.append(np.minimum.accumulate(stops[::-1])[::-1][1:], n) if n else stops
    return np.minimum(np.maximum(ends, np.arange(1, n + 1)), next_stop), upto


def filled(texts: Sequence[str], forced: Sequence[bool], sep: str, cap: int, spaces: str) -> list[str]:
    """Texts joined by ``sep`` into groups of at most ``cap`` characters; white space at a group's ends goes when it is joined."""
    if not texts:
        return []
    begin = np.array([len(t.lstrip(spaces)) for t in texts])
    more = np.array([len(t.rstrip(spaces)) for t in texts]) + len(sep)
    chain, _ = jumps(begin, more, more, np.array(forced, bool), cap)
    out, at, ends = [], 0, chain.tolist()
    while at < len(texts):
        end = ends[at]
        out.append(texts[at] if end == at + 1 else sep.join([texts[at].lstrip(spaces), *(t.rstrip(spaces) for t in texts[at + 1 : end])]))
        at = end
    return out


def small_joined(chunks: Sequence[str], sep: str, small: int, cap: int) -> list[str]:
    """Chunks below ``small`` characters join the one before while their lengths without the separator stay within ``cap``."""
    if not chunks:
        return []
    size = np.array([len(c) for c in chunks])
    chain, _ = jumps(size, size + len(sep), size, size >= small, cap)
    out, at, ends = [], 0, chain.tolist()
    while at < len(chunks):
        out.append(sep.join(chunks[at : ends[at]]))
        at = ends[at]
    return out


# ---- over rows ------------------------------------------------------------------
def pack_rows(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], text: str, sep: str, cap: int,
    small: int | None = None, forced: Column | None = None, spaces: str = "",
) -> DataFrame:
    """(keys, no, text): the non-empty texts of every key filled into groups of at most ``cap`` characters, in order.

    With ``small`` only texts below that width join a group, and the separator
    does not count in the test.  ``forced`` marks texts that begin a group.
    ``spaces`` go from a group's ends when texts are joined, as in ``filled``.
    """
    trimmed = lambda side: side(F.col(text), F.lit(spaces)) if spaces else F.col(text)
    size = F.char_length(text)
    begin, more = F.char_length(trimmed(F.ltrim)), F.char_length(trimmed(F.rtrim)) + len(sep)
    begins = F.coalesce(forced, F.lit(False)) if forced is not None else F.lit(False)
    if small is not None:
        begins = begins | (size >= small)
    widths = (begin, more, size if small is not None else more)
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    cut = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    key = F.to_json(F.array(*[F.col(k).cast("string") for k in keys])) if keys else F.lit("[]")
    fixed_rows = cut_lineage(
        cut.select(*keys, F.col(text).alias("_text"), *[w.cast("int").alias(n) for w, n in zip(widths, _WIDTHS)], begins.alias("_forced"), key.alias("_key"))
        .withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()})
    )
    entries = fixed_rows.sparkSession.sparkContext.broadcast(_entries(fixed_rows, cap))
    parts = fixed_rows.select(*_WIDTHS, "_forced", "_key", "_part", "_pos", "_text").mapInArrow(_fill(entries, sep, cap, spaces), "_key string, no bigint, _pos bigint, text string")
    # A group that crosses parts is at most ``cap`` wide, and so are its pieces together.
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "text"))), lambda p: p["text"])
    text_of = F.array_join("_parts", sep)
    joined = F.when(F.size("_parts") > 1, F.ltrim(text_of, F.lit(spaces))).otherwise(text_of) if spaces else text_of
    whole = parts.groupBy("_key", "no").agg(listed.alias("_parts")).select("_key", "no", joined.alias("text"))
    names = fixed_rows.schema
    values = F.from_json("_key", "array<string>")
    return whole.withColumn("_k", values).select(*[F.col("_k")[i].cast(names[k].dataType).alias(k) for i, k in enumerate(keys)], "no", "text")


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(4))


def _leave(cap: int):
    """One row per part: how it is left, by the first item that begins a group in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        numbers, fresh, first, last, part = [], [], None, None, None
        at_last = 0
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column(4)
            other = np.ones(b.num_rows, bool)
            if b.num_rows > 1:
                other[1:] = np.asarray(pa.compute.not_equal(names[1:], names[:-1]))
            other[0] = names[0].as_py() != last
            seen = sum(map(len, fresh))
            if other.any():
                at_last = seen + int(np.flatnonzero(other)[-1])
            numbers.append(_columns(b))
            fresh.append(other)
            first = names[0].as_py() if first is None else first
            last, part = names[-1].as_py(), b.column(5)[0].as_py()
        if part is None:
            return
        begin, more, test, forced = (np.concatenate(c) for c in zip(*numbers))
        forced = forced.astype(bool) | np.concatenate(fresh)
        # Whether the first row begins a key is for the driver to say.
        forced[0] = numbers[0][3][0]
        chain, upto = jumps(begin.astype(np.int64), more.astype(np.int64), test.astype(np.int64), forced, cap)
        ends, n = chain.tolist(), len(begin)
        left, count = [0] * (n + 1), [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            j = ends[i]
            left[i] = int(begin[i] + upto[n] - upto[i + 1]) if j == n else left[j]
            count[i] = count[j] + (i >= at_last)
        reach = (upto[:-1] + test)[: int(np.searchsorted(upto[:-1] + test, cap, "right")) + 1]
        stop = int(np.flatnonzero(forced)[0]) if forced.any() else n
        k = min(len(reach), stop, n) + 1
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "first": [first], "last": [last], "n": pa.array([n], pa.int64()), "stop": pa.array([stop], pa.int64()), "whole": pa.array([int(upto[n])], pa.int64()),
            "reach": pa.array([reach.tolist()], pa.list_(pa.int64())), "left": pa.array([left[:k]], pa.list_(pa.int64())), "count": pa.array([count[:k]], pa.list_(pa.int64())),
        })

    return run


def _entries(fixed_rows: DataFrame, cap: int) -> dict[int, tuple[str | None, int, int]]:
    """(key, width, number) of the group that is open where each part begins.

    One row per part of the sort: their number is set by the job, not by the data.
    """
    told = fixed_rows.select(*_WIDTHS, "_forced", "_key", "_part").mapInArrow(
        _leave(cap), "part int, first string, last string, n bigint, stop bigint, whole bigint, reach array<bigint>, left array<bigint>, count array<bigint>"
    ).collect()
    entries, key, width, number = {}, None, 0, -1
    for r in sorted(told, key=lambda r: r["part"]):
        entries[r["part"]] = (key, width, number)
        new = r["first"] != key
        p = 0 if new else min(int(np.searchsorted(r["reach"], cap - width, "right")), r["stop"])
        before = -1 if new or r["first"] != r["last"] else number
        if p < r["n"]:
            width, number = r["left"][p], before + r["count"][p]
        else:
            width = width + r["whole"]
        key = r["last"]
    return entries


def _fill(entries, sep: str, cap: int, spaces: str):
    trim = bool(spaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        key, width, number, held, at = None, 0, -1, [], 0
        known = False
        for b in batches:
            if not b.num_rows:
                continue
            if not known:
                (key, width, number), known = entries.value[b.column(5)[0].as_py()], True
            out: list[tuple] = []
            for begin, more, test, forced, name, pos, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6, 7))):
                if name != key or forced or width + test > cap:
                    if held:
                        out.append((key, number, at, sep.join(held)))
                    number = number + 1 if name == key else 0
                    key, width, held, at = name, begin, [text], pos
                else:
                    if not held:
                        at = pos
                    elif trim and len(held) == 1:
                        held[0] = held[0].lstrip(spaces)
                    held.append(text.rstrip(spaces) if trim else text)
                    width += more
            if out:
                yield _parts(out)
        if held:
            yield _parts([(key, number, at, sep.join(held))])

    return run


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["_key", "no", "_pos", "text"])
