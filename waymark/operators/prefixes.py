"""The longest known prefix of every name, from one sorted pass.

Names and keys are sorted together over all tasks.  In that order a key stands
before every name it begins, and all texts between them begin with it too, so
the keys that begin the text at hand form a stack.  A task carries the stack
through its part; what is open where a part begins follows from one row per part.
A name of any length costs one row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import cut_lineage

_Stack = list[tuple[str, str]]


def _close(stack: _Stack, text: str) -> None:
    while stack and not text.startswith(stack[-1][0]):
        stack.pop()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """(part, first, last, keys, values) of one part: its outer texts and its own keys that are open at its end."""
    first = last = part = None
    stack: _Stack = []
    for b in batches:
        if not b.num_rows:
            continue
        if first is None:
            first, part = b.column(0)[0].as_py(), b.column(3)[0].as_py()
        for text, is_name, value in zip(*(b.column(i).to_pylist() for i in range(3))):
            _close(stack, text)
            if not is_name:
                stack.append((text, value))
            last = text
    if first is not None:
        keys, values = ([s[i] for s in stack] for i in (0, 1))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": [first], "last": [last], "keys": pa.array([keys], pa.list_(pa.string())), "values": pa.array([values], pa.list_(pa.string()))})


def longest_prefix(names: DataFrame, keys: DataFrame, min_len: int = 2) -> DataFrame:
    """(nk, key, standard): the longest key of ``min_len`` characters or more that properly begins each name.

    ``names`` holds (nk), ``keys`` (key, standard) with one row per key.
    """
    texts = keys.filter(F.length("key") >= min_len).select(F.col("key").alias("text"), F.lit(False).alias("is_name"), F.col("standard").alias("value")).unionByName(
        names.select("nk").distinct().filter(F.length("nk") > min_len).select(F.col("nk").alias("text"), F.lit(True).alias("is_name"), F.lit(None).cast("string").alias("value"))
    )
    by = ["text", "is_name"]
    rows = cut_lineage(texts.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()))
    # One row per part of the sort, its keys each a prefix of the next.
    edges = rows.mapInArrow(_edges, "part int, first string, last string, keys array<string>, values array<string>").collect()
    entering, stack = {}, []
    for e in sorted(edges, key=lambda e: e["part"]):
        _close(stack, e["first"])
        entering[e["part"]] = list(stack)
        _close(stack, e["last"])
        stack = stack + list(zip(e["keys"], e["values"]))
    shared = rows.sparkSession.sparkContext.broadcast(entering)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        stack: _Stack | None = None
        for b in batches:
            out = []
            for text, is_name, value, part in zip(*(b.column(i).to_pylist() for i in range(4))):
                if stack is None:
                    stack = list(shared.value[part])
                _close(stack, text)
                if not is_name:
                    stack.append((text, value))
                    continue
                at = len(stack) - 1 - (bool(stack) and stack[-1][0] == text)
                if at >= 0:
                    out.append((text, *stack[at]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["nk", "key", "standard"])

    return rows.mapInArrow(run, "nk string, key string, standard string")
