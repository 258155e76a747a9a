"""Per-key admission limits over a table of requests (the batch twin of the stream).

A request is admitted when fewer than ``per_window`` admitted requests of its
key lie in the trailing window and fewer than ``per_day`` in its local day.
Admissions depend on earlier admissions, so each key is walked in time order.
Three exact steps keep that walk short and spread out:

1. counts per (key, window-sized cell) show where a day's quota is surely used
   up; later requests of that day are rejected without being walked;
2. of requests of one key at one instant at most ``per_window`` can pass;
3. the walk restarts where nothing admitted can still lie in the trailing
   window: after a pause, or at midnight when the quota ended well before it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark import fixed
from waymark.operators.ordering import keep_first

MICROS = 1_000_000


@dataclass
class Passed:
    """What a key's past says about its next requests: the last admitted instants, and today's number."""

    instants: np.ndarray
    day: int | None = None
    today: int = 0


def admitted(us: np.ndarray, day: np.ndarray, per_window: int, per_day: int, window_us: int, past: Passed) -> np.ndarray:
    """Places of the admitted requests among one key's, which are in time order; ``past`` is moved on.

    The search goes from one admission to the next: behind a full window to the
    first request outside of it, behind a used-up quota to the first one of the
    next day.  Its cost follows the admissions, not the requests.
    """
    line = np.concatenate([past.instants, np.empty(len(us), np.int64)])
    n, places, at = len(past.instants), [], 0
    while per_window > 0 and at < len(us):
        today = past.today if day[at] == past.day else 0
        if today >= per_day:
            at = int(np.searchsorted(day, day[at], "right"))
            continue
        open_from = line[n - per_window] + window_us if n >= per_window else None
        if open_from is not None and us[at] <= open_from:
            at = int(np.searchsorted(us, open_from, "right"))
            continue
        line[n], past.day, past.today = us[at], day[at], today + 1
        places.append(at)
        n, at = n + 1, at + 1
    past.instants = line[max(0, n - per_window) : n].copy()
    return np.array(places, np.int64)


def _walk_sorted(per_window: int, per_day: int, window_us: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        last, past = None, Passed(np.empty(0, np.int64))
        for b in batches:
            if not b.num_rows:
                continue
            key, chain = b.column("key").dictionary_encode().indices.fill_null(-1), b.column("chain")
            us, day = (np.asarray(b.column(c)) for c in ("us", "day"))
            changes = (np.diff(np.asarray(key)) != 0) | (np.diff(np.asarray(chain)) != 0)
            bounds = [0, *(np.flatnonzero(changes) + 1).tolist(), b.num_rows]
            chosen = []
            for start, end in zip(bounds, bounds[1:]):
                name = b.column("key")[start].as_py(), chain[start].as_py()
                if name != last:
                    last, past = name, Passed(np.empty(0, np.int64))
                chosen.append(start + admitted(us[start:end], day[start:end], per_window, per_day, window_us, past))
            yield b.select(["key", "us", "req"]).take(pa.array(np.concatenate(chosen)))

    return run


def _cells(requests: DataFrame, window_us: int) -> DataFrame:
    """One row per (key, day, cell): how many requests, and the first and last instant."""
    return requests.groupBy("key", "day", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )


def _last_cell_needed(cells: DataFrame, per_window: int, per_day: int) -> DataFrame:
    """Cells with their walk chain, up to the cell where the day's quota is surely used up.

    Two neighbouring cells together admit at least ``min(per_window, n)`` for
    the later one's ``n`` requests, so every second cell is a safe lower bound.
    The day's first cells are left out, since the window before them reaches
    into the day before.
    """
    day = Window.partitionBy("key", "day").orderBy("cell")
    inside = F.col("cell") - F.min("cell").over(Window.partitionBy("key", "day")) >= 2
    floor = F.when(inside, F.least("n", F.lit(per_window))).otherwise(0)
    upto = day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    even = F.sum(F.when(F.col("cell") % 2 == 0, floor).otherwise(0)).over(upto)
    odd = F.sum(F.when(F.col("cell") % 2 != 0, floor).otherwise(0)).over(upto)
    return cells.withColumn("sure", F.greatest(even, odd)).withColumn(
        "before", F.coalesce(F.lag("sure").over(day), F.lit(0))
    ).filter(F.col("before") < per_day)


def admit(
    events: DataFrame,
    key: str,
    ts: str,
    request_id: str,
    per_window: int,
    per_day: int,
    window_seconds: int = fixed.WINDOW_SECONDS,
    zone: str = fixed.LOCAL_ZONE,
) -> DataFrame:
    """(key, request_id, ts) of the admitted requests."""
    window_us = window_seconds * MICROS
    requests = events.select(
        F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("us"), F.col(request_id).alias("req"),
        F.unix_date(F.to_date(F.from_utc_timestamp(ts, zone))).alias("day"),
    ).withColumn("cell", F.floor(F.col("us") / F.lit(window_us)).cast("bigint"))

    needed = _last_cell_needed(_cells(requests, window_us), per_window, per_day)
    line = Window.partitionBy("key").orderBy("first_us")
    # A chain may start where the last cell kept before ended more than a window ago ...
    pause = F.col("first_us") - F.lag("last_us").over(line) > window_us
    # ... unless the same day goes on, because its quota is counted across pauses.
    fresh = F.lag("day").over(line).isNull() | ((F.lag("day").over(line) != F.col("day")) & pause)
    chained = needed.withColumn("start", F.when(fresh, 1).otherwise(0)).withColumn(
        "chain", F.sum("start").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).select("key", "day", "cell", "chain")

    open_requests = keep_first(requests, ["key", "us"], ["req"], per_window).join(chained, ["key", "day", "cell"])
    walked = (
        open_requests.select("key", "chain", "us", "day", "req")
        .repartition("key", "chain")
        .sortWithinPartitions("key", "chain", "us", "req")
        .mapInArrow(_walk_sorted(per_window, per_day, window_us), f"key string, us bigint, req {_ddl(events, request_id)}")
    )
    return walked.select("key", F.col("req").alias(request_id), F.timestamp_micros("us").alias("ts"))


def _ddl(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
