"""Streaming admission limits: per-key state that outlives batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from waymark import fixed
from waymark.operators.admission import MICROS, Passed, admitted

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
DAY_MS = 86_400_000
_OUT = "key string, us bigint, req bigint, admitted boolean, late boolean"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for streams started inside; the session's own setting comes back."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class _Limiter(StatefulProcessor):
    """Keeps the admitted instants of the trailing window, the day and the day's count.

    State that a day and a window of event time have passed over decides nothing
    any more; with ``expires`` a timer drops it when the watermark gets there.
    """

    def __init__(self, per_window: int, per_day: int, window_us: int, expires: bool):
        self.limits, self.expires = (per_window, per_day, window_us), expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("passed", "instants array<bigint>, day int, today int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        past = Passed(np.empty(0, np.int64))
        if self.state.exists():
            instants, past.day, past.today = self.state.get()
            past.instants = np.array(instants, np.int64)
        # Three numbers per request of this key and batch, in time order.
        us, day, req = (np.concatenate(c) for c in zip(*(tuple(r[n].to_numpy(np.int64) for n in ("us", "day", "req")) for r in rows)))
        order = np.lexsort((req, us))
        us, day, req = us[order], day[order], req[order]
        # A request older than the last admitted one came too late.
        late = int(np.searchsorted(us, past.instants[-1])) if len(past.instants) else 0
        passes = np.zeros(len(us), bool)
        passes[late + admitted(us[late:], day[late:], *self.limits, past)] = True
        self.state.update((past.instants.tolist(), None if past.day is None else int(past.day), past.today))
        if self.expires:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            last = max([*past.instants.tolist(), int(us[-1])])
            self.handle.registerTimer(last // 1000 + DAY_MS + self.limits[2] // 1000)
        for i in range(0, len(us), 10_000):
            part = slice(i, i + 10_000)
            yield pd.DataFrame({"key": key[0], "us": us[part], "req": req[part], "admitted": passes[part], "late": np.arange(len(us))[part] < late})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def admissions(
    events: DataFrame, key: str, ts: str, request_id: str, per_window: int, per_day: int,
    window_seconds: int = fixed.WINDOW_SECONDS, zone: str = fixed.LOCAL_ZONE, expires: bool = True, delay: str = "10 minutes",
) -> DataFrame:
    """(key, request_id, ts, admitted, late) per request of a stream.

    Requests of one key are decided in time order within a batch; a request
    older than the last one its key had admitted came too late: it is rejected
    and marked ``late``, for a side output.  With ``expires`` a key's state goes
    when the watermark, ``delay`` behind the newest request, has passed its last
    request by a day and a window; requests behind the watermark are dropped by
    Spark then, as they would be by a limiter that has forgotten their key.
    """
    timed = events.withWatermark(ts, delay) if expires else events
    requests = timed.select(
        F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("us"), F.col(request_id).cast("bigint").alias("req"),
        F.unix_date(F.to_date(F.from_utc_timestamp(ts, zone))).alias("day"), F.col(ts).alias("at"),
    )
    decided = requests.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Limiter(per_window, per_day, window_seconds * MICROS, expires),
        outputStructType=_OUT, outputMode="Append", timeMode="EventTime" if expires else "None",
    )
    return decided.select("key", F.col("req").alias(request_id), F.timestamp_micros("us").alias("ts"), "admitted", "late")
