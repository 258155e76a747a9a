"""Streaming visits: daily counts and one visit per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from waymark.session import remove_folder
from waymark.sources.tables import get_stamp, put_stamp

#: Start of the local day (UTC+9) on the UTC clock.
LOCAL_DAY_START = "15 hours"


def daily_counts(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Visits per local day; the watermark says how late a visit may arrive."""
    day = F.window(ts, "1 day", startTime=LOCAL_DAY_START)
    counted = events.withWatermark(ts, late).groupBy(day).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.to_date("window.end").alias("day"), "count")


def keep_daily_counts(
    events: DataFrame, path: str, checkpoint: str, ts: str = "ts", late: str = "1 day", once: bool = False, compact_every: int = 20,
) -> StreamingQuery:
    """Maintain a (day, count) table: each batch writes the days it changed under its own number.

    A day's newest batch holds its count, so a batch that runs again after a
    lost executor replaces its own rows and counts nothing twice.  Every
    ``compact_every`` batches all days so far are written into one file, which a
    pointer makes the base of what follows, and the folders it holds are
    removed: there are never more than ``compact_every`` and two.  ``once`` reads
    what is there and stops.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")
        if number % compact_every == compact_every - 1:
            _compact(spark, path, number)

    counts = daily_counts(events, ts, late).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    if once:
        counts = counts.trigger(availableNow=True)
    return counts.foreachBatch(save).start()


_BATCHES = "day date, count bigint, batch bigint"


def _base(spark: SparkSession, path: str) -> int:
    """The last batch that the compacted days hold, -1 before the first."""
    return int(get_stamp(spark, f"{path}/pointer", "compacted") or -1)


def _compact(spark: SparkSession, path: str, number: int) -> None:
    last = _base(spark, path)
    if last >= number:
        return
    read_daily_counts(spark, path, number).coalesce(1).write.mode("overwrite").parquet(f"{path}/days-{number}")
    put_stamp(spark, f"{path}/pointer", "compacted", str(number))
    for batch in range(last + 1, number + 1):
        remove_folder(spark, f"{path}/batches/batch={batch}")
    if last >= 0:
        remove_folder(spark, f"{path}/days-{last}")


def read_daily_counts(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """(day, count): the compacted days and what batches behind them changed, if wanted up to one of them."""
    last = _base(spark, path)
    try:
        rows = spark.read.schema(_BATCHES).option("basePath", f"{path}/batches").parquet(f"{path}/batches").filter(F.col("batch") > last)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _BATCHES)
    if upto is not None:
        rows = rows.filter(F.col("batch") <= upto)
    if last >= 0:
        rows = rows.unionByName(spark.read.parquet(f"{path}/days-{last}").withColumn("batch", F.lit(last).cast("bigint")))
    return rows.groupBy("day").agg(F.max_by("count", "batch").alias("count"))


def session_starts(events: DataFrame, who: str, ts: str, event_id: str, gap_seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """The first event of every session of a stream, once the session is over (append mode).

    A session ends ``gap_seconds`` after its last event; it comes out when the
    watermark, ``late`` behind the newest event, has passed that.  An event right
    at the end of the gap still belongs to the session.
    """
    gap = F.session_window(ts, f"{gap_seconds} seconds")
    first = F.min(F.struct(F.col(ts).alias("ts"), F.col(event_id).alias("id")))
    sessions = events.withWatermark(ts, late).groupBy(F.col(who), gap.alias("_session")).agg(first.alias("_first"), F.count(F.lit(1)).alias("events"))
    return sessions.select(who, F.col("_first.id").alias(event_id), F.col("_first.ts").alias(ts), "events")


def first_visits(events: DataFrame, session: str = "session", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """One event per session id within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([session])
