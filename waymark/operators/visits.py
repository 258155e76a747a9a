"""Visits: daily counts and one visit per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.values import local_day


def daily_visits(events: DataFrame, ts: str = "ts", zone: str = fixed.LOCAL_ZONE) -> DataFrame:
    """Visits per local day."""
    return events.groupBy(local_day(F.col(ts), zone).alias("day")).agg(F.count(F.lit(1)).alias("count"))


def add_visits(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored daily counts with new ones added to their days."""
    return stored.select("day", "count").unionByName(new.select("day", "count")).groupBy("day").agg(F.sum("count").alias("count"))


def first_of_session(events: DataFrame, who: str, ts: str, event_id: str, gap_seconds: int = 1800) -> DataFrame:
    """The first event of every session, a session ending after ``gap_seconds`` without events.

    Inside a cell as wide as the gap only the earliest event can start a
    session, and whether it does depends on the last event of the cell before.
    So events shrink to one row per (who, cell) before any user's rows meet.
    """
    gap = gap_seconds * 1_000_000
    us = F.unix_micros(F.col(ts))
    cells = events.groupBy(F.col(who), F.floor(us / F.lit(gap)).cast("bigint").alias("_cell")).agg(
        F.min(F.struct(us.alias("us"), F.col(event_id).alias("id"))).alias("_first"), F.max(us).alias("_last")
    )
    before = F.lag("_last").over(Window.partitionBy(who).orderBy("_cell"))
    return (
        cells.withColumn("_before", before)
        .filter(F.col("_before").isNull() | (F.col("_first.us") - F.col("_before") > gap))
        .select(who, F.col("_first.id").alias(event_id), F.timestamp_micros("_first.us").alias(ts))
    )
