"""Named queries over the driver tables, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under its function's name; ``covers`` lists the inventory entries it shows."""

    def register(run: Run) -> Run:
        QUERIES[run.__name__] = Query(run.__name__, covers, run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its naive times are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, TimestampNTZType)}
    return df.withColumns(naive) if naive else df


def load_all() -> dict[str, Query]:
    from waymark.plans import corpus, events, ingest, jobs, places, platforms, survey  # noqa: F401

    return QUERIES
