"""Steps of a run, each written once and recorded, so that a restarted run goes on behind the last one that ended."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from waymark.session import remove_folder
from waymark.sources.tables import get_stamp, put_stamp

Step = tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]


def run_steps(spark: SparkSession, root: str, run: str, steps: Sequence[Step]) -> dict[str, DataFrame]:
    """The written result of every step by name.

    A step gets the results of those before it.  Its folder is recorded after it
    is whole; a step that died leaves a folder nobody reads, and runs again.
    """
    done: dict[str, DataFrame] = {}
    for name, make in steps:
        folder = recorded(spark, root, run, name)
        if folder is None:
            folder = f"{run}-{name}-{uuid.uuid4().hex}"
            make(done).write.parquet(f"{root}/steps/{folder}")
            put_stamp(spark, f"{root}/ledger", _key(run, name), folder)
        done[name] = spark.read.parquet(f"{root}/steps/{folder}")
    return done


def recorded(spark: SparkSession, root: str, run: str, name: str) -> str | None:
    """What was recorded for a step of a run, None if it has not ended."""
    return get_stamp(spark, f"{root}/ledger", _key(run, name))


def record(spark: SparkSession, root: str, run: str, name: str, value: str) -> None:
    put_stamp(spark, f"{root}/ledger", _key(run, name), value)


def forget_steps(spark: SparkSession, root: str, run: str, names: Sequence[str]) -> None:
    """Remove the folders of a run that is over; what was recorded stays."""
    for name in names:
        folder = recorded(spark, root, run, name)
        if folder is not None:
            remove_folder(spark, f"{root}/steps/{folder}")


def _key(run: str, name: str) -> str:
    return f"{run}/{name}"
