"""Tables at rest: versioned publishing, key/value stamps, reports, chunk stores, CSV files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from waymark import fixed
from waymark.functions.text import blank_to_null
from waymark.operators.ordering import keep_first
from waymark.operators.publishing import guard_reasons
from waymark.schema import CHUNK_COLUMNS, PLATFORM_COLUMNS
from waymark.session import remove_folder

_STAMP = "k string, v string, at timestamp, token string"


# ---- key/value stamps -----------------------------------------------------------
def put_stamp(spark: SparkSession, path: str, key: str, value: str) -> None:
    """Set ``key``; a later value stands for an earlier one."""
    put_stamps(spark, path, {key: value})


def put_stamps(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    """Set several keys in one file: readers see all of them or none."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in values.items()))
    rows = spark.range(1).select(F.inline(pairs)).select("k", "v", F.current_timestamp().alias("at"), F.lit(uuid.uuid4().hex).alias("token"))
    rows.coalesce(1).write.mode("append").parquet(path)


def latest_stamps(stamps: DataFrame) -> DataFrame:
    return keep_first(stamps, ["k"], [F.desc("at"), F.desc("token")]).select("k", "v")


def get_stamp(spark: SparkSession, path: str, key: str) -> str | None:
    """The value of ``key``, None when there is none or no stamp was ever put."""
    try:
        stamps = spark.read.schema(_STAMP).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    row = latest_stamps(stamps.filter(F.col("k") == key)).first()
    return row["v"] if row else None


# ---- stage, validate, publish -------------------------------------------------------
def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The published version of a table, None before the first one."""
    version = get_stamp(spark, f"{root}/pointer", "current")
    return None if version is None else spark.read.parquet(f"{root}/{version}")


def publish(
    df: DataFrame, root: str, collected_on: str, key: str = "region",
    min_total: int = fixed.GUARD_MIN_TOTAL, tolerance: float = fixed.GUARD_TOLERANCE,
) -> list[str]:
    """Stage ``df`` as a new version and point readers to it unless the guard objects.

    Returns the guard's reasons.  Readers follow the pointer, so they see the
    old version until the new one is whole; a rejected version is never pointed
    to and its folder is removed.  The version before stays for readers that
    have opened it; what came before that is removed.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").partitionBy(key).parquet(f"{root}/{version}")
    staged = spark.read.parquet(f"{root}/{version}")
    last = get_stamp(spark, f"{root}/pointer", "current")
    old = staged.limit(0) if last is None else spark.read.parquet(f"{root}/{last}")
    reasons = [r["reason"] for r in guard_reasons(staged, old, key, min_total, tolerance).collect()]
    if reasons:
        remove_folder(spark, f"{root}/{version}")
        return reasons
    point_to(spark, root, version, last, {fixed.STAMP_KEY: collected_on})
    return reasons


def point_to(spark: SparkSession, root: str, version: str, last: str | None, stamps: dict[str, str] | None = None) -> None:
    """Make ``version`` the current one, ``last`` the one before, and drop the one before that."""
    oldest = get_stamp(spark, f"{root}/pointer", "before")
    put_stamps(spark, f"{root}/pointer", {"current": version, "before": last or "", **(stamps or {})})
    if oldest:
        remove_folder(spark, f"{root}/{oldest}")


# ---- platforms --------------------------------------------------------------------------
def platform_store(items: DataFrame, source_url: str, collected_on: str) -> DataFrame:
    """Store rows from a platform file's items (with array position ``pos``), defaults filled in."""
    have = set(items.columns)
    or_default = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)
    rows = items.select(
        "id", F.lit(None).cast("int").alias("post_no"), F.col("pos").cast("int").alias("ord"), "kind", "name",
        F.col("summary") if "summary" in have else F.lit(None).cast("string").alias("summary"),
        or_default("note", "").alias("note"), "url", or_default("region_limited", False).alias("region_limited"),
        or_default("source_url", source_url).alias("source_url"),
        F.to_date(or_default("collected_on", collected_on)).alias("collected_on"), or_default("status", "active").alias("status"),
    )
    return rows.select(*PLATFORM_COLUMNS)


# ---- reports ------------------------------------------------------------------------------
def clean_reports(raw: DataFrame, widths: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted reports, rejected ones): fields trimmed; title and content are required.

    ``widths`` cuts fields; the source's are ``fixed.REPORT_WIDTHS``.
    """
    widths = widths or {}
    cleaned = raw.select(*[blank_to_null(F.col(c), widths.get(c)).alias(c) if c in fixed.REPORT_WIDTHS else F.col(c) for c in raw.columns])
    whole = F.col("title").isNotNull() & F.col("content").isNotNull()
    return cleaned.filter(whole).withColumn("status", F.lit(fixed.REPORT_STATES[0])), cleaned.filter(~whole)


def valid_states(updates: DataFrame, states: Sequence[str] = fixed.REPORT_STATES) -> tuple[DataFrame, DataFrame]:
    known = F.coalesce(F.col("status").isin(list(states)), F.lit(False))
    return updates.filter(known), updates.filter(~known)


# ---- chunks -----------------------------------------------------------------------------------
def chunk_key(order: Sequence[str]) -> Column:
    return F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in order]))


def replace_chunks(chunks: DataFrame, vectors: DataFrame, root: str) -> None:
    """Replace the chunk store by chunks with their vectors, matched on a stable chunk key.

    A chunk without a vector, or a vector without a chunk, is an error and leaves
    the store as it is.  The new store is a version of its own (see ``current``).
    """
    spark = chunks.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    joined = chunks.withColumn("_chunk", F.lit(True)).join(vectors.withColumn("_vector", F.lit(True)), "chunk_key", "full_outer")
    joined.select("chunk_key", *CHUNK_COLUMNS, "embedding", "_chunk", "_vector").write.parquet(f"{root}/{version}")
    lone = spark.read.parquet(f"{root}/{version}").agg(F.count_if(F.col("_vector").isNull()), F.count_if(F.col("_chunk").isNull())).first()
    if any(lone):
        remove_folder(spark, f"{root}/{version}")
        raise ValueError(f"{lone[0]} chunks without a vector, {lone[1]} vectors without a chunk")
    point_to(spark, root, version, get_stamp(spark, f"{root}/pointer", "current"))


# ---- plain files -------------------------------------------------------------------------------
def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; the first field carries the byte order mark spreadsheets look for."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).csv(path)


def candidate_columns(found: DataFrame) -> DataFrame:
    """Brand candidates in the review file's eight columns."""
    columns = [
        F.col("brand"), F.col("count"), F.format_string("%.2f", "branch_ratio"), F.col("variants"), F.col("sample_addr"), F.col("verdict"), F.col("reason"),
        F.when(F.col("borderline"), "Y").otherwise(""),
    ]
    return found.select(*(c.alias(h) for c, h in zip(columns, fixed.CANDIDATE_HEADERS)))


def write_dated_report(report: DataFrame, path: str, day: str) -> None:
    """Add a day's survey report; writing a day again replaces that day."""
    report.withColumn("date", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").json(path)
