"""Summary tables: matrices, rates, stamps, sets and conditional counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import fixed
from waymark.operators.packing import pack_rows


def group_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def matrix(df: DataFrame, row: str, column: str, values: Sequence[str], total: str = "total") -> DataFrame:
    """Counts of ``column`` values per ``row`` value, with a totals row.

    One pass counts (row, value) pairs; the pivot and the totals row work on those.
    """
    pairs = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    cells = [
        F.coalesce(F.sum(F.when(F.col(column) == v, F.col("n"))), F.lit(0)).alias(v) for v in values
    ]
    return pairs.rollup(row).agg(*cells, F.grouping(row).alias("_all")).select(
        F.when(F.col("_all") == 1, total).otherwise(F.col(row)).alias(row), *values
    )


def two_level_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts per outer value and per (outer, inner) pair; a null ``inner`` marks the outer total."""
    pairs = group_counts(df.filter(F.col(inner).isNotNull()), outer, inner)
    totals = pairs.groupBy(outer).agg(F.sum("count").alias("count")).withColumn(inner, F.lit(None).cast("string"))
    return pairs.unionByName(totals).orderBy(outer, F.col(inner).isNotNull(), F.desc("count"), inner)


def missing_rate(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Rows, rows without ``column`` and their share, per key or over all rows."""
    gone = F.count_if(F.col(column).isNull())
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), gone.alias("missing"), F.try_divide(gone, F.count(F.lit(1))).alias("rate")
    )


def oldest_stamp(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """One row: the oldest date among the rows that count, null when there is none."""
    rows = df if where is None else df.filter(where)
    return rows.agg(F.min(column).alias("stamp"))


def oldest_of(*columns: tuple[DataFrame, str]) -> DataFrame:
    """One row: the oldest date over several tables and its month.

    Each table is reduced to its own oldest date before they are stacked.
    """
    stacked = reduce(DataFrame.unionByName, [oldest_stamp(df, c).select(F.col("stamp").cast("string")) for df, c in columns])
    return stacked.agg(F.min("stamp").alias("stamp")).select("stamp", F.substring("stamp", 1, 7).alias("month"))


def length_stats(df: DataFrame, length: Column) -> DataFrame:
    """One row: smallest, upper median (element n // 2) and largest length.

    Rows shrink to one count per length first; the running sum is over those.
    """
    sizes = df.groupBy(length.cast("bigint").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = sizes.withColumn("upto", F.sum("n").over(Window.orderBy("len"))).withColumn("total", F.sum("n").over(every))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("len")))
    return run.agg(
        F.sum("n").alias("chunks"), F.min("len").alias("min_len"), middle.alias("median_len"), F.max("len").alias("max_len")
    )


def platform_counts(platforms: DataFrame) -> DataFrame:
    """One row: active platforms, and those for shopping and for delivery."""
    delivery = F.col("kind") == "delivery"
    return platforms.filter("status = 'active'").agg(
        F.count(F.lit(1)).alias("active"), F.count_if(~delivery).alias("shopping"), F.count_if(delivery).alias("delivery")
    )


def region_limited_names(platforms: DataFrame, *keys: str, limit: int = fixed.CHUNK_MAX) -> DataFrame:
    """(keys, no, names): names of active region-limited platforms in display order, joined by ", " into texts of at most ``limit`` characters.

    A list of any length is filled over many tasks; the source's lists fit into one text.
    """
    kept = platforms.filter((F.col("status") == "active") & F.col("region_limited"))
    return pack_rows(kept, keys, ["ord", "name"], "name", ", ", limit).withColumnRenamed("text", "names")


def display_order(platforms: DataFrame) -> DataFrame:
    return platforms.orderBy(F.asc_nulls_last("ord"), "name", "id")


def platform_list(platforms: DataFrame, kind: str | None = None) -> DataFrame:
    """Active platforms for the public list, optionally of one kind."""
    kept = platforms.filter("status = 'active'")
    return kept if kind is None else kept.filter(F.col("kind") == kind)


def verdict_counts(table: DataFrame) -> DataFrame:
    return group_counts(table, "verdict")


def newest(reports: DataFrame, page: int = 0, size: int = 10) -> DataFrame:
    """One page of reports, newest first."""
    from waymark.operators.filters import page_bounds

    page, size = page_bounds(page, size, fixed.REPORT_PAGE_SIZE_MAX)
    return reports.orderBy(F.desc("created_at"), F.desc("id")).offset(page * size).limit(size)


def visit_totals(daily: DataFrame, today: Column) -> DataFrame:
    """One row: visits of ``today`` and of all days, zero where there are none."""
    return daily.agg(
        F.coalesce(F.sum(F.when(F.col("day") == today, F.col("count"))), F.lit(0)).alias("today"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
    )


def landed_vs_declared(rows: DataFrame, pages: DataFrame, key: str = "district") -> DataFrame:
    """Rows landed beside the count the source declares, per district."""
    landed = group_counts(rows, key).withColumnRenamed("count", "landed")
    declared = pages.groupBy(key).agg(F.max("total_cnt").alias("declared"))
    n = F.coalesce("landed", F.lit(0))
    return declared.join(landed, key, "full_outer").select(
        key, "declared", n.alias("landed"), (~F.col("declared").eqNullSafe(n)).alias("differs"),
    )


def by_chain(stores: DataFrame) -> DataFrame:
    return stores.orderBy("region", "brand_cat", "brand", "name", "id")
