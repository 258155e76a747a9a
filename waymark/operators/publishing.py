"""Comparing, guarding and reconciling whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.text import name_key
from waymark.operators.ordering import keep_first
from waymark.schema import FEED_COLUMNS, PLATFORM_COLUMNS


# ---- snapshot guard ---------------------------------------------------------
def counts_by(df: DataFrame, key: str, out: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(out))


def compare_counts(new: DataFrame, old: DataFrame, key: str = "region") -> DataFrame:
    """New and old row counts per key; both sides are counted before they meet."""
    return (
        counts_by(new, key, "new_count").join(counts_by(old, key, "old_count"), key, "full_outer")
        .select(
            key,
            F.coalesce("new_count", F.lit(0)).alias("new_count"),
            F.coalesce("old_count", F.lit(0)).alias("old_count"),
        )
    )


def guard_reasons(
    new: DataFrame,
    old: DataFrame,
    key: str = "region",
    min_total: int = fixed.GUARD_MIN_TOTAL,
    tolerance: float = fixed.GUARD_TOLERANCE,
) -> DataFrame:
    """Reasons against publishing ``new`` in place of ``old``; no rows means it may go out.

    A key without old rows is not judged, and a change of exactly ``tolerance`` passes.
    """
    compared = compare_counts(new, old, key)
    moved = F.try_divide(F.abs(F.col("new_count") - F.col("old_count")), F.col("old_count"))
    changed = compared.withColumn("change", moved).filter(F.col("change") > tolerance).select(
        F.col(key).cast("string").alias("key"), "old_count", "new_count", "change",
        F.concat(
            F.col(key).cast("string"), F.lit(" "), F.col("old_count").cast("string"), F.lit("→"),
            F.col("new_count").cast("string"), F.lit(" (+"), F.format_string("%.1f", F.col("change") * 100), F.lit("%)"),
        ).alias("reason"),
    )
    short = compared.agg(F.coalesce(F.sum("new_count"), F.lit(0)).alias("n")).filter(F.col("n") < min_total).select(
        F.lit(None).cast("string").alias("key"), F.lit(None).cast("bigint").alias("old_count"),
        F.col("n").alias("new_count"), F.lit(None).cast("double").alias("change"),
        F.concat(F.lit("총계 "), F.col("n").cast("string"), F.lit(f" < {min_total}")).alias("reason"),
    )
    return changed.unionByName(short)


# ---- upserts -----------------------------------------------------------------
def keyed_upsert(store: DataFrame, rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``store`` with the ``columns`` of matching rows replaced, nulls included, and new rows added."""
    incoming = rows.select(F.col(key), F.lit(True).alias("_in"), *[F.col(c).alias(f"_{c}") for c in columns])
    merged = store.join(incoming, key, "full_outer")
    return merged.select(
        *[
            F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in store.columns
        ]
    )


def match_feed(store: DataFrame, feed: DataFrame, seq: str = "seq") -> DataFrame:
    """Feed rows with the store id they belong to and whether that row is new.

    The collected number decides first, then the name without white space and
    case.  Where several store rows share a number or a name, the greatest id
    stands for the one read last.  A feed row without a number gets a join key
    of its own, so such rows neither match nor gather in one task.
    """
    by_post = store.filter(F.col("post_no").isNotNull()).groupBy(F.col("post_no").cast("string").alias("_post")).agg(
        F.max("id").alias("_id_by_post")
    )
    by_name = store.groupBy(name_key(F.col("name")).alias("_name")).agg(F.max("id").alias("_id_by_name"))
    keyed = feed.withColumn(
        "_post", F.coalesce(F.col("post_no").cast("string"), F.concat(F.lit("~"), F.col(seq).cast("string")))
    ).withColumn("_name", name_key(F.col("name")))
    found = F.coalesce("_id_by_post", "_id_by_name")
    # A new row without a number is named by its name, so that two of them stay two.
    new_id = F.concat(F.lit("ec-"), F.coalesce(F.col("post_no").cast("string"), F.substring(F.sha1(F.coalesce("_name", F.lit(""))), 1, 10)))
    return (
        keyed.join(by_post, "_post", "left").join(by_name, "_name", "left")
        .withColumn("target", F.coalesce(found, new_id))
        .withColumn("action", F.when(found.isNull(), "inserted").otherwise("updated"))
        .drop("_post", "_name", "_id_by_post", "_id_by_name")
    )


def removed_rows(store: DataFrame, matched: DataFrame) -> DataFrame:
    """Store rows that no feed row matched and that were not marked before; their date stays."""
    gone = store.join(matched.select(F.col("target").alias("id")), "id", "left_anti")
    return gone.filter(~F.col("status").eqNullSafe("removed")).withColumn("status", F.lit("removed"))


def reconcile(store: DataFrame, feed: DataFrame, day: Column, source_url: str, seq: str = "seq") -> DataFrame:
    """The store after a feed: matched rows updated, new rows added, missing rows marked.

    Only collected columns change on a match; ``note``, ``region_limited`` and
    ``source_url`` are curated.  Where several feed rows hit one id the last
    counts.  ``action`` tells what happened to each row.
    """
    return reconciled(store, feed, day, source_url, seq).select(*PLATFORM_COLUMNS, "action")


def reconciled(store: DataFrame, feed: DataFrame, day: Column, source_url: str, seq: str = "seq") -> DataFrame:
    """``reconcile`` with ``known`` (the row stood in the store) and how many feed rows ``inserted`` or ``updated`` it."""
    matched = match_feed(store, feed, seq)
    winners = matched.groupBy(F.col("target").alias("id")).agg(
        F.max_by(F.struct(*FEED_COLUMNS), seq).alias("_new"),
        F.count_if(F.col("action") == "inserted").alias("_inserted"), F.count_if(F.col("action") == "updated").alias("_updated"),
    )
    both = store.withColumn("_known", F.lit(True)).join(winners, "id", "full_outer")
    hit, known = F.col("_new").isNotNull(), F.col("_known").isNotNull()
    fresh = {"note": F.lit(""), "region_limited": F.lit(False), "source_url": F.lit(source_url)}
    gone = ~hit & ~F.col("status").eqNullSafe("removed")

    def value(c: str) -> Column:
        if c in FEED_COLUMNS:
            return F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c))
        if c in fresh:
            return F.when(known, F.col(c)).otherwise(fresh[c])
        if c == "collected_on":
            return F.when(hit, day).otherwise(F.col(c))
        if c == "status":
            return F.when(hit, "active").when(gone, "removed").otherwise(F.col(c))
        return F.col(c)

    action = F.when(hit & known, "updated").when(hit, "inserted").when(gone, "removed").otherwise("kept")
    total = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(
        *[value(c).alias(c) for c in PLATFORM_COLUMNS], action.alias("action"), known.alias("known"),
        total("_inserted").alias("inserted"), total("_updated").alias("updated"),
    )


def reconcile_counts(store: DataFrame, feed: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: rows before and after, and feed rows inserted and updated, and rows newly removed."""
    hits = match_feed(store, feed, seq).groupBy("target").agg(
        F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "updated").alias("updated")
    )
    both = store.select(F.col("id").alias("target"), "status", F.lit(True).alias("_known")).join(hits, "target", "full_outer")
    known, gone = F.col("_known").isNotNull(), F.col("inserted").isNull() & ~F.col("status").eqNullSafe("removed")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(
        F.count_if(known).alias("before"), total("inserted").alias("inserted"), total("updated").alias("updated"),
        F.count_if(gone).alias("removed"), F.count(F.lit(1)).alias("after"),
    )


def apply_status(reports: DataFrame, updates: DataFrame, states: Sequence[str] = fixed.REPORT_STATES) -> DataFrame:
    """Reports with the latest valid status update per id; other states are ignored."""
    latest = keep_first(updates.filter(F.col("status").isin(list(states))), ["id"], [F.desc("seq")])
    return (
        reports.join(latest.select("id", F.col("status").alias("_new")), "id", "left")
        .withColumn("status", F.coalesce("_new", "status")).drop("_new")
    )
