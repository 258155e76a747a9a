"""Operators that depend on row order: keep-first, numbering, slices, samples.

None of them puts all rows, or all rows of one key, into one task:

* keep-first and top-k use ``row_number() <= k``, which Spark prunes inside
  every map task before it shuffles (window group limit);
* numbering counts rows per block first and adds the blocks' offsets, so a key
  that holds a third of all rows is spread over many blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import fixed
from waymark.session import cut_lineage


def _sort(columns: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def keep_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str], k: int = 1) -> DataFrame:
    """The first ``k`` rows of every key in the given order (``order`` must be total)."""
    w = Window.partitionBy(*keys).orderBy(*_sort(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def number_in_group(df: DataFrame, keys: Sequence[str], position: str, out: str, block: int = 1_000_000) -> DataFrame:
    """1, 2, 3 … per key in order of ``position``, a unique non-negative number per row.

    Rows are numbered inside blocks of ``block`` positions; the rows of one key
    before each block are known from counts per (key, block).
    """
    keyed = df.withColumn("_block", F.floor(F.col(position) / F.lit(block)).cast("bigint"))
    by = [*keys, "_block"]
    local = keyed.withColumn("_local", F.row_number().over(Window.partitionBy(*by).orderBy(position)))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter("_before > 0").drop("_n")
    )
    return (
        local.join(offsets, by, "left")
        .withColumn(out, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint"))
        .drop("_block", "_local", "_before")
    )


def number_all(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """1, 2, 3 … over all rows in sorted order, without a one-task sort.

    Rows are range-partitioned and sorted, then written once, so that the
    counts per partition and the rows they number come from the same result.
    """
    cuts = df.repartitionByRange(*_sort(order)).sortWithinPartitions(*_sort(order))
    fixed_rows = cut_lineage(cuts.withColumn("_pos", F.monotonically_increasing_id()))
    part = F.shiftright("_pos", 33)
    # One row per partition of the sort: the count is set by the job, not by the data.
    sizes = fixed_rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_min"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_min", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        fixed_rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_pos") - F.col("_min") + F.col("_before") + 1).cast("bigint"))
        .drop("_pos", "_part", "_min", "_before")
    )


def daily_slice(df: DataFrame, key: str, day: Column, cycle: int = fixed.SURVEY_CYCLE) -> DataFrame:
    """The ids that are due on ``day`` when all sorted ids are visited once per ``cycle`` days."""
    numbered = number_all(df, [key], "_no")
    return numbered.filter((F.col("_no") - 1) % cycle == F.pmod(F.unix_date(day), F.lit(cycle))).drop("_no")


def hashed_ids(
    df: DataFrame, code: Column, parts: Sequence[Column], position: str, out: str = "id"
) -> DataFrame:
    """``xx-<hash>`` of the given parts; equal rows get -2, -3 … in order of ``position``."""
    digest = F.substring(F.sha1(F.concat_ws("|", code, *[F.coalesce(p, F.lit("")) for p in parts])), 1, 10)
    staged = df.withColumn("_code", code).withColumn("_hash", digest)
    numbered = number_in_group(staged, ["_code", "_hash"], position, "_nth")
    base = F.concat(F.substring("_code", 1, 2), F.lit("-"), F.col("_hash"))
    suffix = F.when(F.col("_nth") > 1, F.concat(F.lit("-"), F.col("_nth").cast("string"))).otherwise("")
    return numbered.withColumn(out, F.concat(base, suffix)).drop("_code", "_hash", "_nth")


def seeded_sample(df: DataFrame, key: str, seed: int, n: int = 20) -> DataFrame:
    """``n`` rows picked by a hash of key and seed: the same rows on every run and layout."""
    return df.orderBy(F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)

