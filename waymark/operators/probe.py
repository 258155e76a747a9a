"""Keyword probes over store names, and the store list built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.text import chain_of, or_empty, region_of_code, spread, strip


def keyword_hits(name: Column, keywords: Sequence[str] = fixed.PROBE_KEYWORDS) -> Column:
    """Keywords a name contains, in probing order (the list is part of the plan, nothing is joined)."""
    words = F.array(*[F.lit(k) for k in keywords])
    return F.filter(words, lambda k: F.contains(or_empty(name), k))


def probed(stores: DataFrame, name: str = "name", keywords: Sequence[str] = fixed.PROBE_KEYWORDS) -> DataFrame:
    """Stores that some keyword finds, each with the first keyword that does."""
    hits = stores.withColumn("_hits", keyword_hits(F.col(name), keywords)).filter(F.size("_hits") > 0)
    return hits.withColumn("keyword", F.element_at("_hits", 1)).withColumn("hits", F.size("_hits")).drop("_hits")


def hit_matrix(stores: DataFrame, name: str = "name", region: str = "region", keywords: Sequence[str] = fixed.PROBE_KEYWORDS) -> DataFrame:
    """Hits per keyword and region."""
    return (
        spread(stores, [region], keyword_hits(F.col(name), keywords), "keyword")
        .groupBy("keyword", region).agg(F.count(F.lit(1)).alias("count"))
    )


def duplicate_hits(found: DataFrame) -> DataFrame:
    """One row: all hits, stores found, and hits beyond the first of a store."""
    return found.agg(
        F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("stores"),
        (F.sum("hits") - F.count(F.lit(1))).alias("duplicates"),
    )


def chain_stores(found: DataFrame, districts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stores with their chain, stores no rule places), from one classification.

    A district code without a name stands for itself.
    """
    placed = (
        found.join(districts.select("addr_cd", F.col("addr_nm").alias("_district")), "addr_cd", "left")
        .withColumn("_chain", chain_of(F.col("name")))
        .withColumn("district", F.coalesce("_district", "addr_cd"))
        .withColumn("region", region_of_code(F.col("addr_cd")))
        .withColumn("name", strip(F.col("name")))
    )
    known = placed.filter(F.col("_chain").isNotNull()).select("*", "_chain.*").drop("_chain", "_district")
    unknown = placed.filter(F.col("_chain").isNull()).drop("_chain", "_district")
    return known, unknown
