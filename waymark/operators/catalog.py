"""The goods catalog: names, labels, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def flat_taxonomy(taxonomy: DataFrame) -> DataFrame:
    """(code, label, parent) of a two-level taxonomy; a child reads "parent/child"."""
    children = taxonomy.select(F.col("id").alias("parent"), F.col("label").alias("_p"), F.explode("subs").alias("s")).select(
        F.col("s.id").alias("code"), F.concat_ws("/", "_p", "s.label").alias("label"), "parent"
    )
    return taxonomy.select(F.col("id").alias("code"), "label", F.lit(None).cast("string").alias("parent")).unionByName(children)


def with_platform_name(catalog: DataFrame, platforms: DataFrame) -> DataFrame:
    """Catalog entries with the platform's name, the id where it has none."""
    names = platforms.select("id", F.col("name").alias("_name"))
    return catalog.join(names, "id", "left").withColumn("name", F.coalesce("_name", "id")).drop("_name")


def with_labels(catalog: DataFrame, codes: DataFrame, column: str = "cats") -> DataFrame:
    """Entries with the labels of their codes in order; an unknown code stands for itself.

    Codes are joined one by one, and each entry gathers its own labels again; of
    labels that share a code the smallest stands.  No codes, no labels.
    """
    labels = codes.groupBy("code").agg(F.min("label").alias("label"))
    spread = catalog.select("id", F.posexplode(column).alias("pos", "code"))
    joined = spread.join(labels, "code", "left").select("id", F.struct("pos", F.coalesce("label", "code").alias("l")).alias("e"))
    gathered = joined.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["l"]).alias("labels"))
    return catalog.join(gathered, "id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def unmapped_codes(catalog: DataFrame, codes: DataFrame, column: str = "cats") -> DataFrame:
    """Codes that entries use but the taxonomy does not define, with their number of uses."""
    used = catalog.select(F.explode(column).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("uses"))
    return used.join(codes.select("code"), "code", "left_anti")


def filter_catalog(
    platforms: DataFrame, catalog: DataFrame, codes: DataFrame,
    kind: str | None = None, code: str | None = None, brand: str | None = None,
) -> DataFrame:
    """Platforms of a kind that sell a goods category or a brand.

    A parent category also finds its children.  Platforms without a catalog
    entry drop out as soon as a goods or brand filter is on.
    """
    kept = platforms if kind is None else platforms.filter(F.col("kind") == kind)
    if code is None and brand is None:
        return kept
    wanted: Column = F.lit(True)
    entries = catalog.select("id", "cats", "brands")
    if code is not None:
        under = codes.filter(F.col("parent") == code).select("code").union(codes.sparkSession.range(1).select(F.lit(code))).distinct()
        sells = entries.select("id", F.explode("cats").alias("code")).join(under, "code", "left_semi").select("id").distinct()
        entries = entries.join(sells, "id", "left_semi")
    if brand is not None:
        wanted = wanted & F.array_contains("brands", brand)
    return kept.join(entries.filter(wanted).select("id"), "id", "left_semi")


def merge_confirmed(old: Column, new: Column) -> Column:
    """Once confirmed stays: the union of old and new values."""
    return F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))
