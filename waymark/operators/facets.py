"""Facet counts, and the hint for searches that find nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import fixed
from waymark.operators.filters import PlaceFilter

FACETS = {"cat": "cat", "brand": "brand", "mtype": "market_type"}


def facet(places: DataFrame, flt: PlaceFilter, name: str) -> DataFrame:
    """Counts of one facet under all filters but its own; null keys drop out, "" stays."""
    column = FACETS[name]
    return (
        places.filter(flt.column(without={name}))
        .filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("key"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "key")
    )


def facets(places: DataFrame, flt: PlaceFilter) -> DataFrame:
    """All three facets from one scan.

    The filters that no facet owns are applied to rows.  Rows then shrink to one
    count per (cat, brand, market type), and only those counts are spread over
    the facets whose two other filters they pass.
    """
    combos = (
        places.filter(flt.column(without=FACETS))
        .groupBy(*FACETS.values())
        .agg(F.count(F.lit(1)).alias("n"))
    )
    parts = flt.parts()

    def entry(name: str) -> Column:
        others = [parts[o] for o in FACETS if o != name and o in parts]
        keep = F.col(FACETS[name]).isNotNull()
        for other in others:
            keep = keep & other
        return F.when(keep, F.struct(F.lit(name).alias("facet"), F.col(FACETS[name]).alias("key")))

    return (
        combos.select("n", F.explode(F.array(*[entry(n) for n in FACETS])).alias("e"))
        .filter(F.col("e").isNotNull())
        .groupBy("e.facet", "e.key")
        .agg(F.sum("n").alias("count"))
        .orderBy("facet", F.desc("count"), "key")
    )


def brands_with_head(places: DataFrame, flt: PlaceFilter, top: int = fixed.TOP_BRANDS) -> DataFrame:
    """Brand counts, the ``top`` most common ones marked as the head of the list.

    The head is a query of ``top`` rows, kept by every task as it counts; no task ranks all brands.
    """
    counts = facet(places, flt, "brand").select("key", "count")
    # A side of ``top`` rows.
    head = F.broadcast(counts.orderBy(F.desc("count"), "key").limit(top).select(F.col("key").alias("_key"), F.lit(True).alias("head")))
    marked = counts.join(head, F.col("key") == F.col("_key"), "left").select("key", "count", F.coalesce("head", F.lit(False)).alias("head"))
    return marked.orderBy(F.desc("count"), "key")


def relaxation(places: DataFrame, flt: PlaceFilter) -> DataFrame:
    """Counts under ever wider filters, from one scan, and the first one that finds places.

    Steps widen the region level by level, then drop the category filters, then both.
    """
    narrow = ["dong", "gu", "si", "region"]
    cats = ["cat", "brand", "mtype", "digital"]
    present = flt.parts()
    levels = [n for n in narrow if n in present]
    steps: list[tuple[str, set[str]]] = [("as asked", set())]
    steps += [(f"without {levels[i]}", set(levels[: i + 1])) for i in range(len(levels))]
    if any(c in present for c in cats):
        steps.append(("without categories", set(cats)))
        if levels:
            steps.append(("without both", set(cats) | set(levels)))
    counts = places.agg(
        *[F.count_if(flt.column(without=drop)).alias(f"s{i}") for i, (_, drop) in enumerate(steps)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("step"), F.lit(label).alias("relaxed"), F.col(f"s{i}").alias("count"))
            for i, (label, _) in enumerate(steps)
        ]
    )
    first = F.coalesce(*[F.when(F.col(f"s{i}") > 0, F.lit(i)) for i in range(len(steps))], F.lit(-1))
    return (
        counts.select(rows.alias("rows"), first.alias("first"))
        .selectExpr("inline(rows)", "first")
        .select("step", "relaxed", "count", (F.col("step") == F.col("first")).alias("chosen"))
        .orderBy("step")
    )
