"""Region options: which si, gu and dong lie under the chosen parents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.operators.filters import PlaceFilter, has_value


def _options(rows: DataFrame, level: str, rank: int) -> DataFrame:
    value: Column = F.col(level)
    unknown = value.isNull()
    if level == "dong":
        value = F.coalesce(value, F.lit(fixed.UNKNOWN_DONG))
    else:
        rows = rows.filter(~unknown)
    return rows.select(
        F.lit(rank).alias("rank"), F.lit(level).alias("level"), value.alias("value"), unknown.alias("unknown")
    ).distinct()


def region_options(places: DataFrame, region: str, si: str | None = None, gu: str | None = None) -> DataFrame:
    """Sorted options per level under the chosen parents; the unknown dong comes last."""
    here = places.filter(PlaceFilter(region=region).column())
    out: list[DataFrame] = []
    if region == fixed.FOUR_LEVEL_REGION:
        out.append(_options(here, "si", 1))
        if has_value(si):
            here = here.filter(F.col("si") == si)
            out.append(_options(here, "gu", 2))
            out.append(_options(here.filter(F.col("gu") == gu) if has_value(gu) else here, "dong", 3))
    else:
        out.append(_options(here, "gu", 2))
        if has_value(gu):
            out.append(_options(here.filter(F.col("gu") == gu), "dong", 3))
    return reduce(DataFrame.unionByName, out).orderBy("rank", "unknown", "value")


def region_tree(places: DataFrame) -> DataFrame:
    """Every (region, si, gu, dong) that occurs, with the unknown dong named, and its places."""
    return (
        places.groupBy("region", "si", "gu", F.coalesce("dong", F.lit(fixed.UNKNOWN_DONG)).alias("dong"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
