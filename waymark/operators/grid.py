"""Grid cells, cell sizes and places that share a coordinate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.operators.filters import PlaceFilter, clamp, with_coordinates


def clusters(places: DataFrame, flt: PlaceFilter, grid: float = 0.1) -> DataFrame:
    """Mean coordinate and number of places per grid cell, under the list's own filter."""
    g = F.lit(float(clamp(grid, fixed.GRID_MIN, fixed.GRID_MAX)))
    return (
        places.filter(flt.column() & with_coordinates())
        .groupBy(F.floor(F.col("lat") / g).alias("cell_y"), F.floor(F.col("lng") / g).alias("cell_x"))
        .agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.count(F.lit(1)).alias("count"))
    )


def cluster_total(cells: DataFrame) -> DataFrame:
    """Places in all cells; equals the list total where every match has coordinates."""
    return cells.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total"), F.count(F.lit(1)).alias("cells"))


def size_class(count: Column, steps: list[int] = fixed.CLUSTER_STEPS, min_size: int = fixed.CLUSTER_MIN_SIZE) -> Column:
    """Number of steps a count has reached, as text; too small a cell is drawn as a pin."""
    label = F.lit(str(len(steps)))
    for i in reversed(range(len(steps))):
        label = F.when(count < steps[i], F.lit(str(i))).otherwise(label)
    return F.when(count < min_size, F.lit("pin")).otherwise(label)


def shared_coordinates(places: DataFrame, flt: PlaceFilter) -> DataFrame:
    """Coordinates that hold several places: the count for the badge and the first id for the marker."""
    return (
        places.filter(flt.column() & with_coordinates())
        .groupBy("lat", "lng")
        .agg(F.count(F.lit(1)).alias("count"), F.min("id").alias("first_id"))
        .filter("count >= 2")
    )


def shared_members(places: DataFrame, flt: PlaceFilter) -> DataFrame:
    """The places behind each shared coordinate, one row each, so no group is gathered in one value."""
    return places.filter(flt.column()).join(shared_coordinates(places, flt), ["lat", "lng"]).select("lat", "lng", "count", "id", "name")
