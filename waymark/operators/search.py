"""Pages of places: by name, by id, nearest first; map pins; answer summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.values import nearness
from waymark.operators.filters import PlaceFilter, page_bounds, with_coordinates
from waymark.schema import PIN_COLUMNS, PLACE_COLUMNS


def matching(places: DataFrame, flt: PlaceFilter) -> DataFrame:
    return places.filter(flt.column())


def total(places: DataFrame, flt: PlaceFilter) -> DataFrame:
    """One row: the number of places that match (rows without coordinates count)."""
    return matching(places, flt).agg(F.count(F.lit(1)).alias("total"))


def page_of(
    places: DataFrame,
    flt: PlaceFilter,
    page: int = 0,
    size: int = 50,
    sort: str | None = None,
    user_lat: float | None = None,
    user_lng: float | None = None,
) -> DataFrame:
    """One page of the list view.

    Each task keeps its own first ``offset + size`` rows, so only those are
    merged.  Ties end on ``id``; names sort in binary order.
    """
    page, size = page_bounds(page, size)
    if sort == "dist" and user_lat is not None and user_lng is not None:
        order = [F.asc_nulls_last(nearness(F.col("lat"), F.col("lng"), user_lat, user_lng)), F.asc("id")]
    elif sort == "name":
        order = [F.asc_nulls_last("name"), F.asc("id")]
    else:
        order = [F.asc("id")]
    return matching(places, flt).select(*PLACE_COLUMNS).orderBy(*order).offset(page * size).limit(size)


def with_total(page: DataFrame, places: DataFrame, flt: PlaceFilter) -> DataFrame:
    """The page's rows with the filter's total beside each (a scalar subquery, no join)."""
    return page.withColumn("total", total(places, flt).scalar())


def pins(places: DataFrame, flt: PlaceFilter, max_pins: int = fixed.MAP_MAX_PINS) -> DataFrame:
    """Map pins, or no rows at all when more than ``max_pins`` places match.

    The check counts at most ``max_pins + 1`` rows; rows without coordinates count.
    """
    found = matching(places, flt)
    over = found.select("id").limit(max_pins + 1).agg((F.count(F.lit(1)) > max_pins).alias("over"))
    return found.filter(with_coordinates()).select(*PIN_COLUMNS).filter(~over.scalar())


def map_mode(places: DataFrame, flt: PlaceFilter, max_pins: int = fixed.MAP_MAX_PINS) -> DataFrame:
    """One row: total, whether pins are left out, and what the map should draw."""
    over = F.col("total") > max_pins
    return total(places, flt).select(
        "total",
        over.alias("truncated"),
        F.when(over, "clusters").otherwise("pins").alias("mode"),
    )


def map_answer(places: DataFrame, flt: PlaceFilter, max_pins: int = fixed.MAP_MAX_PINS) -> DataFrame:
    """One row: pins by id, total, and whether pins are left out because more than ``max_pins`` places match.

    At most ``max_pins`` pins are ever gathered.
    """
    shown = pins(places, flt, max_pins).agg(F.array_sort(F.collect_list(F.struct(*PIN_COLUMNS))).alias("pins"))
    return shown.select("pins", total(places, flt).scalar().alias("total")).withColumn("truncated", F.col("total") > max_pins)


def answer_lines(places: DataFrame, flt: PlaceFilter, size: int = 5) -> DataFrame:
    """First places by name as text lines for an answer (name, category, address, means of payment)."""
    yes_no = lambda c: F.when(F.col(c) == "Y", "가능").otherwise("불가")
    return page_of(places, flt, 0, size, "name").select(
        "id",
        F.concat(
            F.lit("- "), F.concat_ws(" | ", "name", "cat", "addr"),
            F.lit(" | 카드형 "), yes_no("card"), F.lit("·QR "), yes_no("qr"),
        ).alias("line"),
    )
