"""The list that follows a marker in a page's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.text import once, strip


def list_after(
    text: Column,
    marker: str = fixed.DIRECTORY_MARKER,
    max_len: int = fixed.LIST_ITEM_MAX,
    tolerance: int = fixed.LIST_TOLERANCE,
    signal: str = fixed.PRODUCT_SIGNAL,
) -> Column:
    """Short lines that follow ``marker`` up to the start of the goods area.

    A line is an item unless it is long or carries a goods signal; the list ends
    at ``tolerance`` non-items in a row.
    """
    def tagged(t: Column) -> Column:
        rest = F.substring(t, F.locate(marker, t), F.length(t))
        found = F.filter(F.transform(F.split(rest, "\n"), strip), lambda s: s != "")
        return F.transform(found, lambda s: F.struct(s.alias("line"), ((F.length(s) <= max_len) & ~s.rlike(signal)).alias("item")))

    def kept(rows: Column) -> Column:
        # The list ends at the first run of `tolerance` misses; row 0 holds the marker itself.
        flags = F.array_join(F.transform(rows, lambda r: F.when(r["item"], "1").otherwise("0")), "")
        first = F.locate("0" * tolerance, flags, 2)
        end = F.when(first > 0, first - 1).otherwise(F.size(rows))
        items = once(end, lambda e: F.filter(rows, lambda r, i: (i > 0) & (i < e) & r["item"]))
        return F.transform(items, lambda r: r["line"])

    # A computed text is computed once.
    return once(text, lambda t: F.when(F.locate(marker, t) > 0, once(tagged(t), kept)).otherwise(F.array().cast("array<string>")))
