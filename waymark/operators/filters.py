"""The place filter: thirteen optional fields that become one column."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.text import or_empty


def has_value(s: str | None) -> bool:
    return s is not None and s.strip() != "" and s != fixed.ALL


def csv_values(s: str | None) -> list[str] | None:
    """Values of "A,B"; None when nothing is left to filter on."""
    wanted = [v for v in (part.strip() for part in (s or "").split(",")) if v and v != fixed.ALL]
    return wanted or None


def clamp(value: float, low: float, high: float) -> float:
    return max(low, min(high, value))


def page_bounds(page: int, size: int, max_size: int = fixed.PAGE_SIZE_MAX) -> tuple[int, int]:
    """Page number and page size inside their allowed ranges."""
    return max(page, 0), int(clamp(size, 1, max_size))


def like_pattern(q: str) -> str:
    """Pattern for a keyword; ``%`` and ``_`` in it stay wildcards, a stray backslash is dropped."""
    body = re.sub(r"\\([^%_\\])", r"\1", q.strip().lower())
    return f"%{body}%"


@dataclass(frozen=True)
class PlaceFilter:
    region: str | None = None
    si: str | None = None
    gu: str | None = None
    dong: str | None = None
    cat: str | None = None
    brand: str | None = None
    mtype: str | None = None
    digital: bool | None = None
    q: str | None = None
    min_lat: float | None = None
    max_lat: float | None = None
    min_lng: float | None = None
    max_lng: float | None = None

    @property
    def has_bounds(self) -> bool:
        return None not in (self.min_lat, self.max_lat, self.min_lng, self.max_lng)

    def parts(self) -> dict[str, Column]:
        """One column per filter that is present, keyed by the filter's name."""
        out: dict[str, Column] = {}
        for name in ("region", "si", "gu"):
            if has_value(getattr(self, name)):
                out[name] = F.col(name) == getattr(self, name)
        if has_value(self.dong):
            dong = F.col("dong")
            out["dong"] = dong.isNull() if self.dong == fixed.UNKNOWN_DONG else dong == self.dong
        for name, column in (("cat", "cat"), ("brand", "brand"), ("mtype", "market_type")):
            values = csv_values(getattr(self, name))
            if values:
                out[name] = F.col(column).isin(values)
        if self.digital:
            out["digital"] = (F.col("card") == "Y") | (F.col("qr") == "Y")
        if self.has_bounds:
            lat, lng = F.col("lat"), F.col("lng")
            out["bounds"] = lat.between(self.min_lat, self.max_lat) & lng.between(self.min_lng, self.max_lng)
        if has_value(self.q):
            pattern = like_pattern(self.q)
            fields = [F.lower(or_empty(F.col(c))).like(pattern) for c in ("name", "addr", "market")]
            out["q"] = functools.reduce(operator.or_, fields)
        return out

    def column(self, without: Collection[str] = ()) -> Column:
        """AND of the filters that are present, leaving out those named in ``without``."""
        kept = [c for name, c in self.parts().items() if name not in without]
        return functools.reduce(operator.and_, kept, F.lit(True))


def with_coordinates() -> Column:
    return F.col("lat").isNotNull() & F.col("lng").isNotNull()
