"""Small value columns: times, links, client keys, distances, verdict texts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.text import strip

EARTH_RADIUS_M = 6_371_000.0


# ---- time ------------------------------------------------------------------
def local_minute(ts: Column, zone: str = fixed.LOCAL_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), fixed.MINUTE_TEXT)


def local_day(ts: Column, zone: str = fixed.LOCAL_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def mail_date_to_local(text: Column, zone: str = fixed.LOCAL_ZONE) -> Column:
    """Minute text of a mail-style date ("Tue, 09 Dec 2025 04:00:00 GMT"), null if unreadable."""
    body = F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", "")
    forms = [f"d MMM yyyy HH:mm{seconds} {zone_form}" for seconds in (":ss", "") for zone_form in ("z", "Z")]
    parsed = F.coalesce(*(F.try_to_timestamp(body, F.lit(f)) for f in forms))
    return local_minute(parsed, zone)


# ---- feeds -------------------------------------------------------------------
def plain_text(c: Column) -> Column:
    """Markup text without its CDATA marks and with six entities resolved, ampersand first."""
    for mark, plain in [
        ("<![CDATA[", ""), ("]]>", ""), ("&amp;", "&"), ("&lt;", "<"),
        ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ]:
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return strip(c)


def title_without_source(title: Column, source: Column, min_index: int = fixed.TITLE_SUFFIX_MIN) -> Column:
    """Drop a trailing " - source"; without a known source, a late last " - " part."""
    suffix = F.concat(F.lit(" - "), source)
    last = F.length(title) - F.locate(" - ", F.reverse(title)) - 2  # zero-based, valid when found
    return (
        F.when(F.coalesce(title.endswith(suffix), F.lit(False)), F.substring(title, F.lit(1), F.length(title) - F.length(suffix)))
        .when(title.contains(" - ") & (last > min_index), F.substring(title, F.lit(1), last))
        .otherwise(title)
    )


# ---- links and clients ---------------------------------------------------------
def is_deep_link(url: Column) -> Column:
    """Two or more path segments, or a query; unreadable addresses are not deep."""
    path = F.try_parse_url(url, F.lit("PATH"))
    depth = F.size(F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != ""))
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    readable = F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull()
    return F.coalesce(readable & ((depth >= 2) | (query != "")), F.lit(False))


def client_key(forwarded: Column, remote: Column) -> Column:
    """Last non-blank forwarded hop, else the remote address."""
    hops = F.filter(F.transform(F.split(forwarded, ","), strip), lambda h: h != "")
    return F.coalesce(F.try_element_at(hops, F.lit(-1)), remote)


# ---- distance ------------------------------------------------------------------
def nearness(lat: Column, lng: Column, user_lat: float, user_lng: float) -> Column:
    """Squared flat-earth distance; orders places like the true distance within a region."""
    shrink = math.cos(math.radians(user_lat)) ** 2
    d_lat, d_lng = lat - F.lit(float(user_lat)), lng - F.lit(float(user_lng))
    return d_lat * d_lat + d_lng * d_lng * F.lit(shrink)


def metres(lat: Column, lng: Column, user_lat: float, user_lng: float) -> Column:
    """Great-circle distance in metres (haversine; the label's formula is our choice)."""
    a, b = F.radians(lat), F.lit(math.radians(user_lat))
    half_lat, half_lng = (a - b) / 2, (F.radians(lng) - F.lit(math.radians(user_lng))) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(half_lng), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(h))


def distance_label(m: Column) -> Column:
    return F.when(m < 1000, F.concat(F.round(m, 0).cast("bigint").cast("string"), F.lit("m"))).otherwise(
        F.concat(F.format_string("%.1f", m / 1000), F.lit("km"))
    )


# ---- platforms -------------------------------------------------------------------
def platform_kind(label: Column, kinds=fixed.PLATFORM_KINDS) -> Column:
    label = strip(F.coalesce(label, F.lit("")))
    known = F.coalesce(*[F.when(label == k, F.lit(v)) for k, v in kinds.items()])
    return F.coalesce(known, F.lower(label))


def joined_or_null(*parts: Column) -> Column:
    """Non-blank parts joined by ", ", null when there is none."""
    cleaned = [F.nullif(strip(p), F.lit("")) for p in parts]
    return F.nullif(F.concat_ws(", ", *cleaned), F.lit(""))
