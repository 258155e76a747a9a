"""Schemas of the tables and files the library works on."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D = T.StringType(), T.DoubleType()


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, _S) for n in names]


PLACE = T.StructType(
    [T.StructField("id", _S, False)]
    + _strings("name", "cat", "brand", "region", "si", "gu", "dong", "addr", "market", "market_type", "paper", "card", "qr")
    + [T.StructField("lat", _D), T.StructField("lng", _D)]
)
PLACE_COLUMNS = PLACE.fieldNames()
PIN_COLUMNS = ["id", "name", "cat", "brand", "addr", "market", "card", "qr", "lat", "lng"]

#: A place as it stands inside a snapshot file: the region is named by the file.
SNAPSHOT_ITEM = T.StructType([f for f in PLACE.fields if f.name != "region"])
SNAPSHOT = T.StructType(
    [
        T.StructField("meta", T.StructType(_strings("region", "collected_on", "source", "source_url", "scope", "note"))),
        T.StructField("items", T.ArrayType(SNAPSHOT_ITEM)),
    ]
)

PUBLIC_CSV = T.StructType(_strings("name", "market", "region", "items", "paper", "digital", "year"))

#: One row of the place source API.
API_PLACE = T.StructType(
    _strings("frCd", "frcsNm", "frcsAddr", "addrCd", "placeTypeNm", "mrktNm", "mrktType", "paperYn", "cardYn", "qrYn")
    + [T.StructField("latitude", _D), T.StructField("longitude", _D)]
)
#: One row of the platform source API.
API_PLATFORM = T.StructType(
    [T.StructField("postNo", T.IntegerType()), T.StructField("ordNo", T.IntegerType())]
    + _strings("ecommerceCategoryNm", "ecommerceMgtNm", "ecommerceIntroCn1", "ecommerceIntroCn2", "ecommerceUrl")
)


def envelope(row: T.StructType) -> T.StructType:
    """The page envelope both source APIs use."""
    data = T.StructType(
        [
            T.StructField("totalCnt", T.LongType()),
            T.StructField("totalPage", T.IntegerType()),
            T.StructField("list", T.ArrayType(row)),
        ]
    )
    return T.StructType(_strings("resCode", "resMsg") + [T.StructField("data", data)])


PLATFORM = T.StructType(
    [
        T.StructField("id", _S, False),
        T.StructField("post_no", T.IntegerType()),
        T.StructField("ord", T.IntegerType()),
        *_strings("kind", "name", "summary", "note", "url"),
        T.StructField("region_limited", T.BooleanType()),
        T.StructField("source_url", _S),
        T.StructField("collected_on", T.DateType()),
        T.StructField("status", _S),
    ]
)
PLATFORM_COLUMNS = PLATFORM.fieldNames()
#: Columns a collected feed may change; the others are curated by hand.
FEED_COLUMNS = ["post_no", "ord", "kind", "name", "summary", "url"]

CHUNK_COLUMNS = ["source", "section", "content", "url", "collected_on"]
