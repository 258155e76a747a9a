"""The library's inputs, derived from the driver tables; each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.plans.registry import table

# ---- places ---------------------------------------------------------------------
PLACES = """
places AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, c_name || ' ' || o_orderpriority AS name, o_orderpriority AS cat,
    CASE WHEN o_orderkey % 3 = 0 THEN 'B' || CAST(o_custkey % 12 AS VARCHAR) END AS brand,
    r_name AS region, CAST(NULL AS VARCHAR) AS si, n_name AS gu,
    CASE WHEN o_orderkey % 14 <> 0 THEN c_mktsegment END AS dong,
    n_name || ' ' || c_mktsegment || ' ' || CAST(o_orderkey % 500 AS VARCHAR) AS addr,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'M' || CAST(o_custkey % 40 AS VARCHAR) END AS market,
    o_orderstatus AS market_type, 'Y' AS paper,
    CASE WHEN o_orderkey % 10 < 8 THEN 'Y' ELSE 'N' END AS card,
    CASE WHEN o_orderkey % 10 BETWEEN 5 AND 8 THEN 'Y' ELSE 'N' END AS qr,
    CASE WHEN o_orderkey % 97 <> 0 THEN 37e0 + (o_orderkey * 7919 % 10007) / 10007e0 END AS lat,
    CASE WHEN o_orderkey % 97 <> 0 THEN 126.5e0 + (o_orderkey * 104729 % 10009) / 10009e0 END AS lng
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def places(spark: SparkSession, d: str) -> DataFrame:
    """Orders as places.  Small sides are broadcast by Spark when their measured size allows it."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    homes = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    k = F.col("o_orderkey")
    text = lambda x: x.cast("string")
    located = k % 97 != 0
    return o.join(homes, o.o_custkey == homes.c_custkey).select(
        text(k).alias("id"),
        F.concat_ws(" ", "c_name", "o_orderpriority").alias("name"),
        F.col("o_orderpriority").alias("cat"),
        F.when(k % 3 == 0, F.concat(F.lit("B"), text(F.col("o_custkey") % 12))).alias("brand"),
        F.col("r_name").alias("region"),
        F.lit(None).cast("string").alias("si"),
        F.col("n_name").alias("gu"),
        F.when(k % 14 != 0, F.col("c_mktsegment")).alias("dong"),
        F.concat_ws(" ", "n_name", "c_mktsegment", text(k % 500)).alias("addr"),
        F.when(k % 5 != 0, F.concat(F.lit("M"), text(F.col("o_custkey") % 40))).alias("market"),
        F.col("o_orderstatus").alias("market_type"),
        F.lit("Y").alias("paper"),
        F.when(k % 10 < 8, "Y").otherwise("N").alias("card"),
        F.when((k % 10).between(5, 8), "Y").otherwise("N").alias("qr"),
        F.when(located, F.lit(37.0) + (k * 7919 % 10007) / F.lit(10007.0)).alias("lat"),
        F.when(located, F.lit(126.5) + (k * 104729 % 10009) / F.lit(10009.0)).alias("lng"),
    )


# ---- rows of the place source API ---------------------------------------------------
NAMES = [
    "CU 역삼점", "씨유 강남점", "GS25 서초점", "지에스 25 논현점", "세븐일레븐 신사점", "이마트24 방배점",
    "미니스톱", "24시 편의점", "세탁편의점", "새봄약국", "평촌학원가 김밥", "수학학원",
    "스마트폰나라", "한마음마트", "GS더프레시 잠실점", "노브랜드버거 강남점", "노브랜드 송파점", "다이소 종로점",
    "롯데 슈퍼 목동점", "홍콩반점 (본점)", "할머니국밥", "BCU상사", "에브리데이 수유점", "새마을치킨",
]
TRADES = ["음식점업", "농산물", "가정용품", "모르는업", None]
#: (region, district or city of the query, address before and after the number, district code)
ADDRESSES = [
    ("서울", "강남구", "서울특별시 강남구 테헤란로 ", " (역삼동)", "11680"),
    ("경기", "수원시", "경기도 수원시 팔달구 정조로 ", " (인계동, 상가)", "41110"),
    ("경기", "성남시", "경기 성남시 분당구 판교로 ", "", "41130"),
    ("인천", "중구", "인천 중구 신포로 ", " (신포동)(지하1층)", "28110"),
    ("부산", "기장군", "부산광역시 기장군 정관로 ", " (정관읍 매학리)", "26710"),
    ("경기", "가평군", "경기도 가평군 가화로 ", " (읍내리)", "41820"),
    ("서울", "강남구", "강남구 역삼로 ", " (역삼1동)", "11680"),
    ("경기", "부천시", "경기도 부천시 없는구 길주로 ", " (중동로)", "99999"),
]
DISTRICTS = [("11680", "강남구"), ("41110", "수원시"), ("41130", "성남시"), ("28110", "중구"), ("26710", "기장군"), ("41820", "가평군")]
PAGE_ROWS = 500


def _sql_list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _pick(values: list[str | None], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]).cast("array<string>"), (index + 1).cast("int"))


API = f"""
api AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS "frCd",
    ({_sql_list(NAMES)})[1 + o_orderkey % {len(NAMES)}] AS "frcsNm",
    ({_sql_list([a[2] for a in ADDRESSES])})[1 + (o_orderkey // 3) % 8] || CAST(o_orderkey % 500 AS VARCHAR)
      || ({_sql_list([a[3] for a in ADDRESSES])})[1 + (o_orderkey // 3) % 8] AS "frcsAddr",
    ({_sql_list([a[4] for a in ADDRESSES])})[1 + (o_orderkey // 3) % 8] AS "addrCd",
    ({_sql_list(TRADES)})[1 + o_orderkey % 5] AS "placeTypeNm",
    'M' || CAST(o_custkey % 40 AS VARCHAR) AS "mrktNm", o_orderstatus AS "mrktType",
    ({_sql_list([a[0] for a in ADDRESSES])})[1 + (o_orderkey // 3) % 8] AS query_sido,
    ({_sql_list([a[1] for a in ADDRESSES])})[1 + (o_orderkey // 3) % 8] AS query_addr,
    o_orderkey // {PAGE_ROWS} AS page_no
  FROM orders)
"""


def api_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rows of the place source API, with the query that found them."""
    k = F.col("o_orderkey")
    a = F.floor(k / 3) % 8
    return table(spark, d, "orders").select(
        k.alias("k"), k.cast("string").alias("frCd"), _pick(NAMES, k % len(NAMES)).alias("frcsNm"),
        F.concat(_pick([x[2] for x in ADDRESSES], a), (k % 500).cast("string"), _pick([x[3] for x in ADDRESSES], a)).alias("frcsAddr"),
        _pick([x[4] for x in ADDRESSES], a).alias("addrCd"),
        _pick(TRADES, k % 5).alias("placeTypeNm"),
        F.concat(F.lit("M"), (F.col("o_custkey") % 40).cast("string")).alias("mrktNm"),
        F.col("o_orderstatus").alias("mrktType"),
        *[F.lit("Y").alias(c) for c in ("paperYn", "cardYn", "qrYn")],
        F.lit(37.5).alias("latitude"), F.lit(127.0).alias("longitude"),
        _pick([x[0] for x in ADDRESSES], a).alias("query_sido"), _pick([x[1] for x in ADDRESSES], a).alias("query_addr"),
        F.floor(k / PAGE_ROWS).cast("bigint").alias("page_no"),
    )


def api_pages(spark: SparkSession, d: str) -> DataFrame:
    """The same rows as landed page texts of bounded size; every seventh page is an error page."""
    from waymark.schema import API_PLACE

    rows = api_rows(spark, d)
    declared = rows.groupBy("query_sido", "query_addr").agg(F.count(F.lit(1)).alias("totalCnt"))
    item = F.struct(*API_PLACE.fieldNames())
    pages = rows.groupBy("query_sido", "query_addr", "page_no").agg(F.collect_list(item).alias("list"))
    code = F.when(F.col("page_no") % 7 == 3, "9999").otherwise("0000")
    data = F.struct("totalCnt", F.lit(1).alias("totalPage"), "list")
    return pages.join(declared, ["query_sido", "query_addr"]).select(
        "query_sido", "query_addr", "page_no",
        F.to_json(F.struct(code.alias("resCode"), F.lit("").alias("resMsg"), data.alias("data"))).alias("value"),
    )


# ---- platforms ------------------------------------------------------------------------
PLATFORMS = """
platforms AS (
  SELECT 'p' || CAST(s_suppkey AS VARCHAR) AS id,
    CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey AS INTEGER) END AS post_no,
    CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 50 AS INTEGER) END AS ord,
    CASE WHEN s_suppkey % 3 = 0 THEN 'delivery' ELSE 'shopping' END AS kind,
    s_name AS name, CASE WHEN s_suppkey % 6 <> 0 THEN 'sum ' || CAST(s_nationkey AS VARCHAR) END AS summary,
    CASE WHEN s_suppkey % 7 = 0 THEN 'curated' ELSE '' END AS note,
    'https://p.example/' || CAST(s_suppkey AS VARCHAR) AS url, s_suppkey % 8 = 0 AS region_limited,
    'https://s.example' AS source_url, DATE '2024-01-01' + CAST(s_suppkey % 20 AS INTEGER) AS collected_on,
    CASE WHEN s_suppkey % 9 = 0 THEN 'removed' ELSE 'active' END AS status, s_nationkey
  FROM supplier)
"""


def platforms(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as the platform store."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.concat(F.lit("p"), k.cast("string")).alias("id"),
        F.when(k % 4 != 0, k.cast("int")).alias("post_no"),
        F.when(k % 5 != 0, (k % 50).cast("int")).alias("ord"),
        F.when(k % 3 == 0, "delivery").otherwise("shopping").alias("kind"),
        F.col("s_name").alias("name"),
        F.when(k % 6 != 0, F.concat(F.lit("sum "), F.col("s_nationkey").cast("string"))).alias("summary"),
        F.when(k % 7 == 0, "curated").otherwise("").alias("note"),
        F.concat(F.lit("https://p.example/"), k.cast("string")).alias("url"),
        (k % 8 == 0).alias("region_limited"),
        F.lit("https://s.example").alias("source_url"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 20).cast("int")).alias("collected_on"),
        F.when(k % 9 == 0, "removed").otherwise("active").alias("status"),
        "s_nationkey",
    )


FEED = """
feed AS (
  SELECT s_suppkey AS seq,
    CASE WHEN s_suppkey % 4 = 1 THEN CAST(s_suppkey AS INTEGER) WHEN s_suppkey % 4 = 2 THEN CAST(s_suppkey + 1000000 AS INTEGER) END AS post_no,
    CAST(s_suppkey % 30 AS INTEGER) AS ord, 'shopping' AS kind,
    CASE WHEN s_suppkey % 8 = 6 THEN 'Brand New ' || CAST(s_suppkey AS VARCHAR)
         WHEN s_suppkey % 8 = 2 THEN upper(replace(s_name, '#', ' #')) ELSE s_name END AS name,
    CAST(NULL AS VARCHAR) AS summary, 'https://f.example/' || CAST(s_suppkey AS VARCHAR) AS url
  FROM supplier WHERE s_suppkey % 5 <> 3)
"""


def feed(spark: SparkSession, d: str) -> DataFrame:
    """Most suppliers as a collected feed: some known by number, some by name only, some new."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").filter(k % 5 != 3).select(
        k.alias("seq"),
        F.when(k % 4 == 1, k.cast("int")).when(k % 4 == 2, (k + 1000000).cast("int")).alias("post_no"),
        (k % 30).cast("int").alias("ord"), F.lit("shopping").alias("kind"),
        F.when(k % 8 == 6, F.concat(F.lit("Brand New "), k.cast("string")))
        .when(k % 8 == 2, F.upper(F.replace(F.col("s_name"), F.lit("#"), F.lit(" #")))).otherwise(F.col("s_name")).alias("name"),
        F.lit(None).cast("string").alias("summary"),
        F.concat(F.lit("https://f.example/"), k.cast("string")).alias("url"),
    )


# ---- packing ----------------------------------------------------------------------------
_NOTHING_PACKED = "{'done': []::VARCHAR[], 'open': NULL::VARCHAR, 'u': NULL::VARCHAR}"


def pack_sql(parts: str, grown: str, fits: str, closed: str = "[]::VARCHAR[]", rest: str = "x.u") -> str:
    """list_reduce that packs ``parts``; ``a`` is the state, ``x.u`` the next part."""
    flushed = "CASE WHEN a.open IS NULL OR a.open = '' THEN a.done ELSE list_append(a.done, a.open) END"
    reduced = f"""list_reduce(list_transform({parts}, lambda u: {{'done': []::VARCHAR[], 'open': NULL::VARCHAR, 'u': u}}), lambda a, x:
      CASE WHEN {fits} THEN {{'done': a.done, 'open': {grown}, 'u': NULL::VARCHAR}}
      ELSE {{'done': list_concat({flushed}, {closed}), 'open': {rest}, 'u': NULL::VARCHAR}} END, {_NOTHING_PACKED})"""
    return f"list_filter(list_transform([{reduced}], lambda r: list_append(r.done, r.open))[1], lambda p: p IS NOT NULL AND p <> '')"
