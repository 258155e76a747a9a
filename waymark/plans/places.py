"""Queries over the place table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.values import distance_label, metres
from waymark.operators import facets as fac
from waymark.operators import grid, hierarchy, ordering, reports, search
from waymark.operators.filters import PlaceFilter
from waymark.plans.bindings import PLACES, places
from waymark.plans.registry import query
from waymark.schema import PIN_COLUMNS, PLACE_COLUMNS

COLS = ", ".join(PLACE_COLUMNS)
PINS = ", ".join(PIN_COLUMNS)
HERE = (37.55, 127.01)

# One wide filter whose three facet filters are all on, and its SQL parts.
WIDE = PlaceFilter(region="ASIA", q="nation_1", cat="1-URGENT,2-HIGH, 5-LOW", brand="B1,B2,B3,B4", mtype="O,F", digital=True)
COMMON = "region = 'ASIA' AND (lower(name) LIKE '%nation_1%' OR lower(coalesce(addr,'')) LIKE '%nation_1%' OR lower(coalesce(market,'')) LIKE '%nation_1%') AND (card = 'Y' OR qr = 'Y')"
CAT = "cat IN ('1-URGENT','2-HIGH','5-LOW')"
BRAND = "brand IN ('B1','B2','B3','B4')"
MTYPE = "market_type IN ('O','F')"


def _facet_sql(where: str, column: str) -> str:
    return f"WITH {PLACES} SELECT {column} AS key, count(*) AS count FROM places WHERE {where} AND {column} IS NOT NULL GROUP BY 1"


@query("A4 A1 A2 A3 P1 P2 T3", f"""WITH {PLACES}
SELECT 'cat' AS facet, cat AS key, count(*) AS count FROM places WHERE {COMMON} AND {BRAND} AND {MTYPE} GROUP BY 2
UNION ALL SELECT 'brand', brand, count(*) FROM places WHERE {COMMON} AND {CAT} AND {MTYPE} AND brand IS NOT NULL GROUP BY 2
UNION ALL SELECT 'mtype', market_type, count(*) FROM places WHERE {COMMON} AND {CAT} AND {BRAND} GROUP BY 2""")
def facets_all(spark, d) -> DataFrame:
    return fac.facets(places(spark, d), WIDE)


@query("A4 P2", f"""WITH {PLACES}
SELECT 'cat' AS facet, cat AS key, count(*) AS count FROM places GROUP BY 2
UNION ALL SELECT 'brand', brand, count(*) FROM places WHERE brand IS NOT NULL GROUP BY 2
UNION ALL SELECT 'mtype', market_type, count(*) FROM places GROUP BY 2""")
def facets_unfiltered(spark, d) -> DataFrame:
    return fac.facets(places(spark, d), PlaceFilter(region="전체", cat=" , ,"))


@query("A1 T3", _facet_sql(f"{COMMON} AND {BRAND} AND {MTYPE}", "cat"))
def facet_cat(spark, d) -> DataFrame:
    return fac.facet(places(spark, d), WIDE, "cat")


@query("A2", _facet_sql(f"{COMMON} AND {CAT} AND {MTYPE}", "brand"))
def facet_brand(spark, d) -> DataFrame:
    return fac.facet(places(spark, d), WIDE, "brand")


@query("A3", _facet_sql(f"{COMMON} AND {CAT} AND {BRAND}", "market_type"))
def facet_mtype(spark, d) -> DataFrame:
    return fac.facet(places(spark, d), WIDE, "mtype")


@query("T7", f"""WITH {PLACES}, c AS (SELECT brand AS key, count(*) AS count FROM places WHERE brand IS NOT NULL GROUP BY 1)
SELECT key, count, row_number() OVER (ORDER BY count DESC, key) <= 10 AS head FROM c""")
def brand_topn(spark, d) -> DataFrame:
    return fac.brands_with_head(places(spark, d), PlaceFilter())


@query("T1 P3 P10", f"WITH {PLACES} SELECT {COLS} FROM places WHERE region = 'ASIA' AND cat = '2-HIGH' ORDER BY name, id LIMIT 50 OFFSET 50")
def search_page(spark, d) -> DataFrame:
    return search.page_of(places(spark, d), PlaceFilter(region="ASIA", cat="2-HIGH"), page=1, size=50, sort="name")


@query("T1 P16 A5", f"""WITH {PLACES}, t AS (SELECT * FROM places WHERE brand = 'B3')
SELECT {COLS}, (SELECT count(*) FROM t) AS total FROM t ORDER BY id LIMIT 200""")
def search_page_with_total(spark, d) -> DataFrame:
    flt = PlaceFilter(brand="B3")
    rows = places(spark, d)
    return search.with_total(search.page_of(rows, flt, page=-4, size=900), rows, flt)


@query("P8", f"""WITH {PLACES} SELECT {COLS} FROM places WHERE lower(name) LIKE '%00_2%high%' OR lower(addr) LIKE '%00_2%high%'
OR lower(coalesce(market, '')) LIKE '%00_2%high%' ORDER BY id LIMIT 100""")
def search_keyword(spark, d) -> DataFrame:
    return search.page_of(places(spark, d), PlaceFilter(q=" 00_2%HIGH "), size=100)


@query("P5 P7 A5", f"""WITH {PLACES} SELECT count(*) AS total FROM places WHERE cat IN ('1-URGENT','2-HIGH')
AND brand IN ('B1','B7') AND market_type IN ('O','P') AND (card = 'Y' OR qr = 'Y')""")
def search_multi(spark, d) -> DataFrame:
    return search.total(places(spark, d), PlaceFilter(cat=" 1-URGENT , ,2-HIGH", brand="B1,전체,B7", mtype="O,P", digital=True))


@query("P4", f"WITH {PLACES} SELECT {COLS} FROM places WHERE gu = 'NATION_3' AND dong IS NULL ORDER BY id LIMIT 200")
def search_unknown_dong(spark, d) -> DataFrame:
    return search.page_of(places(spark, d), PlaceFilter(gu="NATION_3", dong="동 미상"), size=200)


@query("P6 P4", f"""WITH {PLACES} SELECT {COLS} FROM places WHERE lat BETWEEN 37.2e0 AND 37.4e0 AND lng BETWEEN 126.7e0 AND 127.0e0
AND dong = 'MACHINERY' ORDER BY id LIMIT 200""")
def search_bounds(spark, d) -> DataFrame:
    flt = PlaceFilter(dong="MACHINERY", min_lat=37.2, max_lat=37.4, min_lng=126.7, max_lng=127.0)
    return search.page_of(places(spark, d), flt, size=200)


@query("T2 X34", f"""WITH {PLACES} SELECT {COLS} FROM places WHERE region = 'EUROPE' ORDER BY
(lat - {HERE[0]}e0) * (lat - {HERE[0]}e0) + (lng - {HERE[1]}e0) * (lng - {HERE[1]}e0) * pow(cos(radians({HERE[0]}e0)), 2) ASC NULLS LAST, id
LIMIT 20 OFFSET 20""")
def nearest_topk(spark, d) -> DataFrame:
    return search.page_of(places(spark, d), PlaceFilter(region="EUROPE"), 1, 20, "dist", *HERE)


_METRES = f"""2 * 6371000e0 * asin(sqrt(pow(sin((radians(lat) - radians({HERE[0]}e0)) / 2), 2)
 + cos(radians(lat)) * cos(radians({HERE[0]}e0)) * pow(sin((radians(lng) - radians({HERE[1]}e0)) / 2), 2)))"""


@query("X35", f"""WITH {PLACES}, m AS (SELECT id, {_METRES} AS m FROM places WHERE lat IS NOT NULL)
SELECT id, CASE WHEN m < 1000 THEN CAST(CAST(round(m) AS BIGINT) AS VARCHAR) || 'm' ELSE printf('%.1f', m / 1000) || 'km' END AS label FROM m""")
def distance_labels(spark, d) -> DataFrame:
    rows = places(spark, d).filter("lat IS NOT NULL")
    return rows.select("id", distance_label(metres(F.col("lat"), F.col("lng"), *HERE)).alias("label"))


@query("T12", f"""WITH {PLACES} SELECT id, '- ' || name || ' | ' || cat || ' | ' || addr || ' | 카드형 ' || CASE WHEN card = 'Y' THEN '가능' ELSE '불가' END
|| '·QR ' || CASE WHEN qr = 'Y' THEN '가능' ELSE '불가' END AS line FROM places WHERE region = 'AFRICA' AND brand = 'B2' ORDER BY name, id LIMIT 5""")
def answer_lines(spark, d) -> DataFrame:
    return search.answer_lines(places(spark, d), PlaceFilter(region="AFRICA", brand="B2"))


_CELLS = """SELECT CAST(floor(lat / 0.1e0) AS BIGINT) AS cell_y, CAST(floor(lng / 0.1e0) AS BIGINT) AS cell_x,
round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, count(*) AS count FROM places WHERE lat IS NOT NULL AND lng IS NOT NULL"""


def _cells(spark, d, flt, g=0.1) -> DataFrame:
    cells = grid.clusters(places(spark, d), flt, g)
    return cells.withColumn("lat", F.round("lat", 6)).withColumn("lng", F.round("lng", 6))


@query("A6 P9", f"WITH {PLACES} {_CELLS} AND (card = 'Y' OR qr = 'Y') GROUP BY 1, 2")
def grid_clusters(spark, d) -> DataFrame:
    return _cells(spark, d, PlaceFilter(digital=True))


@query("A7 P9", f"WITH {PLACES}, c AS ({_CELLS} AND region = 'ASIA' GROUP BY 1, 2) SELECT CAST(sum(count) AS BIGINT) AS total, count(*) AS cells FROM c")
def cluster_total(spark, d) -> DataFrame:
    return grid.cluster_total(grid.clusters(places(spark, d), PlaceFilter(region="ASIA")))


@query("A28", f"""WITH {PLACES}, c AS ({_CELLS} AND gu = 'NATION_4' GROUP BY 1, 2) SELECT cell_y, cell_x, count,
CASE WHEN count < 2 THEN 'pin' WHEN count < 10 THEN '0' WHEN count < 100 THEN '1' WHEN count < 200 THEN '2' WHEN count < 500 THEN '3'
WHEN count < 1000 THEN '4' ELSE '5' END AS size_class FROM c""")
def cluster_size_class(spark, d) -> DataFrame:
    cells = grid.clusters(places(spark, d), PlaceFilter(gu="NATION_4"), 0.1)
    return cells.select("cell_y", "cell_x", "count", grid.size_class(F.col("count")).alias("size_class"))


_SPOTS = "spots AS (SELECT id, name, round(lat, 2) AS lat, round(lng, 2) AS lng FROM places WHERE lat IS NOT NULL)"


def _spots(spark, d) -> DataFrame:
    """Places moved to a coarse coordinate, so that some share one."""
    return places(spark, d).withColumn("lat", F.round("lat", 2)).withColumn("lng", F.round("lng", 2))


@query("A27", f"WITH {PLACES}, {_SPOTS} SELECT lat, lng, count(*) AS count, min(id) AS first_id FROM spots GROUP BY 1, 2 HAVING count(*) >= 2")
def colocated(spark, d) -> DataFrame:
    return grid.shared_coordinates(_spots(spark, d), PlaceFilter())


@query("A27", f"""WITH {PLACES}, {_SPOTS}, c AS (SELECT *, count(*) OVER (PARTITION BY lat, lng) AS count FROM spots)
SELECT lat, lng, count, id, name FROM c WHERE count >= 2""")
def colocated_members(spark, d) -> DataFrame:
    return grid.shared_members(_spots(spark, d), PlaceFilter())


@query("T10 P11", f"""WITH {PLACES}, m AS (SELECT * FROM places WHERE gu = 'NATION_5')
SELECT {PINS} FROM m WHERE lat IS NOT NULL AND lng IS NOT NULL AND (SELECT count(*) FROM m) <= 3000""")
def map_pins_capped(spark, d) -> DataFrame:
    return search.pins(places(spark, d), PlaceFilter(gu="NATION_5"))


@query("T10 P11 A5", f"""WITH {PLACES}, m AS (SELECT *, gu = 'NATION_5' AS near FROM places WHERE gu = 'NATION_5' OR region = 'ASIA'),
a AS (SELECT 'near' AS map, count(*) FILTER (near) AS total, string_agg(id || ':' || name || ':' || card, ',' ORDER BY id) FILTER (near AND lat IS NOT NULL) AS pins FROM m
UNION ALL SELECT 'wide', count(*) FILTER (region = 'ASIA'), NULL FROM m)
SELECT map, total, total > 1000 AS truncated, CASE WHEN total > 1000 THEN '' ELSE coalesce(pins, '') END AS pins FROM a WHERE map = 'near' OR total > 1000""")
def map_answer(spark, d) -> DataFrame:
    """A near map with its pins and, where the wide one is over the bound, that one without."""
    rows = places(spark, d)
    told = F.array_join(F.transform("pins", lambda p: F.concat_ws(":", p["id"], p["name"], p["card"])), ",").alias("pins")
    one = lambda name, flt: search.map_answer(rows, flt, max_pins=1000).select(F.lit(name).alias("map"), "total", "truncated", told)
    return one("near", PlaceFilter(gu="NATION_5")).unionByName(one("wide", PlaceFilter(region="ASIA")).filter("truncated"))


@query("T10 T13 A5", f"""WITH {PLACES}, t AS (SELECT count(*) AS total FROM places WHERE region = 'ASIA')
SELECT total, total > 1000 AS truncated, CASE WHEN total > 1000 THEN 'clusters' ELSE 'pins' END AS mode FROM t""")
def map_mode(spark, d) -> DataFrame:
    return search.map_mode(places(spark, d), PlaceFilter(region="ASIA"), max_pins=1000)


@query("A8 A9", f"WITH {PLACES} SELECT region, si, gu, coalesce(dong, '동 미상') AS dong, count(*) AS count FROM places GROUP BY 1, 2, 3, 4")
def region_tree(spark, d) -> DataFrame:
    return hierarchy.region_tree(places(spark, d))


@query("A8 A9", f"""WITH {PLACES} SELECT DISTINCT 2 AS rank, 'gu' AS level, gu AS value, false AS unknown FROM places WHERE region = 'ASIA'
UNION ALL SELECT DISTINCT 3, 'dong', coalesce(dong, '동 미상'), dong IS NULL FROM places WHERE region = 'ASIA' AND gu = 'NATION_12'""")
def region_options(spark, d) -> DataFrame:
    return hierarchy.region_options(places(spark, d), "ASIA", gu="NATION_12")


@query("A8 A9", f"""WITH {PLACES} SELECT DISTINCT 1 AS rank, 'si' AS level, region AS value, false AS unknown FROM places
UNION ALL SELECT DISTINCT 2, 'gu', gu, false FROM places WHERE region = 'EUROPE'
UNION ALL SELECT DISTINCT 3, 'dong', coalesce(dong, '동 미상'), dong IS NULL FROM places WHERE region = 'EUROPE'""")
def region_options_four_levels(spark, d) -> DataFrame:
    """The four-level form: every place lies in one region, its own region plays the city."""
    rows = places(spark, d).withColumn("si", F.col("region")).withColumn("region", F.lit("경기"))
    return hierarchy.region_options(rows, "경기", si="EUROPE")


@query("X36", f"""WITH {PLACES}, c AS (SELECT
count(*) FILTER (region = 'ASIA' AND gu = 'NATION_12' AND dong = 'NOWHERE' AND brand = 'B5') AS s0,
count(*) FILTER (region = 'ASIA' AND gu = 'NATION_12' AND brand = 'B5') AS s1,
count(*) FILTER (region = 'ASIA' AND brand = 'B5') AS s2, count(*) FILTER (brand = 'B5') AS s3,
count(*) FILTER (region = 'ASIA' AND gu = 'NATION_12' AND dong = 'NOWHERE') AS s4, count(*) AS s5 FROM places)
SELECT 0 AS step, 'as asked' AS relaxed, s0 AS count, s0 > 0 AS chosen FROM c
UNION ALL SELECT 1, 'without dong', s1, s0 = 0 AND s1 > 0 FROM c
UNION ALL SELECT 2, 'without gu', s2, s0 + s1 = 0 AND s2 > 0 FROM c
UNION ALL SELECT 3, 'without region', s3, s0 + s1 + s2 = 0 AND s3 > 0 FROM c
UNION ALL SELECT 4, 'without categories', s4, s0 + s1 + s2 + s3 = 0 AND s4 > 0 FROM c
UNION ALL SELECT 5, 'without both', s5, s0 + s1 + s2 + s3 + s4 = 0 AND s5 > 0 FROM c""")
def relaxation_ladder(spark, d) -> DataFrame:
    return fac.relaxation(places(spark, d), PlaceFilter(region="ASIA", gu="NATION_12", dong="NOWHERE", brand="B5"))


CATS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("A16", f"""WITH {PLACES} SELECT coalesce(region, 'total') AS region, {", ".join(f"count(*) FILTER (cat = '{c}') AS \"{c}\"" for c in CATS)}
FROM places GROUP BY ROLLUP (region)""")
def region_cat_matrix(spark, d) -> DataFrame:
    return reports.matrix(places(spark, d), "region", "cat", CATS)


@query("A20 A10", f"WITH {PLACES} SELECT region, cat, count(*) AS count FROM places GROUP BY 1, 2")
def region_cat_counts(spark, d) -> DataFrame:
    return reports.group_counts(places(spark, d), "region", "cat")


@query("A10", f"WITH {PLACES} SELECT region, count(*) AS count FROM places GROUP BY 1")
def region_counts(spark, d) -> DataFrame:
    return reports.group_counts(places(spark, d), "region")


@query("A19", f"""WITH {PLACES} SELECT region, count(*) AS rows, count(*) FILTER (dong IS NULL) AS missing,
round(count(*) FILTER (dong IS NULL) / count(*), 6) AS rate FROM places GROUP BY 1""")
def missing_rate(spark, d) -> DataFrame:
    return reports.missing_rate(places(spark, d), "dong", "region").withColumn("rate", F.round("rate", 6))


@query("T8 W4", f"""WITH {PLACES} SELECT id, row_number() OVER (ORDER BY region, coalesce(si, ''), coalesce(gu, ''), coalesce(dong, ''), name, id) AS no FROM places""")
def numbered_places(spark, d) -> DataFrame:
    """The table's published order, as row numbers."""
    level = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = places(spark, d).select("id", "region", "si", "gu", "dong", "name")
    return ordering.number_all(rows, ["region", level("si"), level("gu"), level("dong"), "name", "id"], "no").select("id", "no")


@query("T11", f"WITH {PLACES} SELECT {COLS} FROM places WHERE dong IS NULL ORDER BY md5(id || '#20260806'), id LIMIT 20")
def seeded_sample(spark, d) -> DataFrame:
    return ordering.seeded_sample(places(spark, d).filter("dong IS NULL"), "id", 20260806).select(*PLACE_COLUMNS)
