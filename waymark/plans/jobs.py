"""Queries over whole jobs: the guarded reconcile of platforms and the nightly place table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.jobs import nightly, survey
from waymark.plans.bindings import API, feed, api_rows, platforms
from waymark.plans.ingest import _DONG, _GU, _PLACE_CAT
from waymark.plans.platforms import _MATCH, DAY
from waymark.operators.survey import run_summary
from waymark.plans.registry import query, table
from waymark.plans.survey import _SEEN, _TERMS
from waymark.schema import API_PLACE, PLATFORM_COLUMNS
from waymark.session import work_folder
from waymark.sources.tables import current

_SOURCE = "https://new.example"
_PAGE_ROWS = 4


# ---- platforms ----------------------------------------------------------------------
def feed_pages(spark, d) -> DataFrame:
    """The feed as landed pages of a few rows that name how many pages there are."""
    rows = feed(spark, d)
    item = F.struct(
        F.col("post_no").alias("postNo"), F.col("ord").alias("ordNo"), F.lit("쇼핑").alias("ecommerceCategoryNm"), F.col("name").alias("ecommerceMgtNm"),
        F.lit(None).cast("string").alias("ecommerceIntroCn1"), F.col("url").alias("ecommerceUrl"),
    )
    of = (F.floor((F.col("seq") - 1) / _PAGE_ROWS) + 1).cast("int")
    pages = rows.groupBy(of.alias("page_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("i")))), lambda x: x["i"]).alias("list"))
    sizes = rows.agg(F.max(of).alias("totalPage"), (F.count(F.lit(1)) + 10).alias("totalCnt"))
    data = F.struct("totalCnt", "totalPage", "list").alias("data")
    # One row of totals: a join of fixed size.
    return pages.join(F.broadcast(sizes)).select("page_no", F.to_json(F.struct(F.lit("0000").alias("resCode"), data)).alias("value"))


def _platform_root(spark, d) -> tuple[str, DataFrame, dict[int, nightly.Outcome]]:
    """Runs over one store: a whole one, one without page 2, one with a bad page 1."""
    root = work_folder(spark, "platforms")
    platforms(spark, d).select(*PLATFORM_COLUMNS).write.parquet(f"{root}/v-0")
    nightly.point_to(spark, root, "v-0", None)
    pages = feed_pages(spark, d)
    bad = pages.withColumn("value", F.when(F.col("page_no") == 1, F.replace("value", F.lit('"0000"'), F.lit('"E500"'))).otherwise(F.col("value")))
    runs = {}
    for run, landed in enumerate((pages, pages.filter("page_no <> 2"), bad), 1):
        runs[run] = nightly.reconcile_guarded(spark, root, landed, DAY, _SOURCE)
        runs[run].counts["rows"] = current(spark, root).count()
    return root, pages, runs


_COUNTS = ("before", "inserted", "updated", "removed", "after")


@query("S17 J5 A15 S5", f"""WITH {_MATCH}, c AS (SELECT (SELECT count(*) FROM platforms) AS before, count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated,
(SELECT count(*) FROM platforms WHERE status <> 'removed' AND id NOT IN (SELECT target FROM matched)) AS removed,
(SELECT count(*) FROM platforms) + count(DISTINCT target) FILTER (target NOT IN (SELECT id FROM platforms)) AS after FROM matched)
SELECT 1 AS run, true AS applied, '' AS reasons, after AS rows, before, inserted, updated, removed, after FROM c
UNION ALL SELECT 2, false, 'page 2: missing', after, NULL, NULL, NULL, NULL, NULL FROM c
UNION ALL SELECT 3, false, 'page 1: resCode=E500', after, NULL, NULL, NULL, NULL, NULL FROM c""")
def reconcile_guarded(spark, d) -> DataFrame:
    """What a good run, one with a missing page and one with a bad page did to one store."""
    _, _, runs = _platform_root(spark, d)
    rows = [(run, o.applied, "; ".join(o.reasons), o.counts["rows"], *[o.counts.get(c) for c in _COUNTS]) for run, o in runs.items()]
    return spark.createDataFrame(rows, "run int, applied boolean, reasons string, rows bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS))


@query("S17 J4 J5", f"""WITH {_MATCH} SELECT coalesce(p.id, w.target) AS id, CASE WHEN w.target IS NOT NULL THEN w.post_no ELSE p.post_no END AS post_no,
CASE WHEN w.target IS NOT NULL THEN w.name ELSE p.name END AS name, CASE WHEN p.id IS NULL THEN '' ELSE p.note END AS note,
CASE WHEN p.id IS NULL THEN '{_SOURCE}' ELSE p.source_url END AS source_url, CAST(CASE WHEN w.target IS NOT NULL THEN DATE '{DAY}' ELSE p.collected_on END AS VARCHAR) AS collected_on,
CASE WHEN w.target IS NOT NULL THEN 'active' ELSE 'removed' END AS status FROM platforms p FULL JOIN win w ON p.id = w.target""")
def guarded_store(spark, d) -> DataFrame:
    """The store after the three runs: as the good one left it."""
    root, _, _ = _platform_root(spark, d)
    return current(spark, root).select("id", "post_no", "name", "note", "source_url", F.col("collected_on").cast("string").alias("collected_on"), "status")


# ---- places --------------------------------------------------------------------------------
def place_run(spark, d) -> DataFrame:
    """API rows as the pages 1..n of every district, some rows landed twice."""
    rows = api_rows(spark, d)
    twice = rows.unionByName(rows.filter("k % 50 = 0").withColumn("frcsNm", F.concat("frcsNm", F.lit(" again")))).withColumn("page_no", F.col("page_no") + 1)
    where = ["query_sido", "query_addr"]
    item = F.struct(*API_PLACE.fieldNames())
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", F.length("frcsNm").alias("n"), item.alias("i")))), lambda x: x["i"])
    pages = twice.groupBy(*where, "page_no").agg(listed.alias("list"))
    sizes = twice.groupBy(*where).agg(F.count(F.lit(1)).alias("totalCnt"), F.max("page_no").alias("totalPage"))
    data = F.struct("totalCnt", "totalPage", "list").alias("data")
    return pages.join(sizes, where).select(*where, "page_no", F.to_json(F.struct(F.lit("0000").alias("resCode"), F.lit("").alias("resMsg"), data)).alias("value"))


#: What the detection makes of the names in the test pages; the others end up without a brand.
_BRANDS = {
    "24시 편의점": "24시", "CU 역삼점": "CU", "GS25 서초점": "GS25", "GS더프레시 잠실점": "GS더프레시", "노브랜드 송파점": "노브랜드", "노브랜드버거 강남점": "노브랜드버거",
    "다이소 종로점": "다이소", "롯데 슈퍼 목동점": "롯데 슈퍼", "세븐일레븐 신사점": "세븐일레븐", "세탁편의점": "세탁편의점", "씨유 강남점": "CU", "에브리데이 수유점": "에브리데이",
    "이마트24 방배점": "이마트24", "지에스 25 논현점": "GS25", "홍콩반점 (본점)": "홍콩반점",
}
_BRAND_SQL = "CASE \"frcsNm\" " + " ".join(f"WHEN '{n}' THEN '{b}'" for n, b in _BRANDS.items()) + " END"


@query("S4 S14 S15 W1 J1 X6 X10 A14", f"""WITH {API} SELECT "frCd" AS id, "frcsNm" AS name, {_PLACE_CAT} AS cat, query_sido AS region,
 CASE WHEN query_sido = '경기' THEN query_addr END AS si,
 CASE WHEN query_sido <> '경기' THEN query_addr WHEN {_GU} IN ('{"','".join(fixed.SUB_DISTRICTS)}') THEN {_GU} END AS gu,
 nullif({_DONG}, '') AS dong, "mrktNm" AS market, {_BRAND_SQL} AS brand FROM api""")
def nightly_places(spark, d) -> DataFrame:
    """Two nights: one whole run is published, one with a missing page leaves the table."""
    root = work_folder(spark, "nightly")
    pages = place_run(spark, d)
    nightly.nightly_places(spark, root, "2024-01-01", pages, "2024-01-01", min_total=1)
    nightly.nightly_places(spark, root, "2024-01-02", pages.filter("page_no <> 2"), "2024-01-02", min_total=1)
    return current(spark, f"{root}/places").select("id", "name", "cat", "region", "si", "gu", "dong", "market", "brand")


# ---- the page survey --------------------------------------------------------------------------
# Every page is an entry's page; every tenth one landed without a body.  The catalog knows one term of two.
_SURVEY_DAY, _CYCLE = "2026-08-24", 3
_REPORT = f"""{_SEEN}, due AS (SELECT page_id FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS no FROM pages)
 WHERE (no - 1) % {_CYCLE} = datediff('day', DATE '1970-01-01', DATE '{_SURVEY_DAY}') % {_CYCLE}),
report AS (SELECT page_id AS id, page_id % 10 <> 0 AS ok, CASE WHEN page_id % 10 <> 0 THEN array_to_string(list_sort(list_filter(confirmed, lambda t: NOT list_contains(
 CASE WHEN page_id % 2 = 0 THEN ['the', 'que'] ELSE ['Of'] END, t))), ',') END AS new_brands, CASE WHEN page_id % 10 <> 0 THEN len(confirmed) END AS seen_brands,
 CASE WHEN page_id % 10 <> 0 THEN length(body) < 1500 END AS thin, regexp_matches(url, '^[a-z]+://[^/?#]+(/+[^/?#]+/+[^/?#]+|[^#]*\\?[^#])') AS deep_link FROM seen JOIN due USING (page_id))"""


def _survey(spark, d) -> DataFrame:
    pages = table(spark, d, "pages")
    even = F.col("page_id") % 2 == 0
    known = F.when(even, F.array(F.lit("the"), F.lit("que"))).otherwise(F.array(F.lit("Of")))
    catalog = pages.select(F.col("page_id").alias("id"), F.col("url").alias("survey_url"), known.alias("known_brands"), F.array().cast("array<string>").alias("known_cats"))
    landed = pages.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 10 != 0, F.col("html")).alias("html"))
    return survey.nightly_survey(catalog, landed, work_folder(spark, "survey"), _SURVEY_DAY, terms=_TERMS, cycle=_CYCLE, max_hits=None)


@query("W6 S9 X22 X24 X25 X26 J12 U3 U4 S20", f"WITH {_REPORT} SELECT id, ok, new_brands, seen_brands, thin, deep_link FROM report")
def nightly_survey(spark, d) -> DataFrame:
    """The day's due pages as one job: text, terms, additions, report."""
    report = _survey(spark, d)
    return report.select("id", "ok", F.array_join(F.array_sort("new_brands"), ",").alias("new_brands"), F.col("seen_brands").cast("bigint").alias("seen_brands"), "thin", "deep_link")


@query("A26", f"""WITH {_REPORT} SELECT count(*) AS checked, count(*) FILTER (ok AND new_brands <> '') AS changed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok AND thin) AS thin FROM report""")
def nightly_survey_summary(spark, d) -> DataFrame:
    return run_summary(_survey(spark, d))
