"""Queries over the platform store, its feed, and the goods catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.values import joined_or_null, platform_kind
from waymark.operators import catalog as cat
from waymark.operators import corpus, ordering, publishing, reports
from waymark.plans.bindings import FEED, PLATFORMS, feed, pack_sql, platforms
from waymark.plans.registry import query, table
from waymark.schema import PLATFORM_COLUMNS
from waymark.sources import landed, tables

DAY = "2024-02-01"
COLS = ", ".join(PLATFORM_COLUMNS)
_KEY = "lower(regexp_replace(name, '\\s+', '', 'g'))"
_MATCH = f"""{PLATFORMS}, {FEED},
by_post AS (SELECT post_no AS post_key, max(id) AS id_post FROM platforms WHERE post_no IS NOT NULL GROUP BY 1),
by_name AS (SELECT {_KEY} AS name_key, max(id) AS id_name FROM platforms GROUP BY 1),
matched AS (SELECT feed.*, coalesce(id_post, id_name, 'ec-' || coalesce(CAST(post_no AS VARCHAR), 'None')) AS target,
  CASE WHEN coalesce(id_post, id_name) IS NULL THEN 'inserted' ELSE 'updated' END AS action
  FROM feed LEFT JOIN by_post ON post_no = post_key LEFT JOIN by_name ON {_KEY} = name_key),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY seq DESC) AS rn FROM matched) WHERE rn = 1)
"""


@query("S17 J4 J5 A15", f"""WITH {_MATCH} SELECT coalesce(p.id, w.target) AS id,
CASE WHEN w.target IS NOT NULL THEN w.post_no ELSE p.post_no END AS post_no, CASE WHEN w.target IS NOT NULL THEN w.ord ELSE p.ord END AS ord,
CASE WHEN w.target IS NOT NULL THEN w.kind ELSE p.kind END AS kind, CASE WHEN w.target IS NOT NULL THEN w.name ELSE p.name END AS name,
CASE WHEN w.target IS NOT NULL THEN w.summary ELSE p.summary END AS summary, CASE WHEN p.id IS NULL THEN '' ELSE p.note END AS note,
CASE WHEN w.target IS NOT NULL THEN w.url ELSE p.url END AS url, CASE WHEN p.id IS NULL THEN false ELSE p.region_limited END AS region_limited,
CASE WHEN p.id IS NULL THEN 'https://new.example' ELSE p.source_url END AS source_url,
CAST(CASE WHEN w.target IS NOT NULL THEN DATE '{DAY}' ELSE p.collected_on END AS VARCHAR) AS collected_on,
CASE WHEN w.target IS NOT NULL THEN 'active' ELSE 'removed' END AS status,
CASE WHEN w.target IS NOT NULL AND p.id IS NOT NULL THEN 'updated' WHEN w.target IS NOT NULL THEN 'inserted' WHEN p.status <> 'removed' THEN 'removed' ELSE 'kept' END AS action
FROM platforms p FULL JOIN win w ON p.id = w.target""")
def reconcile_upsert(spark, d) -> DataFrame:
    day = F.lit(DAY).cast("date")
    after = publishing.reconcile(platforms(spark, d), feed(spark, d), day, "https://new.example")
    return after.withColumn("collected_on", F.col("collected_on").cast("string"))


@query("J4", f"WITH {_MATCH} SELECT seq, target, action FROM matched")
def feed_match(spark, d) -> DataFrame:
    return publishing.match_feed(platforms(spark, d), feed(spark, d)).select("seq", "target", "action")


@query("A15", f"""WITH {_MATCH} SELECT (SELECT count(*) FROM platforms) AS before, count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated,
(SELECT count(*) FROM platforms WHERE status <> 'removed' AND id NOT IN (SELECT target FROM matched)) AS removed,
(SELECT count(*) FROM platforms) + count(DISTINCT target) FILTER (target NOT IN (SELECT id FROM platforms)) AS after FROM matched""")
def reconcile_counts(spark, d) -> DataFrame:
    return publishing.reconcile_counts(platforms(spark, d), feed(spark, d))


@query("J5", f"WITH {_MATCH} SELECT id, CAST(collected_on AS VARCHAR) AS collected_on, 'removed' AS status FROM platforms WHERE status <> 'removed' AND id NOT IN (SELECT target FROM matched)")
def soft_delete(spark, d) -> DataFrame:
    store = platforms(spark, d)
    gone = publishing.removed_rows(store, publishing.match_feed(store, feed(spark, d)))
    return gone.select("id", F.col("collected_on").cast("string").alias("collected_on"), "status")


@query("S16", f"""WITH {PLATFORMS}, new AS (SELECT id, name || '!' AS name, CAST(NULL AS VARCHAR) AS summary FROM platforms WHERE post_no % 3 = 0
UNION ALL SELECT 'n' || id, name, 'added' FROM platforms WHERE post_no % 3 = 1)
SELECT coalesce(p.id, n.id) AS id, p.post_no, CASE WHEN n.id IS NULL THEN p.name ELSE n.name END AS name, CASE WHEN n.id IS NULL THEN p.summary ELSE n.summary END AS summary
FROM platforms p FULL JOIN new n ON p.id = n.id""")
def keyed_upsert(spark, d) -> DataFrame:
    store = platforms(spark, d).select("id", "post_no", "name", "summary")
    changed = store.filter("post_no % 3 = 0").select("id", F.concat("name", F.lit("!")).alias("name"), F.lit(None).cast("string").alias("summary"))
    added = store.filter("post_no % 3 = 1").select(F.concat(F.lit("n"), "id").alias("id"), "name", F.lit("added").alias("summary"))
    return publishing.keyed_upsert(store, changed.unionByName(added), "id", ["name", "summary"])


@query("S16 W5", """SELECT 'p' || s_suppkey AS id, CAST(s_suppkey % 10 AS INTEGER) AS ord, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'noted' ELSE '' END AS note,
'https://d.example' AS source_url, 'active' AS status FROM supplier""")
def platform_load(spark, d) -> DataFrame:
    """A platform file's items, with array positions and defaults, as store rows."""
    k = F.col("s_suppkey")
    item = F.struct(F.concat(F.lit("p"), k.cast("string")).alias("id"), F.lit("shopping").alias("kind"), F.col("s_name").alias("name"),
                    F.when(k % 2 == 0, "noted").alias("note"), F.lit("u").alias("url"))
    files = table(spark, d, "supplier").groupBy(F.floor(k / 10)).agg(F.transform(F.array_sort(F.collect_list(F.struct(k, item.alias("i")))), lambda x: x["i"]).alias("items"))
    rows = files.select(F.posexplode("items").alias("pos", "i")).select("pos", "i.*")
    return tables.platform_store(rows, "https://d.example", "2024-01-01").select("id", "ord", "name", "note", "source_url", "status")


# ---- the feed from landed pages ---------------------------------------------------------
def _platform_pages(spark, d, total: int) -> DataFrame:
    k = F.col("s_suppkey")
    label = F.when(k % 3 == 0, "배달").when(k % 3 == 1, " 쇼핑 ").otherwise("Etc")
    row = F.struct(
        k.cast("int").alias("postNo"), (k % 50).cast("int").alias("ordNo"), label.alias("ecommerceCategoryNm"),
        F.concat(F.lit(" "), "s_name").alias("ecommerceMgtNm"), F.when(k % 2 == 0, "one ").alias("ecommerceIntroCn1"),
        F.when(k % 5 != 0, " two").otherwise("  ").alias("ecommerceIntroCn2"), F.lit("u").alias("ecommerceUrl"),
    )
    pages = table(spark, d, "supplier").groupBy((F.floor(k / 10) + 1).alias("page_no")).agg(F.collect_list(row).alias("list"))
    code = F.when(F.col("page_no") % 6 == 5, "E500").otherwise("0000")
    data = F.struct(F.lit(total).cast("bigint").alias("totalCnt"), F.lit(1).alias("totalPage"), "list")
    return pages.select("page_no", F.to_json(F.struct(code.alias("resCode"), data.alias("data"))).alias("value"))


@query("S5 X16", """SELECT CAST(s_suppkey AS INTEGER) AS post_no, CAST(s_suppkey % 50 AS INTEGER) AS ord, CASE s_suppkey % 3 WHEN 0 THEN 'delivery' WHEN 1 THEN 'shopping' ELSE 'etc' END AS kind,
s_name AS name, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 THEN 'one, two' WHEN s_suppkey % 2 = 0 THEN 'one' WHEN s_suppkey % 5 <> 0 THEN 'two' END AS summary
FROM supplier WHERE (s_suppkey // 10 + 1) % 6 <> 5""")
def platform_feed(spark, d) -> DataFrame:
    return landed.platform_pages(_platform_pages(spark, d, 30)).select("post_no", "ord", "kind", "name", "summary")


@query("S5", """SELECT DISTINCT s_suppkey // 10 + 1 AS page_no, 'resCode=E500' AS reason FROM supplier WHERE (s_suppkey // 10 + 1) % 6 = 5
UNION ALL SELECT 1, 'totalCnt=9 < 10'""")
def platform_guard(spark, d) -> DataFrame:
    return landed.platform_page_faults(_platform_pages(spark, d, 9))


@query("X16", """SELECT p_partkey, lower(trim(p_type)) AS kind, CASE WHEN p_size % 2 = 0 THEN p_name || ', ' || p_brand ELSE p_brand END AS summary FROM part""")
def kind_and_summary(spark, d) -> DataFrame:
    first = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(" ")
    return table(spark, d, "part").select("p_partkey", platform_kind(F.col("p_type")).alias("kind"), joined_or_null(first, F.col("p_brand")).alias("summary"))


# ---- lists and counts -------------------------------------------------------------------------
@query("T4 W4", f"WITH {PLATFORMS} SELECT id, row_number() OVER (ORDER BY ord ASC NULLS LAST, name, id) AS no FROM platforms")
def platform_order(spark, d) -> DataFrame:
    """All platforms in display order, shown as row numbers."""
    return ordering.number_all(platforms(spark, d), [F.asc_nulls_last("ord"), "name", "id"], "no").select("id", "no")


@query("T4 P12", f"WITH {PLATFORMS} SELECT id, ord, name FROM platforms WHERE status = 'active' AND kind = 'delivery'")
def platform_list(spark, d) -> DataFrame:
    return reports.display_order(reports.platform_list(platforms(spark, d), "delivery")).select("id", "ord", "name")


@query("W4 P12", f"WITH {PLATFORMS} SELECT id, row_number() OVER (ORDER BY name, id) AS no FROM platforms WHERE status = 'active' AND kind <> 'delivery'")
def numbered_list(spark, d) -> DataFrame:
    rows = platforms(spark, d).filter("status = 'active' AND kind <> 'delivery'")
    return ordering.number_all(rows, ["name", "id"], "no").select("id", "no")


@query("A23", f"""WITH {PLATFORMS} SELECT count(*) AS active, count(*) FILTER (kind <> 'delivery') AS shopping, count(*) FILTER (kind = 'delivery') AS delivery
FROM platforms WHERE status = 'active'""")
def platform_counts(spark, d) -> DataFrame:
    return reports.platform_counts(platforms(spark, d))


@query("A24 P12", f"""WITH {PLATFORMS}, lists AS (SELECT kind, list(name ORDER BY ord NULLS FIRST, name) AS ns FROM platforms WHERE status = 'active' AND region_limited GROUP BY 1),
packed AS (SELECT kind, {pack_sql("ns", "CASE WHEN a.open IS NULL THEN x.u ELSE a.open || ', ' || x.u END", "a.open IS NULL OR length(a.open) + 2 + length(x.u) <= 900")} AS ps FROM lists)
SELECT kind, unnest(range(0, len(ps))) AS no, unnest(ps) AS names FROM packed""")
def region_limited_names(spark, d) -> DataFrame:
    return reports.region_limited_names(platforms(spark, d), "kind")


@query("A25", "SELECT CASE p_size % 3 WHEN 0 THEN 'allowed' WHEN 1 THEN 'conditional' ELSE 'denied' END AS verdict, count(*) AS count FROM part GROUP BY 1")
def verdict_counts(spark, d) -> DataFrame:
    v = F.when(F.col("p_size") % 3 == 0, "allowed").when(F.col("p_size") % 3 == 1, "conditional").otherwise("denied")
    return reports.verdict_counts(table(spark, d, "part").withColumn("verdict", v))


@query("A11", f"WITH {PLATFORMS} SELECT CAST(min(collected_on) AS VARCHAR) AS stamp FROM platforms WHERE status = 'active'")
def stamp_min_active(spark, d) -> DataFrame:
    rows = reports.oldest_stamp(platforms(spark, d), "collected_on", F.col("status") == "active")
    return rows.select(F.col("stamp").cast("string").alias("stamp"))


@query("U6 A11", """WITH s AS (SELECT min(strftime(o_orderdate, '%Y-%m-%d')) AS stamp FROM orders UNION ALL SELECT min(strftime(l_shipdate, '%Y-%m-%d')) FROM lineitem UNION ALL SELECT min(strftime(ts, '%Y-%m-%d')) FROM events)
SELECT min(stamp) AS stamp, substr(min(stamp), 1, 7) AS month FROM s""")
def stamp_min(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    l = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"))
    e = table(spark, d, "events").select(F.col("ts").cast("date").alias("day"))
    return reports.oldest_of((o, "day"), (l, "day"), (e, "day"))


@query("W6", """SELECT id FROM (SELECT CAST(s_suppkey AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(s_suppkey AS VARCHAR)) - 1 AS i FROM supplier)
WHERE i % 7 = (DATE '2026-08-24' - DATE '1970-01-01') % 7""")
def daily_slice(spark, d) -> DataFrame:
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    return ordering.daily_slice(ids, "id", F.lit("2026-08-24").cast("date"))


# ---- the goods catalog ----------------------------------------------------------------------------
# Languages are goods categories, the corpus is the parent; sources are brands; documents with a label are catalog entries.
def _codes(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("lang").distinct().filter("lang <> 'fr'")
    return docs.select(F.col("lang").alias("code"), F.concat(F.lit("text/"), F.upper("lang")).alias("label"), F.lit("text").alias("parent"))


def _catalog(spark, d) -> DataFrame:
    entries = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return entries.select(
        F.col("doc_id").cast("string").alias("id"),
        F.array(F.col("lang"), F.when(F.col("quality") == 1, "fine").otherwise("plain")).alias("cats"),
        F.array(F.col("source")).alias("brands"), F.when(F.col("doc_id") % 2 == 0, "seen").alias("evidence"),
    )


def _shops(spark, d) -> DataFrame:
    rows = table(spark, d, "documents")
    kind = F.when(F.col("n_chars") % 2 == 0, "shopping").otherwise("delivery")
    return rows.select(F.col("doc_id").cast("string").alias("id"), kind.alias("kind"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("N"), F.col("doc_id").cast("string"))).alias("name"))


@query("P19 J7", """SELECT CAST(d.doc_id AS VARCHAR) AS id FROM documents d JOIN labels USING (doc_id) WHERE n_chars % 2 = 0 AND lang <> 'fr' AND source IN ('src1')""")
def catalog_filter(spark, d) -> DataFrame:
    return cat.filter_catalog(_shops(spark, d), _catalog(spark, d), _codes(spark, d), kind="shopping", code="text", brand="src1").select("id")


_LABELS = "CASE WHEN lang = 'fr' THEN 'fr' ELSE 'text/' || upper(lang) END || ', ' || CASE WHEN quality = 1 THEN 'fine' ELSE 'plain' END"


CATALOG_TEXTS = f"""SELECT CAST(doc_id AS VARCHAR) AS id, '온라인몰 ''' || CASE WHEN doc_id % 3 > 0 THEN 'N' || doc_id ELSE CAST(doc_id AS VARCHAR) END || ''' 취급 물품종류(실측): ' || {_LABELS}
|| '. 확인된 브랜드: ' || source || '.' || CASE WHEN doc_id % 2 = 0 THEN ' (근거: seen)' ELSE '' END AS content FROM documents JOIN labels USING (doc_id)"""


@query("J6 J7 X32", CATALOG_TEXTS)
def catalog_texts(spark, d) -> DataFrame:
    named = cat.with_platform_name(_catalog(spark, d), _shops(spark, d).filter("name IS NOT NULL"))
    rows = cat.with_labels(named, _codes(spark, d))
    return rows.select("id", corpus.catalog_text(F.col("name"), F.col("labels"), F.col("brands"), F.col("evidence")).alias("content"))


@query("J7", """SELECT r_name AS code, 'L ' || r_name AS label, CAST(NULL AS VARCHAR) AS parent FROM region
UNION ALL SELECT n_name, 'L ' || r_name || '/' || 'N ' || n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'p' || p_partkey, 'L ' || r_name || '/' || p_name, r_name FROM part JOIN region ON p_partkey % 5 = r_regionkey""")
def taxonomy_flat(spark, d) -> DataFrame:
    """A two-level taxonomy as codes and labels: nations and parts below regions."""
    r, n, p = (table(spark, d, t) for t in ("region", "nation", "part"))
    sub = lambda code, label: F.struct(code.alias("id"), label.alias("label"))
    nations = n.select(F.col("n_regionkey").alias("k"), sub(F.col("n_name"), F.concat(F.lit("N "), F.col("n_nationkey").cast("string"))).alias("s"))
    parts = p.select((F.col("p_partkey") % 5).alias("k"), sub(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.col("p_name")).alias("s"))
    # Parents hold their children as lists, as the taxonomy's file does; a parent's list comes in blocks of parts.
    blocks = nations.withColumn("b", F.lit(0)).unionByName(parts.withColumn("b", F.pmod(F.xxhash64("s"), F.lit(64)).cast("int") + 1))
    lists = blocks.groupBy("k", "b").agg(F.collect_list("s").alias("subs"))
    taxonomy = lists.join(r, F.col("k") == F.col("r_regionkey")).select(F.col("r_name").alias("id"), F.concat(F.lit("L "), "r_name").alias("label"), "subs")
    return cat.flat_taxonomy(taxonomy).distinct()


@query("J7", "SELECT CASE WHEN quality = 1 THEN 'fine' ELSE 'plain' END AS code, count(*) AS uses FROM labels JOIN documents USING (doc_id) GROUP BY 1 UNION ALL SELECT 'fr', count(*) FROM documents JOIN labels USING (doc_id) WHERE lang = 'fr'")
def catalog_unmapped(spark, d) -> DataFrame:
    return cat.unmapped_codes(_catalog(spark, d), _codes(spark, d))


@query("U5", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '+' || lang ELSE source END AS merged FROM documents""")
def catalog_merge(spark, d) -> DataFrame:
    new = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source"))
    merged = cat.merge_confirmed(F.array("source"), new)
    return table(spark, d, "documents").select("doc_id", F.array_join(merged, "+").alias("merged"))
