"""Queries over stored pages: labels, dictionary matches, goods codes, additions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions import occurrences as occ
from waymark.functions.text import goods_codes
from waymark.functions.values import is_deep_link
from waymark.operators import survey
from waymark.plans.registry import query, table
from waymark.session import work_folder
from waymark.sources import html as web
from waymark.sources import tables

# The dictionary: all words of the benchmark.
_WORDS = """words AS (SELECT term FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM benchmark) WHERE term <> '' GROUP BY 1)"""


def _terms(spark, d) -> DataFrame:
    words = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term"))
    return words.filter("term <> ''").distinct()


_W = fixed.WORD_CHARS
# The text of a page as a reader sees it: no head, no comments, a line per block, references decoded.
_BLOCKS = "p|div|li|ul|ol|nav|header|article|section|table|tr|h[1-6]|br|footer|main"
_BARE = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
 '</?({_BLOCKS})(\s[^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g')"""
_DECODED = _BARE
for _name, _char in (("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("copy", "'©'"), ("middot", "'·'"), ("amp", "'&'")):
    _DECODED = f"replace({_DECODED}, '&{_name};', {_char})"
_TEXTS = rf"""texts AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split({_DECODED}, chr(10)),
 lambda l: trim(regexp_replace(l, '[ \t\r\f\v]+', ' ', 'g'), ' ')), lambda l: l <> ''), chr(10)) AS body FROM pages)"""
_FOUND = f"""{_WORDS}, {_TEXTS}, found AS (SELECT page_id, term, body, (length(body) - length(replace(body, term, ''))) // length(term) AS n,
 NOT regexp_matches(body, '(^|[^{_W}])' || term || '([^{_W}]|$)') AS suspect FROM texts JOIN words ON contains(body, term))"""


def _texts(spark, d) -> DataFrame:
    return web.parsed_pages(table(spark, d, "pages")).select("page_id", "url", "text")


@query("S9 X24", f"WITH {_TEXTS} SELECT page_id, length(body) AS chars, len(string_split(body, chr(10))) AS lines, md5(body) AS digest FROM texts")
def page_text(spark, d) -> DataFrame:
    """The visible text of every page."""
    return _texts(spark, d).select(
        "page_id", F.char_length("text").cast("bigint").alias("chars"), F.size(F.split("text", "\n")).cast("bigint").alias("lines"), F.md5("text").alias("digest")
    )


@query("J10 X22", f"WITH {_FOUND} SELECT page_id, term, n AS count, suspect FROM found")
def page_dictionary(spark, d) -> DataFrame:
    """Every occurrence is counted: the survey's stop after 201 hits is left off here."""
    return survey.page_terms(_texts(spark, d), _terms(spark, d), contexts=False).select("page_id", "term", "count", "suspect")


@query("J10", f"WITH {_FOUND} SELECT page_id, term FROM found")
def page_dictionary_by_seed(spark, d) -> DataFrame:
    """Which terms a page names, from one scan of the pages."""
    return survey.page_terms(_texts(spark, d), _terms(spark, d), contexts=False).select("page_id", "term")


@query("X22", f"""WITH {_FOUND}, f AS (SELECT page_id, term, strpos(body, term) - 1 AS p0, body FROM found)
SELECT page_id, term, regexp_replace(regexp_replace(substr(body, greatest(0, p0 - 20) + 1, p0 + length(term) + 20 - greatest(0, p0 - 20)), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS first_ctx FROM f""")
def page_contexts(spark, d) -> DataFrame:
    return survey.page_terms(_texts(spark, d), _terms(spark, d)).select("page_id", "term", F.element_at("ctxs", 1).alias("first_ctx"))


# ---- navigation ----------------------------------------------------------------------------
_NAV = """nav AS (SELECT page_id, url, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a [^>]*>([^<]*)</a>', 1) AS labels,
 regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)">', 1) AS hrefs FROM pages)"""


def _collected(spark, d, **rules) -> DataFrame:
    return web.collected(web.parsed_pages(table(spark, d, "pages")), **rules)


@query("S9", f"""WITH {_NAV} SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(labels, lambda l: length(l) BETWEEN 1 AND 18 AND NOT regexp_matches(l, '^https?:')))), '|') AS cats,
array_to_string(list_filter(labels, lambda l: contains(l, 'th')), '|') AS brand_texts FROM nav""")
def page_links(spark, d) -> DataFrame:
    rows = _collected(spark, d, brand_word="th")
    return rows.select("page_id", F.array_join(F.array_sort("cats"), "|").alias("cats"), F.array_join("brand_links.text", "|").alias("brand_texts"))


@query("X26", r"""SELECT page_id, regexp_matches(url, '^[a-z]+://[^/?#]+(/+[^/?#]+/+[^/?#]+|[^#]*\?[^#])') AS deep FROM pages""")
def deep_link(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", is_deep_link(F.col("url")).alias("deep"))


# ---- lists and analysis -----------------------------------------------------------------------
# Documents as page texts: a marker line in front, words cut to short lines.
@query("X23", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda w: trim(regexp_replace(w, '\s', ' ', 'g'), ' ')), lambda w: w <> '') AS ws FROM documents),
m AS (SELECT doc_id, ws, list_transform(ws, lambda w: length(w) <= 16 AND NOT regexp_matches(w, '\d{2,}|[₩$]|무료배송|배송비|★|리뷰|후기|할인|더보기|장바구니|로그인|검색|%')) AS ok FROM l),
e AS (SELECT *, coalesce(list_filter(range(1, len(ws)), lambda i: NOT ok[i] AND NOT ok[i + 1])[1], len(ws) + 1) AS stop FROM m)
SELECT doc_id, coalesce(array_to_string(list_filter(ws, lambda w, i: i < stop AND ok[i]), ' '), '') AS items FROM e""")
def list_segment(spark, d) -> DataFrame:
    # A line per word: blanks end lines, other white space becomes a blank.
    rows = table(spark, d, "documents").select("doc_id", F.translate("text", " \t\n\x0b\f\r", "\n     ").alias("t"))
    marked = F.concat(F.lit("top\n브랜드관\n"), F.col("t"))
    return rows.select("doc_id", F.array_join(occ.list_after(marked), " ").alias("items"))


_TERMS = ["the", "Of", "an", "The", "que", "example", "한샘"]
_SEEN = f"""{_TEXTS}, seen AS (SELECT page_id, url, body, list_filter({_TERMS}, lambda t: contains(body, t) AND regexp_matches(body, '(^|[^{_W}])' || t || '([^{_W}]|$)')) AS confirmed,
 list_filter({_TERMS}, lambda t: contains(body, t) AND NOT regexp_matches(body, '(^|[^{_W}])' || t || '([^{_W}]|$)')) AS suspect FROM texts)"""


def _analyzed(spark, d) -> DataFrame:
    return survey.analyze(_texts(spark, d), _TERMS)


_CONTEXTS = f"""array_to_string(list_transform(list_filter({_TERMS}, lambda t: contains(body, t)), lambda t: t || '=' || CAST((length(body) - length(replace(body, t, ''))) // length(t) AS VARCHAR) || ':' ||
 regexp_replace(regexp_replace(substr(body, greatest(1, strpos(body, t) - 20), strpos(body, t) + length(t) + 20 - greatest(1, strpos(body, t) - 20)), '\\s+', ' ', 'g'), '^ | $', '', 'g')), '|') AS contexts"""


@query("X24 X25", f"""WITH {_SEEN} SELECT page_id, array_to_string(confirmed, ',') AS confirmed, array_to_string(suspect, ',') AS suspect, {_CONTEXTS}, length(body) AS text_len, length(body) < 1500 AS thin FROM seen""")
def page_analysis(spark, d) -> DataFrame:
    first = F.transform("contexts", lambda c: F.concat(c["term"], F.lit("="), c["count"].cast("string"), F.lit(":"), c["ctxs"][0]))
    return _analyzed(spark, d).withColumn("contexts", F.array_join(first, "|")).select(
        "contexts",
        "page_id", F.array_join("confirmed", ",").alias("confirmed"), F.array_join("suspect", ",").alias("suspect"),
        "text_len", (F.col("text_len") < fixed.THIN_PAGE).alias("thin"),
    )


# ---- goods codes ------------------------------------------------------------------------------------
_LABELS = ["정육", "한우·소고기", "밤", "밤톨", "쌀/잡곡", "닭고기", "스포츠 의류", "TV장", "TV", "배 과수", "무", "무료", "등산화", "화장품", "홈", "축산"]
_RULES = "[" + ", ".join("{'code': '%s', 're': '%s'}" % (c, p.replace(r"\b", f"([^{_W}]|$)")) for c, p in fixed.GOODS_CODES) + "]"
_CODED = f"""labelled AS (SELECT p_partkey, [({_LABELS})[1 + p_partkey % 16], ({_LABELS})[1 + (p_partkey // 16) % 16]] AS cats FROM part),
hit AS (SELECT p_partkey, list_transform(list_filter({_RULES}, lambda r: regexp_matches(cats[1], r.re) OR regexp_matches(cats[2], r.re)), lambda r: r.code) AS codes FROM labelled),
coded AS (SELECT p_partkey, list_sort(CASE WHEN array_to_string(codes, ',') LIKE '%meat-%' THEN list_filter(codes, lambda c: c <> 'meat') ELSE codes END) AS codes FROM hit)"""


def _labelled(spark, d) -> DataFrame:
    words = F.array(*[F.lit(x) for x in _LABELS])
    k = F.col("p_partkey")
    pick = lambda i: F.element_at(words, (i % 16 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.array(pick(k), pick(F.floor(k / 16))).alias("cats"))


@query("X14", f"WITH {_CODED} SELECT p_partkey, array_to_string(codes, ',') AS codes FROM coded")
def goods_code_map(spark, d) -> DataFrame:
    return _labelled(spark, d).select("p_partkey", F.array_join(goods_codes(F.col("cats")), ",").alias("codes"))


# ---- additions ------------------------------------------------------------------------------------------
# Parts as surveyed pages: brands seen, a directory, labels; and what the catalog knew before.
def _report(spark, d) -> DataFrame:
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    seen = part.join(_labelled(spark, d), "p_partkey").select(
        "p_partkey", F.array("p_brand", "p_type").alias("confirmed"), F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_brand")).alias("directory"),
        "cats", (k % 4000).alias("text_len"),
    )
    known = part.filter(k % 3 != 0).select(
        "p_partkey", F.when(k % 2 == 0, F.array("p_brand", F.lit("gone"))).otherwise(F.array("p_type")).alias("known_brands"), F.array(F.lit("meat-beef")).alias("known_cats"),
    )
    return survey.delta(seen, known, "p_partkey")


_DELTA = f"""{_CODED}, b AS (SELECT p_partkey, list_distinct([p_brand, p_type, split_part(p_name, ' ', 1)]) AS seen, codes,
 CASE WHEN p_partkey % 3 = 0 THEN []::VARCHAR[] WHEN p_partkey % 2 = 0 THEN [p_brand, 'gone'] ELSE [p_type] END AS kb,
 CASE WHEN p_partkey % 3 = 0 THEN []::VARCHAR[] ELSE ['meat-beef'] END AS kc FROM part JOIN coded USING (p_partkey)),
delta AS (SELECT p_partkey, list_sort(list_filter(seen, lambda x: NOT list_contains(kb, x))) AS new_brands, list_filter(codes, lambda x: NOT list_contains(kc, x)) AS new_cats,
 len(seen) AS seen_brands, len(codes) AS seen_cats, p_partkey % 4000 < 1500 AS thin FROM b)"""


@query("J12 U3 U4 X25", f"WITH {_DELTA} SELECT p_partkey, array_to_string(new_brands, ',') AS new_brands, array_to_string(new_cats, ',') AS new_cats, seen_brands, seen_cats, thin FROM delta")
def page_delta(spark, d) -> DataFrame:
    return _report(spark, d).select(
        "p_partkey", F.array_join(F.array_sort("new_brands"), ",").alias("new_brands"), F.array_join("new_cats", ",").alias("new_cats"), "seen_brands", "seen_cats", "thin"
    )


@query("A26", f"""WITH {_DELTA} SELECT count(*) AS checked, count(*) FILTER (p_partkey % 10 <> 0 AND len(new_brands) + len(new_cats) > 0) AS changed,
count(*) FILTER (p_partkey % 10 = 0) AS failed, count(*) FILTER (p_partkey % 10 <> 0 AND thin) AS thin FROM delta""")
def survey_summary(spark, d) -> DataFrame:
    return survey.run_summary(_report(spark, d).withColumn("ok", F.col("p_partkey") % 10 != 0))


@query("S20", f"WITH {_DELTA} SELECT '2026-08-24' AS date, count(*) AS count FROM delta UNION ALL SELECT '2026-08-25', count(*) FROM delta WHERE thin")
def delta_report(spark, d) -> DataFrame:
    """Two days' reports written, the first one twice: a day's report replaces itself only."""
    path = work_folder(spark, "delta")
    report = _report(spark, d)
    tables.write_dated_report(report.limit(3), path, "2026-08-24")
    tables.write_dated_report(report.filter("thin"), path, "2026-08-25")
    tables.write_dated_report(report, path, "2026-08-24")
    back = spark.read.schema("p_partkey bigint, date string").json(path)
    return back.groupBy("date").agg(F.count(F.lit(1)).alias("count"))
