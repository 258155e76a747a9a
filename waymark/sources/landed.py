"""Landed API pages, envelopes around captures, feeds, and two-schema payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark import fixed
from waymark.functions.text import once, spread, strip
from waymark.functions.values import joined_or_null, mail_date_to_local, plain_text, platform_kind, title_without_source
from waymark.schema import API_PLACE, API_PLATFORM, envelope


def read_texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """Whole files as (file, value) and the columns of partition folders."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    return raw.select(F.col("_metadata.file_name").alias("file"), *raw.columns)


# ---- API pages -------------------------------------------------------------------
def parse_pages(pages: DataFrame, row: T.StructType, good: bool, value: str = "value") -> DataFrame:
    """The good pages, or the others, with their envelope as ``page``.

    A page is good when it can be read and carries the success code.  Pages are
    chosen inside an array, so that each text is parsed once.
    """
    keep = [c for c in pages.columns if c != value]
    chosen = F.filter(F.array(_opened(F.col(value), row)), lambda p: _succeeded(p) if good else ~_succeeded(p))
    return spread(pages, keep, chosen, "page")


def _opened(value: Column, row: T.StructType) -> Column:
    empty = F.lit(None).cast(envelope(row))
    return F.coalesce(F.from_json(value, envelope(row)), F.struct(*[empty[f].alias(f) for f in envelope(row).fieldNames()]))


def _succeeded(page: Column) -> Column:
    return F.coalesce(page["resCode"] == fixed.OK_CODE, F.lit(False))


def open_place_pages(pages: DataFrame) -> DataFrame:
    """Landed pages with their envelope as ``page`` in place of the text; written, they are parsed once for faults and rows."""
    return pages.select("query_sido", "query_addr", "page_no", _opened(F.col("value"), API_PLACE).alias("page"))


def _chosen(pages: DataFrame, good: bool) -> DataFrame:
    """The good place pages, or the others, of landed or of opened pages."""
    if "value" in pages.columns:
        return parse_pages(pages, API_PLACE, good)
    ok = _succeeded(F.col("page"))
    return pages.filter(ok if good else ~ok)


def place_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(API rows with the page's context, rejected pages).

    ``pages`` holds (value, query_sido, query_addr, page_no) per landed page, or
    comes from ``open_place_pages``.
    """
    where = ["query_sido", "query_addr", "page_no"]
    rows = spread(_chosen(pages, True), where, F.col("page.data.list"), "r", "pos").select(*where, "pos", "r.*")
    rejects = _chosen(pages, False).select(
        *where, F.col("page.resCode").alias("code"), F.col("page.resMsg").alias("message")
    )
    return rows, rejects


def place_page_faults(pages: DataFrame) -> DataFrame:
    """(query_sido, query_addr, page_no, reason) of what makes a landed run incomplete; no rows means it is whole.

    Faults are pages without the success code, and pages of 1..totalPage (the
    largest that a district's good pages name) that did not arrive.
    """
    where = ["query_sido", "query_addr"]
    bad = _chosen(pages, False).select(*where, "page_no", F.concat(F.lit("resCode="), F.coalesce("page.resCode", F.lit("?"))).alias("reason"))
    last = _chosen(pages, True).groupBy(*where).agg(F.max(F.coalesce("page.data.totalPage", F.lit(1))).alias("last"))
    number = pages.schema["page_no"].dataType
    wanted = last.select(*where, F.explode(F.sequence(F.lit(1).cast(number), F.greatest("last", F.lit(1)).cast(number))).alias("page_no"))
    missing = wanted.join(pages.select(*where, "page_no").distinct(), [*where, "page_no"], "left_anti")
    return bad.unionByName(missing.withColumn("reason", F.lit("missing")))


def declared_counts(pages: DataFrame) -> DataFrame:
    """(district, total_cnt) per page; a district whose pages are all bad is there with null."""
    district = F.concat_ws(" ", "query_sido", "query_addr").alias("district")
    good = parse_pages(pages, API_PLACE, True).select(district, F.col("page.data.totalCnt").alias("total_cnt"))
    return good.unionByName(parse_pages(pages, API_PLACE, False).select(district, F.lit(None).cast("bigint").alias("total_cnt")))


def platform_pages(pages: DataFrame) -> DataFrame:
    """Platform feed rows in page order: (seq, post_no, ord, kind, name, summary, url)."""
    rows = spread(parse_pages(pages, API_PLATFORM, True), ["page_no"], F.col("page.data.list"), "r", "pos")
    return rows.select(
        (F.col("page_no").cast("bigint") * F.lit(1 << 32) + F.col("pos")).alias("seq"),
        F.col("r.postNo").alias("post_no"), F.col("r.ordNo").alias("ord"),
        platform_kind(F.col("r.ecommerceCategoryNm")).alias("kind"),
        strip(F.coalesce("r.ecommerceMgtNm", F.lit(""))).alias("name"),
        joined_or_null(F.col("r.ecommerceIntroCn1"), F.col("r.ecommerceIntroCn2")).alias("summary"),
        F.col("r.ecommerceUrl").alias("url"),
    )


def platform_page_faults(pages: DataFrame, min_total: int = fixed.PLATFORM_MIN_TOTAL) -> DataFrame:
    """Reasons to skip a platform run and keep the old table; no rows means it may go on.

    Faults are bad pages, a total below ``min_total``, no page 1, and pages of
    1..totalPage (as page 1 tells) that did not arrive.
    """
    bad = parse_pages(pages, API_PLATFORM, False).select(
        "page_no", F.concat(F.lit("resCode="), F.coalesce("page.resCode", F.lit("?"))).alias("reason")
    )
    first = parse_pages(pages.filter("page_no = 1"), API_PLATFORM, True)
    few = F.coalesce("page.data.totalCnt", F.lit(0).cast("bigint"))
    short = first.filter(few < min_total).select(
        "page_no", F.concat(F.lit("totalCnt="), few.cast("string"), F.lit(f" < {min_total}")).alias("reason")
    )
    every = first.agg(F.count(F.lit(1)).alias("n"), F.max("page.data.totalPage").alias("pages"))
    wanted = every.select(F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1)))).alias("page_no"))
    # Bad pages that arrived have their own reason already.
    missing = wanted.join(pages.select(F.col("page_no").cast("int").alias("page_no")).distinct(), "page_no", "left_anti")
    missing = missing.select(F.col("page_no").cast(pages.schema["page_no"].dataType).alias("page_no"), F.lit("missing").alias("reason"))
    return bad.unionByName(short).unionByName(missing)


def read_faq(texts: DataFrame, value: str = "value") -> DataFrame:
    """(cat, q, a) rows with their position from FAQ files ``{items: [...]}``."""
    schema = "items array<struct<cat: string, q: string, a: string>>"
    return spread(texts, [], F.from_json(value, schema)["items"], "i", "pos").select("pos", "i.*")


# ---- envelopes ----------------------------------------------------------------------
def unwrap(value: Column) -> Column:
    """JSON text without its code fence and up to three levels of JSON inside JSON text."""
    fence = r"(?s)```(?:json)?\s*(.*?)```"

    def opened(c: Column) -> Column:
        # A document that is itself a JSON text is opened through a one-field wrapper.
        wrapped = F.get_json_object(F.concat(F.lit('{"x":'), c, F.lit("}")), "$.x")
        return F.when(c.startswith('"'), wrapped).otherwise(c)

    def level(body: Column, key: Column) -> Column:
        inner = F.call_function("get_json_object", body, F.concat(F.lit("$."), key))
        return once(inner, lambda i: F.when(i.startswith("{") | i.startswith('"'), opened(i)).otherwise(body))

    body = F.when(value.rlike(fence), F.regexp_extract(value, fence, 1)).otherwise(value)
    keys = F.array(*[F.lit(k) for k in ("result", "value", "data")])
    return F.aggregate(keys, once(strip(body), opened), level)


CAPTURE = "title string, url string, text string, cats array<string>, brandLinks array<struct<text: string, href: string>>"


def captures(values: DataFrame, value: str = "value") -> DataFrame:
    """Captured pages from wrapped JSON; rows without a text are dropped."""
    kept = [c for c in values.columns if c != value]
    # Rows are dropped inside the array, so the text is parsed once and not again for a filter.
    read = F.filter(F.array(F.from_json(unwrap(F.col(value)), CAPTURE)), lambda c: c["text"].isNotNull())
    return spread(values, kept, read, "c").select(*kept, "c.*")


# ---- two schemas, one form -------------------------------------------------------------
def normalized_platforms(raw: DataFrame) -> DataFrame:
    """Platform rows from either naming style; snake_case wins where both are present."""
    have = set(raw.columns)

    def pick(snake: str, camel: str | None = None, default: Column | None = None) -> Column:
        found = [F.col(c) for c in (snake, camel) if c and c in have]
        return F.coalesce(*found, default if default is not None else F.lit(None)).alias(snake)

    text = lambda name, camel=None: pick(name, camel, F.lit(""))
    no_regions = F.array().cast("array<string>")
    return raw.select(
        pick("id"), pick("no"), pick("kind"), pick("name"), text("summary"), text("note"), pick("url"),
        pick("region_limited", "regionLimited", F.lit(False)), pick("regions", None, no_regions),
        text("source_url", "sourceUrl"), text("collected_on", "collectedOn"),
        F.coalesce(F.nullif(pick("status"), F.lit("")), F.lit("active")).alias("status"),
    )


# ---- feeds --------------------------------------------------------------------------------
def feed_items(feeds: DataFrame, xml: str = "xml", max_items: int | None = None) -> DataFrame:
    """Items of landed feeds: (feed columns, pos, title, link, source, pub_date).

    Items without title or link are dropped; positions count the others.
    ``max_items`` keeps the first of each feed; the source's number is
    ``fixed.FEED_MAX_ITEMS``.
    """
    kept = [c for c in feeds.columns if c != xml]
    blocks = F.regexp_extract_all(F.coalesce(F.col(xml), F.lit("")), F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))

    def tag(block: Column, pattern: str) -> Column:
        return F.when(block.rlike(pattern), strip(F.regexp_extract(block, pattern, 1)))

    def item(b: Column) -> Column:
        return F.struct(
            plain_text(tag(b, r"(?s)<title>(.*?)</title>")).alias("title"),
            plain_text(tag(b, r"(?s)<link>(.*?)</link>")).alias("link"),
            plain_text(tag(b, r"<source[^>]*>(.*?)</source>")).alias("source"),
            tag(b, r"<pubDate>(.*?)</pubDate>").alias("pub"),
        )

    usable = F.filter(F.transform(blocks, item), lambda i: i["title"].isNotNull() & i["link"].isNotNull())
    rows = spread(feeds, kept, usable if max_items is None else F.slice(usable, 1, max_items), "i", "pos")
    return rows.select(
        *kept, "pos", title_without_source(F.col("i.title"), F.col("i.source")).alias("title"),
        F.col("i.link").alias("link"), F.col("i.source").alias("source"), mail_date_to_local(F.col("i.pub")).alias("pub_date"),
    )
