"""Region snapshots, the public list, and the tables written from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.text import (
    all_matches, dong_of, goods_category, goods_text, gu_of, lookup, only_listed, or_empty, place_category, strip,
)
from waymark.operators.brands import with_brand
from waymark.operators.ordering import hashed_ids, keep_first
from waymark.schema import PLACE_COLUMNS, PUBLIC_CSV, SNAPSHOT


# ---- snapshot files -----------------------------------------------------------
def read_snapshots(spark: SparkSession, paths: Sequence[str], files: Mapping[str, str] = fixed.REGION_FILES, folder: str | None = None, by_line: bool = False) -> DataFrame:
    """Snapshot files as (meta, items, region, file, doc); the region is named by the file, or by the partition ``folder`` it lies in.

    One document per file, or per line with ``by_line``, which spares a store of
    very many documents a file each; ``doc`` is a document's place in its file.
    """
    raw = spark.read.schema(SNAPSHOT).option("multiLine", not by_line).json(list(paths))
    # Lines are numbered within the block of the file that a task reads.
    file = F.col("_metadata.file_path").alias("file")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("doc")
    stem = F.regexp_extract("file", r"([^/]+?)(?:[-_.][^/]*)?\.json[^/]*$", 1) if folder is None else F.col("_folder")
    named = raw.select("meta", "items", file, place, *([] if folder is None else [F.col(folder).cast("string").alias("_folder")]))
    return named.withColumn("region", lookup(stem, {code: region for region, code in files.items()})).drop("_folder")


def snapshot_items(snapshots: DataFrame) -> DataFrame:
    """One row per place of a snapshot, in the place table's columns, with its position."""
    rows = snapshots.select("region", "file", "doc", F.posexplode("items").alias("pos", "i"))
    return rows.select(*[F.col("region") if c == "region" else F.col(f"i.{c}").alias(c) for c in PLACE_COLUMNS], "file", "doc", "pos")


def snapshot_dates(snapshots: DataFrame) -> DataFrame:
    """(region, collected_on) per snapshot, null where the file does not say."""
    return snapshots.select("region", F.col("meta.collected_on").alias("collected_on"))


def full_refresh(items: DataFrame, order: Sequence[Column | str] = ("file", "doc", "pos")) -> DataFrame:
    """The place table a full load leaves: the first row of every id."""
    return keep_first(items, ["id"], order).select(*PLACE_COLUMNS)


def write_snapshot(places: DataFrame, path: str, files: int | None = None, fmt: str = "json") -> None:
    """Places by region, sorted inside each file by region level and name.

    Rows are spread by a range over (region, levels, name), so a region that
    holds most places is written by many tasks.
    """
    level = lambda c: F.coalesce(F.col(c), F.lit(""))
    order = [F.col("region"), level("si"), level("gu"), level("dong"), F.col("name"), F.col("id")]
    cut = places.repartitionByRange(files, *order) if files else places.repartitionByRange(*order)
    cut.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("region").format(fmt).save(path)


def write_snapshot_documents(places: DataFrame, path: str, collected_on: str, bucket: Column, files: Mapping[str, str]) -> None:
    """``{meta, items}`` documents of bounded size, one per (region, bucket) and line, in a folder per region.

    Their number follows the table, the number of files only the tasks that write.
    """
    item = F.struct(*[F.col(c) for c in PLACE_COLUMNS if c != "region"])
    docs = places.groupBy("region", bucket.alias("bucket")).agg(F.collect_list(item).alias("items")).select(
        lookup(F.col("region"), files).alias("name"),
        F.to_json(F.struct(F.struct("region", F.lit(collected_on).alias("collected_on")).alias("meta"), "items")).alias("value"),
    )
    docs.write.mode("overwrite").partitionBy("name").text(path)


# ---- the public list -------------------------------------------------------------
def read_public_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The public list; fields are text, trimmed; the header (and its byte order mark) is skipped."""
    raw = spark.read.schema(PUBLIC_CSV).option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    return raw.select(*[strip(or_empty(F.col(c))).alias(c) for c in PUBLIC_CSV.fieldNames()])


def public_places(rows: DataFrame, regions: Mapping[str, str], position: str) -> DataFrame:
    """Rows of the wanted regions with category, matched rules and a stable hashed id."""
    kept = rows.filter(F.col("region").isin(list(regions)))
    staged = kept.withColumn("category", goods_category(F.col("name"), F.col("items"))).withColumn(
        "matches", all_matches(goods_text(F.col("name"), F.col("items")), fixed.GOODS_RULES)
    ).withColumn("risky", F.size("matches") >= 2)
    parts = [F.col(c) for c in ("name", "market", "items", "year")]
    return hashed_ids(staged, lookup(F.col("region"), regions), parts, position)


# ---- the place source API ----------------------------------------------------------
def place_rows(api: DataFrame, brands: DataFrame | None = None, city_region: str = fixed.FOUR_LEVEL_REGION) -> DataFrame:
    """Place table rows from API rows with their query context (``query_sido``, ``query_addr``).

    The query names the district, or in one region the city; there the
    district comes from the address, if it is a known one.
    """
    region = F.col("query_sido")
    in_city = region == city_region
    gu = only_listed(gu_of(F.col("frcsAddr"), region), fixed.SUB_DISTRICTS)
    rows = api.select(
        F.col("frCd").alias("id"), strip(or_empty(F.col("frcsNm"))).alias("name"),
        place_category(strip(or_empty(F.col("frcsNm"))), F.col("placeTypeNm")).alias("cat"),
        F.lit(None).cast("string").alias("brand"), region.alias("region"),
        F.when(in_city, F.col("query_addr")).alias("si"),
        F.when(in_city, gu).otherwise(F.col("query_addr")).alias("gu"),
        dong_of(F.col("frcsAddr")).alias("dong"), strip(or_empty(F.col("frcsAddr"))).alias("addr"),
        *[or_empty(F.col(a)).alias(b) for a, b in (("mrktNm", "market"), ("mrktType", "market_type"), ("paperYn", "paper"), ("cardYn", "card"), ("qrYn", "qr"))],
        F.col("latitude").alias("lat"), F.col("longitude").alias("lng"),
    )
    if brands is None:
        return rows
    return with_brand(rows, brands).select(*PLACE_COLUMNS)
