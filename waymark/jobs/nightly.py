"""The nightly jobs: places from landed pages to a published table, and the guarded reconcile of platforms."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from waymark import fixed
from waymark.jobs.ledger import forget_steps, record, recorded, run_steps
from waymark.operators.brands import assign_bases, brand_of, candidates, with_brand
from waymark.operators.ordering import keep_first
from waymark.operators.publishing import reconciled
from waymark.schema import PLACE_COLUMNS, PLATFORM, PLATFORM_COLUMNS
from waymark.sources.landed import open_place_pages, place_page_faults, place_pages, platform_page_faults, platform_pages
from waymark.sources.snapshots import place_rows
from waymark.sources.tables import current, get_stamp, point_to, publish

#: Where a page stands in the order of collection.
ARRIVAL = ["query_sido", "query_addr", "page_no", "pos"]
#: So many reasons are told; the others are only counted.
MOST_REASONS = 20
PLATFORM_STAMP = "platforms_collected_on"
_STEPS = ("pages", "faults", "rows", "bases", "candidates", "places")


@dataclass(frozen=True)
class Outcome:
    """Whether a run changed its store, why not, and what it counted."""

    applied: bool
    reasons: list[str]
    counts: dict[str, int]


def _reasons(faults: DataFrame, where: list[str]) -> list[str]:
    """The first faults as text, and how many more there are; empty for a whole run."""
    told = faults.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in where], F.lit("page"), F.concat(F.col("page_no").cast("string"), F.lit(":")), "reason").alias("r"))
    first = [r["r"] for r in told.orderBy("r").limit(MOST_REASONS + 1).collect()]
    if len(first) <= MOST_REASONS:
        return first
    return [*first[:MOST_REASONS], f"{faults.count() - MOST_REASONS} more"]


# ---- places -------------------------------------------------------------------
def nightly_places(
    spark: SparkSession, root: str, run: str, pages: DataFrame, collected_on: str,
    min_total: int = fixed.GUARD_MIN_TOTAL, tolerance: float = fixed.GUARD_TOLERANCE, **brand_rules,
) -> Outcome:
    """Landed pages to the published place table below ``root``.

    The pages are parsed once; their faults end the run before anything is built.  Rows are kept
    first by id in order of collection, brands detected over them, place rows
    made, and the table staged, guarded against the published one and swapped
    in.  Every step is written and recorded under ``run``: calling again with
    the same ``run`` goes on behind the last step that ended, and a run that is
    over answers with what it answered before.
    """
    told = recorded(spark, root, run, "outcome")
    if told is not None:
        return Outcome(**json.loads(told))
    seq = F.struct(*ARRIVAL)
    first_rows = lambda done: keep_first(place_pages(done["pages"])[0], ["frCd"], ARRIVAL)

    def bases(done: dict[str, DataFrame]) -> DataFrame:
        named = done["rows"].select(F.col("frCd").alias("id"), seq.alias("seq"), F.col("frcsNm").alias("name"), F.col("frcsAddr").alias("addr"))
        return assign_bases(named, **brand_rules)

    def places(done: dict[str, DataFrame]) -> DataFrame:
        return with_brand(place_rows(done["rows"]), brand_of(done["bases"], done["candidates"])).select(*PLACE_COLUMNS)

    first = [("pages", lambda done: open_place_pages(pages)), ("faults", lambda done: place_page_faults(done["pages"]))]
    reasons, counts = _reasons(run_steps(spark, root, run, first)["faults"], ["query_sido", "query_addr"]), {}
    if not reasons:
        done = run_steps(spark, root, run, [*first, ("rows", first_rows), ("bases", bases), ("candidates", lambda d: candidates(d["bases"])), ("places", places)])
        reasons = publish(done["places"], f"{root}/places", collected_on, "region", min_total, tolerance)
        n = done["places"].agg(F.count(F.lit(1)), F.count("brand"), F.count_if(F.col("dong").isNull())).first()
        counts = dict(zip(("places", "branded", "without_dong"), n))
    outcome = Outcome(not reasons, reasons, counts)
    record(spark, root, run, "outcome", json.dumps(outcome.__dict__, ensure_ascii=False))
    forget_steps(spark, root, run, _STEPS)
    return outcome


# ---- platforms ------------------------------------------------------------------
def reconcile_guarded(spark: SparkSession, root: str, pages: DataFrame, day: str, source_url: str, min_total: int = fixed.PLATFORM_MIN_TOTAL) -> Outcome:
    """Landed platform pages into the platform store below ``root``, whole or not at all.

    Any fault of the pages leaves the store as it is.  Otherwise the merged
    store is written as a version of its own; its counters are observed in that
    same write, and then the pointer moves, with the day as a stamp.
    """
    reasons = _reasons(platform_page_faults(pages, min_total), [])
    if reasons:
        return Outcome(False, reasons, {})
    last = get_stamp(spark, f"{root}/pointer", "current")
    store = current(spark, root)
    after = reconciled(spark.createDataFrame([], PLATFORM) if store is None else store, platform_pages(pages), F.lit(day).cast("date"), source_url)
    seen, version = Observation(), f"v-{uuid.uuid4().hex}"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counted = after.observe(
        seen, F.count_if("known").alias("before"), total("inserted").alias("inserted"), total("updated").alias("updated"),
        F.count_if(F.col("action") == "removed").alias("removed"), F.count(F.lit(1)).alias("after"),
    )
    counted.select(*PLATFORM_COLUMNS).write.parquet(f"{root}/{version}")
    point_to(spark, root, version, last, {PLATFORM_STAMP: day})
    return Outcome(True, [], {c: int(n) for c, n in seen.get.items()})
