"""The nightly page survey: the due pages of the catalog, read as text, against what the catalog knows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.values import is_deep_link
from waymark.operators.ordering import daily_slice
from waymark.operators.survey import analyze, delta
from waymark.session import cut_lineage
from waymark.sources.html import collected, parsed_pages
from waymark.sources.tables import write_dated_report


def survey_pages(
    catalog: DataFrame, pages: DataFrame, day: str, terms: Sequence[str] = fixed.KNOWN_BRANDS,
    cycle: int = fixed.SURVEY_CYCLE, max_hits: int | None = fixed.PROBE_MAX_HITS, rules=fixed.GOODS_CODES,
) -> DataFrame:
    """The day's report, one row per due entry: what its page shows beyond the catalog.

    ``catalog`` holds (id, survey_url, known_brands, known_cats), ``pages`` the
    landed (id, html).  All entries with an address are due once per ``cycle``
    days.  An entry whose page did not land, or landed without a body, is not
    ``ok``; ``deep_link`` marks addresses below a site's root, whose navigation
    may be the host's.  Nothing is written to the catalog.
    """
    due = daily_slice(catalog.filter("survey_url is not null"), "id", F.lit(day).cast("date"), cycle)
    landed = pages.filter("html is not null").join(due.select("id", F.col("survey_url").alias("url")), "id")
    read = collected(parsed_pages(landed, "id"))
    seen = analyze(read, terms, max_hits).select("id", "confirmed", "directory", "cats", "text_len")
    found = delta(seen, due.select("id", "known_brands", "known_cats"), "id", rules)
    return due.select("id", F.col("survey_url").alias("url"), is_deep_link(F.col("survey_url")).alias("deep_link")).join(
        found.withColumn("ok", F.lit(True)), "id", "left"
    ).withColumn("ok", F.coalesce("ok", F.lit(False)))


def nightly_survey(catalog: DataFrame, pages: DataFrame, path: str, day: str, **rules) -> DataFrame:
    """The report of ``survey_pages``, written once below ``path``; a day that runs again replaces its own report."""
    report = cut_lineage(survey_pages(catalog, pages, day, **rules))
    write_dated_report(report, path, day)
    return report
