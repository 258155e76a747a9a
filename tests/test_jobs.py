"""Whole jobs: restarts, refusals and counters."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from waymark.jobs import ledger, nightly
from waymark.sources import landed
from waymark.sources.tables import current, get_stamp

WHERE = "query_sido string, query_addr string, page_no bigint, value string"


def place_page(region, addr, page, last, rows, code="0000"):
    items = [{"frCd": i, "frcsNm": n, "frcsAddr": f"{region} {addr} 1 (역삼동)", "placeTypeNm": "음식점업"} for i, n in rows]
    return region, addr, page, json.dumps({"resCode": code, "resMsg": "", "data": {"totalCnt": len(rows), "totalPage": last, "list": items}})


def two_districts(spark):
    named = [(str(i), f"새집 {'가나다라마바사아'[i % 8]}점") for i in range(16)]
    return spark.createDataFrame([
        place_page("서울", "강남구", 1, 2, named[:6] + [("x", "혼자")]), place_page("서울", "강남구", 2, 2, named[6:9] + [("0", "나중")]),
        place_page("부산", "중구", 1, 1, named[9:]),
    ], WHERE)


def test_page_faults_name_bad_and_missing_pages(spark):
    rows = [place_page("서울", "강남구", 1, 3, [("1", "a")]), place_page("서울", "강남구", 3, 3, [], "9999"), place_page("부산", "중구", 1, 0, []), ("부산", "서구", 1, "not json")]
    got = {(r["query_addr"], r["page_no"], r["reason"]) for r in landed.place_page_faults(spark.createDataFrame(rows, WHERE)).collect()}
    assert got == {("강남구", 2, "missing"), ("강남구", 3, "resCode=9999"), ("서구", 1, "resCode=?")}


def test_nightly_places_publishes_and_refuses(spark):
    root, pages = tempfile.mkdtemp(), two_districts(spark)
    first = nightly.nightly_places(spark, root, "n1", pages, "2026-01-01", min_total=1)
    assert first.applied and first.reasons == [] and first.counts == {"places": 17, "branded": 16, "without_dong": 0}
    table = {r["id"]: r for r in current(spark, f"{root}/places").collect()}
    assert table["0"]["name"] == "새집 가점" and table["0"]["brand"] == "새집" and table["x"]["brand"] is None and table["9"]["region"] == "부산"
    # The same run answers again without work; pages that lack one, or a table that shrinks too much, change nothing.
    assert nightly.nightly_places(spark, root, "n1", None, "2026-01-01") == first
    lacking = nightly.nightly_places(spark, root, "n2", pages.filter("page_no <> 2"), "2026-01-02", min_total=1)
    assert (lacking.applied, lacking.reasons) == (False, ["서울 강남구 page 2: missing"])
    shrunk = nightly.nightly_places(spark, root, "n3", pages.filter("query_sido = '서울'"), "2026-01-03", min_total=1)
    assert not shrunk.applied and shrunk.reasons[0].startswith("부산 7→0")
    assert current(spark, f"{root}/places").count() == 17 and get_stamp(spark, f"{root}/places/pointer", "merchants_collected_on") == "2026-01-01"


def test_landed_texts_are_read_once(spark):
    root, read = tempfile.mkdtemp(), spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    pages = two_districts(spark).withColumn("value", F.udf(seen, "string")("value"))
    assert nightly.nightly_places(spark, root, "n1", pages, "2026-01-01", min_total=1).applied and read.value == 3


def test_opened_pages_give_the_rows_and_faults_of_their_texts(spark):
    rows = [place_page("서울", "강남구", 1, 3, [("1", "a"), ("2", "b")]), place_page("서울", "강남구", 3, 3, [("3", "c")], "9999"), ("부산", "서구", 1, "not json"), ("부산", "중구", 1, None)]
    pages = spark.createDataFrame(rows, WHERE)
    opened = landed.open_place_pages(pages)
    for of in (lambda p: landed.place_pages(p)[0], lambda p: landed.place_pages(p)[1], landed.place_page_faults):
        assert sorted(map(str, of(opened).collect())) == sorted(map(str, of(pages).collect())) != []


def test_a_stopped_run_goes_on_behind_its_last_step(spark, monkeypatch):
    root, pages, made = tempfile.mkdtemp(), two_districts(spark), []

    def counted(name, make):
        def run(*args, **options):
            made.append(name)
            return make(*args, **options)
        return run

    def lost(*args, **options):
        raise RuntimeError("executor lost")

    for name in ("assign_bases", "candidates", "place_pages"):
        monkeypatch.setattr(nightly, name, counted(name, getattr(nightly, name)))
    rows = nightly.place_rows
    monkeypatch.setattr(nightly, "place_rows", lost)
    with pytest.raises(RuntimeError):
        nightly.nightly_places(spark, root, "n1", pages, "2026-01-01", min_total=1)
    assert made == ["place_pages", "assign_bases", "candidates"] and current(spark, f"{root}/places") is None
    monkeypatch.setattr(nightly, "place_rows", rows)
    assert nightly.nightly_places(spark, root, "n1", pages, "2026-01-01", min_total=1).applied
    assert made == ["place_pages", "assign_bases", "candidates"] and current(spark, f"{root}/places").count() == 17


def test_steps_are_forgotten_but_not_what_was_recorded(spark):
    root = tempfile.mkdtemp()
    done = ledger.run_steps(spark, root, "r", [("a", lambda d: spark.range(3)), ("b", lambda d: d["a"].filter("id > 0"))])
    assert done["b"].count() == 2 and ledger.recorded(spark, root, "r", "c") is None
    ledger.forget_steps(spark, root, "r", ["a", "b", "c"])
    assert ledger.recorded(spark, root, "r", "a") is not None
    with pytest.raises(Exception):
        ledger.run_steps(spark, root, "r", [("a", lambda d: spark.range(3))])["a"].count()


def platform_page(page, last, rows, code="0000", total=12):
    items = [{"postNo": n, "ordNo": i, "ecommerceCategoryNm": "쇼핑", "ecommerceMgtNm": name, "ecommerceUrl": "u"} for i, (n, name) in enumerate(rows)]
    return page, json.dumps({"resCode": code, "data": {"totalCnt": total, "totalPage": last, "list": items}})


def test_a_platform_run_is_applied_whole_or_not_at_all(spark):
    root = tempfile.mkdtemp()
    pages = lambda *rows: spark.createDataFrame(list(rows), "page_no int, value string")
    whole = pages(platform_page(1, 2, [(1, "A"), (2, "B")]), platform_page(2, 2, [(3, "C"), (None, "a ")]))
    first = nightly.reconcile_guarded(spark, root, whole, "2026-01-01", "s")
    # Into an empty store every row is new, the nameless number twice under one name.
    assert first.applied and first.counts == {"before": 0, "inserted": 4, "updated": 0, "removed": 0, "after": 4}
    again = nightly.reconcile_guarded(spark, root, pages(platform_page(1, 1, [(1, "A2"), (9, "b")])), "2026-01-02", "s")
    assert again.counts == {"before": 4, "inserted": 0, "updated": 2, "removed": 2, "after": 4}
    before = sorted(map(str, current(spark, root).collect()))
    for bad, reason in (
        (pages(platform_page(1, 3, [(1, "Z")]), platform_page(3, 3, [])), "page 2: missing"),
        (pages(platform_page(1, 1, [(1, "Z")], "E500")), "page 1: resCode=E500"),
        (pages(platform_page(1, 1, [(1, "Z")], total=9)), "page 1: totalCnt=9 < 10"),
        (pages(), "page 1: missing"),
    ):
        refused = nightly.reconcile_guarded(spark, root, bad, "2026-01-03", "s")
        assert (refused.applied, refused.reasons) == (False, [reason])
    assert sorted(map(str, current(spark, root).collect())) == before
    assert get_stamp(spark, f"{root}/pointer", nightly.PLATFORM_STAMP) == "2026-01-02"


def test_many_reasons_are_counted(spark):
    faults = spark.range(1, 51).select(F.col("id").alias("page_no"), F.lit("missing").alias("reason"))
    told = nightly._reasons(faults, [])
    assert len(told) == nightly.MOST_REASONS + 1 and told[-1] == "30 more"
