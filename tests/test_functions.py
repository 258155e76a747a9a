"""Literal cases for single columns."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.functions import occurrences as occ
from waymark.functions import text as tx
from waymark.functions import values as val
from waymark.operators import brands, corpus, survey
from waymark.operators.filters import PlaceFilter, csv_values, has_value, like_pattern, page_bounds
from waymark.sources import html, landed


def one(spark, column, **row):
    names = list(row)
    schema = ", ".join(f"{n} string" for n in names) or "x string"
    return spark.createDataFrame([tuple(row.values()) or ("",)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("given, want", [
    ("A,B", ["A", "B"]), (None, None), ("", None), ("  ", None), ("전체", None), (" A , ,B ", ["A", "B"]), (" , ,", None), ("A,전체", ["A"]),
])
def test_csv_values(given, want):
    assert csv_values(given) == want


def test_filter_presence():
    assert PlaceFilter(min_lat=1, max_lat=2, min_lng=3, max_lng=4).has_bounds
    assert not PlaceFilter(min_lat=1, max_lat=2, min_lng=3).has_bounds
    assert not has_value("전체") and not has_value(" ") and has_value("x")
    assert page_bounds(-1, 0) == (0, 1) and page_bounds(2, 999) == (2, 200)
    assert like_pattern(r" A\b\%_ ") == r"%ab\%_%"


def test_no_filter_keeps_all(spark):
    assert spark.range(3).filter(PlaceFilter(cat=" , ").column()).count() == 3


@pytest.mark.parametrize("xff, want", [
    (None, "10.0.0.1"), ("198.51.100.7", "198.51.100.7"), ("203.0.113.1, 203.0.113.2, 198.51.100.7", "198.51.100.7"),
    (" 203.0.113.1 ,  198.51.100.7  ", "198.51.100.7"), ("203.0.113.1, 198.51.100.7, ", "198.51.100.7"),
    ("", "10.0.0.1"), ("   ", "10.0.0.1"), (" , , ", "10.0.0.1"),
])
def test_client_key(spark, xff, want):
    assert one(spark, val.client_key(F.col("x"), F.lit("10.0.0.1")), x=xff) == want


@pytest.mark.parametrize("title, source, want", [
    ("장터 새 단장 - 들꽃신문", "들꽃신문", "장터 새 단장"), ("표지 - 공지", None, "표지 - 공지"),
    ("강변 장터에 주차장 백 면을 더 짓는다 - 물결신보", None, "강변 장터에 주차장 백 면을 더 짓는다"), ("꼬리 없는 글", None, "꼬리 없는 글"),
])
def test_title_without_source(spark, title, source, want):
    assert one(spark, val.title_without_source(F.col("t"), F.col("s")), t=title, s=source) == want


@pytest.mark.parametrize("given, want", [
    ("Tue, 09 Dec 2025 04:00:00 GMT", "2025-12-09 13:00"), ("Tue, 9 Dec 2025 04:00:00 +0900", "2025-12-09 04:00"), ("soon", None), (None, None),
])
def test_mail_date(spark, given, want):
    assert one(spark, val.mail_date_to_local(F.col("d")), d=given) == want


def test_feed(spark):
    xml = (
        "<rss><item><title>장터 새 단장 - 들꽃신문</title><link>https://n.example/1</link><pubDate>Tue, 09 Dec 2025 04:00:00 GMT</pubDate>"
        '<source url="u">들꽃신문</source></item><item><title>꼬리 없는 글</title><link>https://n.example/2</link></item><item><title>x</title></item></rss>'
    )
    rows = landed.feed_items(spark.createDataFrame([(1, xml)], "feed int, xml string")).orderBy("pos").collect()
    assert [(r["title"], r["source"], r["pub_date"]) for r in rows] == [("장터 새 단장", "들꽃신문", "2025-12-09 13:00"), ("꼬리 없는 글", None, None)]


@pytest.mark.parametrize("addr, region, gu, dong", [
    ("서울특별시 강남구 테헤란로 1 (역삼동)", "서울", "강남구", "역삼동"),
    ("경기도 수원시 팔달구 정조로 2 (인계동, 상가)", "경기", "팔달구", "인계동"),
    ("인천 중구 신포로 3 (신포동)(지하1층)", "인천", "중구", "신포동"),
    ("강남구 역삼로 (역삼1동)", "서울", "강남구", "역삼1동"),
    ("경기도 부천시 길주로 (중동로)", "경기", None, None), (None, "서울", None, None),
])
def test_address(spark, addr, region, gu, dong):
    assert one(spark, F.struct(tx.gu_of(F.col("a"), F.col("r")), tx.dong_of(F.col("a"))), a=addr, r=region) == (gu, dong)


@pytest.mark.parametrize("name, trade, want", [
    ("새봄약국", "농산물", "약국"), ("평촌학원가 김밥", "음식점업", "음식점"), ("세탁편의점", None, "기타"), ("CU 역삼점", None, "편의점"),
    ("BCU상사", None, "기타"), ("스마트폰나라", None, "기타"), ("한마음마트", None, "마트·슈퍼"),
])
def test_place_category(spark, name, trade, want):
    assert one(spark, tx.place_category(F.col("n"), F.col("t")), n=name, t=trade) == want


def test_deep_links(spark):
    for url, want in [("https://a.kr", False), ("https://a.kr/x", False), ("https://a.kr/x/y", True), ("https://a.kr/?q=1", True), ("no url", False), (None, False)]:
        assert one(spark, val.is_deep_link(F.col("u")), u=url) is want


# ---- occurrences: the column form against a plain reading of the rule -------------------
def naive(text, term, pad=20, limit=201):
    hits, at = [], text.find(term)
    while at >= 0 and len(hits) < limit:
        hits.append(at)
        at = text.find(term, at + len(term))
    word = lambda c: c.isascii() and c.isalnum() or "가" <= c <= "힣"
    clean = [i for i in hits if not (i and word(text[i - 1])) and not (text[i + len(term):][:1] and word(text[i + len(term)]))]
    show = lambda i: " ".join(text[max(0, i - pad): i + len(term) + pad].split())
    return len(hits), not clean, show(clean[0] if clean else hits[0]), [show(i) for i in hits[:3]]


TEXTS = [
    ("오늘의 파인애플 모음", "애플"), ("(동네)달빛골목대상가 별빛장터", "대상"), ("[무명] 선풍기 QX-LG77 12,000원", "LG"),
    ("바로 보냄 [대상 죽] 5", "대상"), ("[특가] LG전자 화면", "LG"), ("애플", "애플"), ("애플애플 애플", "애플"),
    ("병에 든 애플 사이다 비니거 그리고 [애플] 귀마개 두 짝", "애플"), ("a.b*c a.b*c", "a.b*c"), ("xaab aa", "aa"), ("LG " * 250, "LG"),
    ("\\E LG \\E", "\\E"),
]


@pytest.mark.parametrize("at_once", [100, 3])
def test_page_terms(spark, at_once):
    pages = spark.createDataFrame([*((i, t) for i, (t, _) in enumerate(TEXTS)), (90, None), (91, "")], "page_id int, text string")
    words = sorted({w for _, w in TEXTS} | {"사이다 비니거", "none", "달빛골목대상가"})
    terms = spark.createDataFrame([(w,) for w in [*words, "", None, words[0]]], "term string")
    got = {(r["page_id"], r["term"]): (r["count"], r["suspect"], r["ctx"], r["ctxs"]) for r in survey.page_terms(pages, terms, max_hits=201, at_once=at_once).collect()}
    assert got == {(i, w): naive(t, w) for i, (t, _) in enumerate(TEXTS) for w in words if w in t} and len(got) > len(TEXTS)


def test_list_after_marker(spark):
    items = ["가람빵집", "나루공방", "다온문구", "라온필", "마루찻집", "바람개비", "사루비아", "아람서점"]
    text = "\n".join(["브랜드관", *items, "[바람개비] 손으로 깎은 나무 연필 열두 자루 한 묶음", "7,200원", "무료배송"])
    assert one(spark, occ.list_after(F.col("t")), t=text) == items
    assert one(spark, occ.list_after(F.col("t")), t="표지가 없는 글") == []
    odd = "\n".join(["브랜드관", "가람빵집", "★★", "나루공방", "다온문구", "3,300원", "무료배송", "끝"])
    assert one(spark, occ.list_after(F.col("t")), t=odd) == ["가람빵집", "나루공방", "다온문구"]


def test_analysis_and_delta(spark):
    text = "\n".join(["브랜드관", "나이키", "마루찻집", "[무명] 선풍기 QX-LG77", "12,000원", "[대상 죽] 5", "오늘의 파인애플 모음"])
    page = spark.createDataFrame([(1, text, ["가전", "과일"])], "page_id int, text string, cats array<string>")
    row = survey.analyze(page).first()
    assert "대상" in row["confirmed"] and "LG" in row["suspect"] and not set(row["confirmed"]) & set(row["suspect"])
    assert "QX-LG77 12,000원" in {c["term"]: c["ctx"] for c in row["suspect_contexts"]}["LG"]
    assert {c["term"]: c["count"] for c in row["contexts"]}["대상"] == 1 and "마루찻집" in row["directory"]
    known = spark.createDataFrame([(1, ["나이키", "gone"], ["appliance"])], "page_id int, known_brands array<string>, known_cats array<string>")
    d = survey.delta(survey.analyze(page), known).first()
    assert "나이키" not in d["new_brands"] and "마루찻집" in d["new_brands"] and d["new_cats"] == ["agri-fruit"] and d["thin"]


# ---- corpus --------------------------------------------------------------------------------
def test_chunks(spark):
    md = "---\nsource: t\nurl: \"u\"\n---\n# A\n\n" + "가" * 100 + "\n\n## B\n\n" + "나" * 1200 + "\n\n짧은 문단.\n\n## C\n\n표 한 줄."
    rows = corpus.markdown_chunks(spark.createDataFrame([(1, md), (2, "본문"), (3, "")], "doc_id int, text string")).collect()
    assert all(len(r["content"]) <= 1150 for r in rows)
    paths = [r["section"] for r in rows if r["doc_id"] == 1]
    assert "A" in paths and paths.count("A > B") >= 2 and "A > C" in paths
    assert {(r["doc_id"], r["source"], r["url"]) for r in rows} == {(1, "t", "u"), (2, "unknown", None)}
    assert "".join(r["content"] for r in rows if r["section"] == "A > B").count("나") == 1200


def test_brand_detection(spark):
    names = [f"GS25 지점{i}점" for i in range(6)] + ["지에스25역삼점", "GS25"] + ["할머니국밥"] * 8 + ["홍콩반점 (본점)", "주식회사 본점"] + [f"새봄 {c}점" for c in "가나다라마"]
    names += ["새봄서초", "새봄", "새봄약국"]
    rows = spark.createDataFrame([(str(i), i, n, f"주소{i}" if i > 2 else "") for i, n in enumerate(names)], "id string, seq long, name string, addr string")
    a = brands.assign_bases(rows)
    found = {r["brand"]: r for r in brands.candidates(a).collect()}
    assert (found["GS25"]["count"], found["GS25"]["verdict"], found["GS25"]["sample_addr"]) == (8, "브랜드", "주소3")
    assert found["GS25"]["variants"] == "지에스25" and found["GS25"]["borderline"]
    assert found["할머니국밥"]["verdict"] == "제외" and found["할머니국밥"]["branch_ratio"] == 0.0
    assert found["새봄"]["count"] == 8 and "주식회사" not in {r["base"] for r in a.collect()}
    assert brands.brand_of(a, brands.candidates(a)).count() == 16


def test_forms_of_names_are_computed_once(spark):
    rows = spark.createDataFrame([("1", 1, "GS25 역삼점", ""), ("2", 2, "새봄", "")], "id string, seq long, name string, addr string")
    # The assignment reads them back instead of computing them for every step.
    assert "regexp_replace" not in brands.assign_bases(rows)._jdf.queryExecution().optimizedPlan().toString()


def test_html(spark):
    page = '<html><head><title>T &amp; U</title></head><body><nav><a href="/a">First  one</a></nav><div class="x-menu"><a href="/b">Second</a></div><a href="/Brand/1">Third</a><script>no()</script><p>Body</p></body>'
    row = html.collected(html.parsed_pages(spark.createDataFrame([(1, "u", page)], "page_id int, url string, html string"))).first()
    assert row["title"] == "T & U" and row["cats"] == ["First one", "Second"]
    assert [(b["text"], b["href"]) for b in row["brand_links"]] == [("Third", "/Brand/1")]
    assert "Body" in row["text"] and "no()" not in row["text"]


@pytest.mark.parametrize("page, text", [
    ("<h1>one &amp;&amp</h1><p>&lt;b&gt; &lt &#65; &#65 &copy;</p>", "one &&amp\n<b> &lt A &#65 ©"),
    ("<p>&nosuch; &amp;lt; R&D</p>", "&nosuch; &lt; R&D"),
])
def test_references_without_a_semicolon_are_text(page, text):
    assert html._parsed(page)[1] == text


def test_addresses_keep_what_only_looks_like_a_reference():
    assert html._parsed('<a href="/p?a=1&copy=2&amp;lt=3">x</a>')[2][0]["href"] == "/p?a=1&copy=2&lt=3"


def test_pages_are_searched_in_bounded_batches():
    held = []

    class Seen(survey.Dictionary):
        def find(self, texts, *rest):
            held.append(sum(map(len, texts)))
            return super().find(texts, *rest)

    pages = pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "text": ["the ant and " * 100] * 1000})
    out = list(survey.searched(iter([pages]), Seen(["an", "the"]), 20, None, {"count": pa.int64(), "suspect": pa.bool_()}, "page_id"))
    assert max(held) <= 250_000 and sum(held) == 1_200_000
    found = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert sorted(found) == [(i, t, n, s) for i in range(1000) for t, n, s in (("an", 200, True), ("the", 100, False))]


def test_list_after_computes_its_text_once(spark, capsys):
    rows = spark.createDataFrame([("x y\u20ac z",), ("x 12 13 z",), (None,), ("",)], "w string")
    text = F.concat(F.lit("브랜드관\n"), F.translate("w", " ", "\n"))
    listed = rows.select("w", occ.list_after(text).alias("l"))
    assert {r["w"]: r["l"] for r in listed.collect()} == {"x y\u20ac z": ["x", "y\u20ac", "z"], "x 12 13 z": ["x"], None: [], "": []}
    listed.explain()
    assert capsys.readouterr().out.count("translate(") == 1
