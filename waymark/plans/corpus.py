"""Queries over documents, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.operators import catalog as cat
from waymark.operators import corpus, reports, vectors
from waymark.operators.conversation import last_pair, last_turns
from waymark.plans import bindings
from waymark.plans.platforms import CATALOG_TEXTS, _catalog, _codes, _shops
from waymark.plans.registry import query, table
from waymark.session import work_folder
from waymark.sources import landed, tables

# ---- markdown documents --------------------------------------------------------------
# The documents' lines, whole, some below a heading of their own, some followed by
# a blank line; every second document starts with front matter.
_BODY = """array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN i % 11 = 3 THEN '# Part ' || i || chr(10) || l
 WHEN i % 11 = 6 THEN '### Item ' || i || chr(10) || l WHEN i % 11 = 8 THEN '## Section ' || i || chr(10) || l WHEN i % 4 = 0 THEN l || chr(10) ELSE l END), chr(10))"""
_HEAD = "CASE WHEN doc_id % 2 = 0 THEN '---' || chr(10) || 'source: ' || source || chr(10) || 'url: \"https://d.example/' || doc_id || '\"' || chr(10) || '---' || chr(10) ELSE '' END"


def markdown(spark, d) -> DataFrame:
    def line(l, j):
        i = j + 1
        under = lambda heading: F.concat(F.lit(heading), i.cast("string"), F.lit("\n"), l)
        return (
            F.when(i % 11 == 3, under("# Part ")).when(i % 11 == 6, under("### Item "))
            .when(i % 11 == 8, under("## Section ")).when(i % 4 == 0, F.concat(l, F.lit("\n"))).otherwise(l)
        )

    body = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    head = F.format_string('---\nsource: %s\nurl: "https://d.example/%d"\n---\n', "source", "doc_id")
    return table(spark, d, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, head).otherwise(""), body).alias("text"))


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_SECTIONS = rf"""
md AS (SELECT doc_id, source, {_BODY} AS body FROM documents),
blocks AS (SELECT doc_id, source, string_split(regexp_replace(body, '(?m)^(#{{1,3}}[ \t])', chr(1) || '\1', 'g'), chr(1)) AS bs FROM md),
marked AS (SELECT doc_id, source, bs, list_transform(bs, lambda b: {{'path': []::VARCHAR[], 'every': []::VARCHAR[],
   'lv': length(regexp_extract(b, '^(#{{1,3}})[ \t]', 1)), 'title': {_strip(r"regexp_extract(b, '^#{1,3}\s+([^\n]*)', 1)")}}}) AS ms FROM blocks),
paths AS (SELECT doc_id, source, bs, list_reduce(ms, lambda a, m: CASE WHEN m.lv = 0 THEN {{'path': a.path, 'every': list_append(a.every, array_to_string(a.path, ' > ')), 'lv': 0, 'title': ''}}
   ELSE {{'path': list_append(a.path[1:m.lv - 1], m.title), 'every': list_append(a.every, array_to_string(list_append(a.path[1:m.lv - 1], m.title), ' > ')), 'lv': 0, 'title': ''}} END,
   {{'path': []::VARCHAR[], 'every': []::VARCHAR[], 'lv': 0, 'title': ''}}).every AS ps, ms FROM marked),
sections AS (SELECT doc_id, source, sec_no, section, {_strip("CASE WHEN lv > 0 THEN CASE WHEN contains(b, chr(10)) THEN substr(b, strpos(b, chr(10)) + 1) ELSE '' END ELSE b END")} AS body
  FROM (SELECT doc_id, source, unnest(range(0, len(bs))) AS sec_no, unnest(bs) AS b, unnest(ps) AS section, unnest(list_transform(ms, lambda m: m.lv)) AS lv FROM paths))
"""

_GROWN_1 = f"CASE WHEN a.open IS NULL OR a.open = '' THEN x.u ELSE {_strip("a.open || ' ' || x.u")} END"
_UNITS = r"string_split(regexp_replace(regexp_replace(p, '([.다요음])\s+', '\1' || chr(1), 'g'), '\n', chr(1), 'g'), chr(1))"
_FIXED = "regexp_extract_all(x.u, '(?s).{1,900}')"
_PIECES = bindings.pack_sql(_UNITS, _GROWN_1, f"length({_GROWN_1}) <= 900", f"{_FIXED}[1:len({_FIXED}) - 1]", f"coalesce({_FIXED}[len({_FIXED})], '')")
_GROWN_2 = f"CASE WHEN a.open IS NULL THEN x.u ELSE {_strip("a.open || chr(10) || chr(10) || x.u")} END"
_GROWN_3 = "CASE WHEN a.open IS NULL THEN x.u ELSE a.open || chr(10) || chr(10) || x.u END"
_CHUNKS = rf"""{_SECTIONS},
paras AS (SELECT doc_id, source, sec_no, section, list_filter(list_transform(regexp_split_to_array(body, '\n\s*\n'), lambda q: {_strip("q")}), lambda q: q <> '') AS ps FROM sections WHERE body <> ''),
pieces AS (SELECT doc_id, source, sec_no, section, flatten(list_transform(ps, lambda p: CASE WHEN length(p) <= 900 THEN [p] ELSE {_PIECES} END)) AS qs FROM paras),
packed AS (SELECT doc_id, source, sec_no, section, {bindings.pack_sql("qs", _GROWN_2, f"length({_GROWN_2}) <= 900")} AS cs FROM pieces),
merged AS (SELECT doc_id, source, sec_no, section, {bindings.pack_sql("cs", _GROWN_3, "a.open IS NULL OR (length(x.u) < 200 AND length(a.open) + length(x.u) < 1100)")} AS ms FROM packed),
chunks AS (SELECT doc_id, source, sec_no, section, unnest(range(0, len(ms))) AS chunk_no, unnest(ms) AS content FROM merged)
"""


@query("X28", f"""WITH {_SECTIONS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS source, CASE WHEN doc_id % 2 = 0 THEN 'https://d.example/' || doc_id END AS url,
length(body) AS chars FROM md""")
def front_matter(spark, d) -> DataFrame:
    meta, body = corpus.front_matter(F.col("text"))
    return markdown(spark, d).select("doc_id", meta.alias("m"), F.length(body).alias("chars")).select(
        "doc_id", F.col("m")["source"].alias("source"), F.col("m")["url"].alias("url"), "chars"
    )


@query("X29", f"WITH {_SECTIONS} SELECT doc_id, sec_no, section, body FROM sections WHERE body <> ''")
def corpus_sections(spark, d) -> DataFrame:
    docs = markdown(spark, d)
    _, body = corpus.front_matter(F.col("text"))
    return corpus.sections(docs.withColumn("text", body)).select("doc_id", "sec_no", "section", "body")


@query("X30 X31 X29", f"WITH {_CHUNKS} SELECT doc_id, sec_no, section, chunk_no, content FROM chunks")
def corpus_chunks(spark, d) -> DataFrame:
    return corpus.markdown_chunks(markdown(spark, d)).select("doc_id", "sec_no", "section", "chunk_no", "content")


@query("A21", f"""WITH {_CHUNKS}, s AS (SELECT length(content) AS len, row_number() OVER (ORDER BY length(content)) - 1 AS i FROM chunks)
SELECT count(*) AS chunks, min(len) AS min_len, max(len) FILTER (i = (SELECT count(*) // 2 FROM s)) AS median_len, max(len) AS max_len FROM s""")
def corpus_stats(spark, d) -> DataFrame:
    return reports.length_stats(corpus.markdown_chunks(markdown(spark, d)), F.length("content"))


@query("W2", """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS rn FROM documents WHERE text <> '') WHERE rn = 1""")
def corpus_dedupe(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").withColumnRenamed("text", "content")
    return corpus.dedupe_chunks(docs, ["doc_id"]).select("doc_id")


# ---- records as text --------------------------------------------------------------------------
def _faq_texts(spark, d) -> DataFrame:
    """Conversations as FAQ files: a user turn and what follows it, ten conversations a file."""
    turns = table(spark, d, "conversations")
    pairs = turns.groupBy("conv_id").agg(
        F.min(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("q"),
        F.min(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).alias("a"),
    ).filter("q IS NOT NULL AND a IS NOT NULL")
    item = F.struct("conv_id", F.struct(
        F.when(F.col("conv_id") % 4 == 0, "축제·공연정보").otherwise("사용").alias("cat"), F.col("q.text").alias("q"),
        F.concat(F.lit(" "), F.col("a.text"), F.lit(" \n")).alias("a"),
    ).alias("i"))
    items = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["i"])
    return pairs.groupBy(F.floor(F.col("conv_id") / 10).alias("file")).agg(items.alias("items")).select("file", F.to_json(F.struct("items")).alias("value"))


_FAQ = r"""faq AS (SELECT '공식 FAQ(사용) > ' || q AS section, 'Q. ' || q || chr(10) || 'A. ' || regexp_replace(a, '^\s+|\s+$', '', 'g') AS content FROM (
SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS q, arg_min(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1)
WHERE q IS NOT NULL AND a IS NOT NULL AND conv_id % 4 <> 0)"""


@query("S7 X32", f"WITH {_FAQ} SELECT section, content FROM faq")
def faq_chunks(spark, d) -> DataFrame:
    return corpus.question_chunks(landed.read_faq(_faq_texts(spark, d)), "faq").select("section", "content")


@query("X32", r"""SELECT doc_id, '- ' || source || ' (예: ' || coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, '') || ') → 가능.' || CASE WHEN doc_id % 3 = 0 THEN ' 확인 포인트: ' || lang ELSE '' END AS verdict,
'- ' || source || ': ' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ' (참고: ' || lang || ')' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' [지역 한정]' ELSE '' END AS platform FROM documents""")
def record_lines(spark, d) -> DataFrame:
    k = F.col("doc_id")
    even, third = F.when(k % 2 == 0, F.col("lang")), F.when(k % 3 == 0, F.col("lang"))
    return table(spark, d, "documents").select(
        "doc_id", corpus.verdict_line(F.col("source"), even, F.lit("가능"), third).alias("verdict"),
        corpus.platform_line(F.col("source"), even, third, k % 5 == 0).alias("platform"),
    )


_DAY = "2026-08-11"
_PART_LINE = """'- ' || p_name || ' (예: ' || p_brand || ') → ' || CASE WHEN p_size % 2 = 0 THEN '가능' ELSE '불가' END || '.' || CASE WHEN p_partkey % 3 = 0 THEN ' 확인 포인트: ' || p_type ELSE '' END"""
_PLATFORM_LINE = """'- ' || name || ': ' || coalesce(summary, '') || CASE WHEN note <> '' THEN ' (참고: ' || note || ')' ELSE '' END || CASE WHEN region_limited THEN ' [지역 한정]' ELSE '' END"""
_HEAD_SQL = "replace(replace(replace(replace('" + fixed.PLATFORM_HEAD.replace("'", "''").replace("{}", "{0}", 1).replace("{}", "{1}", 1).replace("{}", "{2}", 1).replace("{}", _DAY) + """', '{0}', CAST(count(*) AS VARCHAR)),
 '{1}', CAST(count(*) FILTER (kind <> 'delivery') AS VARCHAR)), '{2}', CAST(count(*) FILTER (kind = 'delivery') AS VARCHAR)), chr(0), '')"""
_LISTS = f"""{bindings.PLATFORMS}, lists AS (
SELECT 'offline_categories' AS source, '{fixed.VERDICT_SECTION}' AS section, '{fixed.VERDICT_HEAD}' || chr(10) || string_agg({_PART_LINE}, chr(10) ORDER BY p_partkey) AS body FROM part
UNION ALL SELECT 'online_platforms', '온라인 공식 플랫폼 > 쇼핑', {_HEAD_SQL} || chr(10) || '[쇼핑]' || chr(10) || string_agg({_PLATFORM_LINE}, chr(10) ORDER BY id) FILTER (kind <> 'delivery') FROM platforms WHERE status = 'active'
UNION ALL SELECT 'online_platforms', '온라인 공식 플랫폼 > 배달', '[배달 앱]' || chr(10) || string_agg({_PLATFORM_LINE}, chr(10) ORDER BY id) FROM platforms WHERE status = 'active' AND kind = 'delivery')"""
_ALL_CHUNKS = f"{_LISTS}, " + _CHUNKS.replace("FROM sections WHERE body <> ''", f"FROM (SELECT * FROM sections UNION ALL SELECT NULL, source, 0, section, {_strip('body')} FROM lists) WHERE body <> ''")


@query("X32 X31", f"""WITH {bindings.PLATFORMS}, g AS (SELECT kind, status, '목록 ' || count(*) || chr(10) || string_agg({_PLATFORM_LINE}, chr(10) ORDER BY id) AS p FROM platforms GROUP BY 1, 2),
pp AS (SELECT kind, status, CASE WHEN length(p) <= 900 THEN [p] ELSE {_PIECES} END AS ps FROM (SELECT kind, status, {_strip("p")} AS p FROM g)),
merged AS (SELECT kind, status, {bindings.pack_sql("ps", _GROWN_3, "a.open IS NULL OR (length(x.u) < 200 AND length(a.open) + length(x.u) < 1100)")} AS ms FROM pp)
SELECT kind, status, '목록' AS section, CAST(unnest(range(0, len(ms))) AS INTEGER) AS chunk_no, unnest(ms) AS content FROM merged""")
def table_chunks(spark, d) -> DataFrame:
    """The platforms of every kind and status as one published list each."""
    line = corpus.platform_line(F.col("name"), F.col("summary"), F.col("note"), F.col("region_limited"))
    head = F.concat(F.lit("목록 "), F.count(F.lit(1)).cast("string"))
    return corpus.table_chunks(bindings.platforms(spark, d), ["kind", "status"], "id", line, head, "목록")


def _six_loaders(spark, d) -> DataFrame:
    md = markdown(spark, d)
    faq = corpus.question_chunks(landed.read_faq(_faq_texts(spark, d)).drop("pos"), "faq").select("source", "section", "content")
    policy = corpus.plain_chunks(md.filter("doc_id % 14 = 7"), "internal_policy_analysis")
    part = table(spark, d, "part")
    verdicts = part.select(
        "p_partkey", F.col("p_name").alias("type"), F.col("p_brand").alias("examples"),
        F.when(F.col("p_size") % 2 == 0, "가능").otherwise("불가").alias("label"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("check"),
    )
    entries = cat.with_labels(cat.with_platform_name(_catalog(spark, d), _shops(spark, d).filter("name IS NOT NULL")), _codes(spark, d))
    entries = entries.withColumn("survey_url", F.lit(None).cast("string")).withColumn("surveyed_on", F.lit(None).cast("string"))
    return corpus.union_chunks(
        corpus.markdown_chunks(md), faq, policy, corpus.verdict_chunks(verdicts, "p_partkey", _DAY),
        corpus.platform_chunks(bindings.platforms(spark, d), "id", _DAY), corpus.catalog_chunks(entries, _DAY),
    )


@query("U1 W2 A10 X32", f"""WITH {_ALL_CHUNKS}, {_FAQ}, every AS (
SELECT CASE WHEN doc_id IS NULL THEN source WHEN doc_id % 2 = 0 THEN source ELSE 'unknown' END AS source, content FROM chunks UNION ALL SELECT 'faq', content FROM faq
UNION ALL SELECT 'internal_policy_analysis', content FROM chunks WHERE doc_id % 14 = 7 UNION ALL SELECT 'online_catalog', content FROM ({CATALOG_TEXTS}))
SELECT source, count(*) AS count, CAST(sum(length(content)) AS BIGINT) AS chars FROM (SELECT DISTINCT source, content FROM every WHERE content <> '') GROUP BY 1""")
def corpus_union(spark, d) -> DataFrame:
    """All six loaders' chunks, without repeats, counted by source."""
    kept = corpus.dedupe_chunks(_six_loaders(spark, d), ["loader", "doc_id", "sec_no", "chunk_no", "section"])
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("count"), F.sum(F.length("content")).alias("chars"))


@query("S6", """SELECT doc_id // 100 AS g, CAST(sum(length(text)) + count(*) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def document_files(spark, d) -> DataFrame:
    """Documents written as text files of a hundred each and read back whole."""
    path = work_folder(spark, "files")
    docs = table(spark, d, "documents")
    texts = docs.groupBy(F.floor(F.col("doc_id") / 100).alias("g")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("value")
    )
    texts.repartition("g").write.partitionBy("g").text(path)
    files = landed.read_texts(spark, path, "*.txt")
    return files.groupBy("g").agg(F.sum(F.length("value")).alias("chars")).select(F.col("g").cast("bigint").alias("g"), "chars")


# ---- vectors -------------------------------------------------------------------------------------
# One query per label: the mean of the label's vectors.
_MEANS = """dims AS (SELECT label, unnest(range(1, 65)) AS dim, unnest(embedding) AS x FROM embeddings),
means AS (SELECT label AS query_id, list(m ORDER BY dim) AS q FROM (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS m FROM dims GROUP BY 1, 2) GROUP BY 1)"""


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings")


def _means(spark, d) -> DataFrame:
    per_dim = _vectors(spark, d).select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # The number of dimensions bounds each label's list.
    row = F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda e: e["m"])
    return per_dim.groupBy("label").agg(row.alias("embedding")).select(F.col("label").cast("bigint").alias("query_id"), "embedding")


def _topk_sql(where: str) -> str:
    return f"""WITH {_MEANS}, s AS (SELECT query_id, vec_id, list_cosine_distance(CAST(embedding AS DOUBLE[]), q) AS dist FROM embeddings, means WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, round(dist, 6) AS distance FROM r WHERE rank <= 6"""


@query("J11 T6 X33", _topk_sql("true"))
def vector_topk(spark, d) -> DataFrame:
    hits = vectors.top_k(_vectors(spark, d), _means(spark, d))
    return hits.withColumn("distance", F.round("distance", 6))


@query("J11 T6", _topk_sql("label IN (1, 2)"))
def vector_topk_by_label(spark, d) -> DataFrame:
    hits = vectors.top_k(vectors.in_sources(_vectors(spark, d), [1, 2], "label"), _means(spark, d))
    return hits.withColumn("distance", F.round("distance", 6))


@query("J11", _topk_sql("true"))
def vector_topk_many_queries(spark, d) -> DataFrame:
    """The path for more queries than one plan may carry, forced by a small bound."""
    hits = vectors.top_k(_vectors(spark, d), _means(spark, d), max_inline=3, tile_bytes=65_536)
    return hits.withColumn("distance", F.round("distance", 6))


@query("X33", f"""WITH {_MEANS} SELECT vec_id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), q), 6) AS distance FROM embeddings JOIN means ON label = query_id""")
def cosine_to_own_label(spark, d) -> DataFrame:
    own = _vectors(spark, d).join(_means(spark, d).withColumnRenamed("embedding", "q"), F.col("label") == F.col("query_id"))
    return own.select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), F.col("q")), 6).alias("distance"))


@query("S18 W2", """SELECT source, count(*) AS count, min(doc_id) AS first_doc, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT embedding) AS vectors
FROM documents JOIN embeddings ON doc_id % (SELECT count(*) FROM embeddings) = vec_id GROUP BY 1""")
def chunk_store(spark, d) -> DataFrame:
    """Chunks and their vectors matched on the chunk key, written whole, read back; vectors are dealt to the documents in turn."""
    path = work_folder(spark, "chunks")
    key = tables.chunk_key(["doc_id"])
    chunks = table(spark, d, "documents").select(
        key.alias("chunk_key"), "source", F.lit("s").alias("section"), F.col("text").alias("content"), F.col("doc_id").cast("string").alias("url"), F.lit(None).cast("string").alias("collected_on"),
    )
    n = _vectors(spark, d).count()
    turn = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % n).alias("vec_id"))
    vecs = turn.join(_vectors(spark, d), "vec_id").select(key.alias("chunk_key"), "embedding")
    tables.replace_chunks(chunks, vecs, path)
    return tables.current(spark, path).groupBy("source").agg(
        F.count(F.lit(1)).alias("count"), F.min(F.col("url").cast("bigint")).alias("first_doc"),
        F.sum(F.length("content")).alias("chars"), F.count_distinct("embedding").alias("vectors"),
    )


# ---- conversations -----------------------------------------------------------------------------------
@query("W7", """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, coalesce(text, '') AS text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 10""")
def conv_last_turns(spark, d) -> DataFrame:
    return last_turns(table(spark, d, "conversations"))


@query("W7", """SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 2""")
def conv_last_two(spark, d) -> DataFrame:
    return last_turns(table(spark, d, "conversations"), n=2).select("conv_id", "turn")


@query("W8", """SELECT conv_id, arg_max(text, turn) FILTER (role <> 'assistant') AS last_user, arg_max(text, turn) FILTER (role = 'assistant') AS last_assistant
FROM conversations GROUP BY 1""")
def conv_last_pair(spark, d) -> DataFrame:
    return last_pair(table(spark, d, "conversations"))
