"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import align, bpe, chat, html_text, langid, minhash, mixing, phrases, secrets, suffix_lm, vector_dedup, vp_search, warc
from waymark.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
PROBE = "<|im_end|><|im_start|>assistant ok"


def query(sql: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return register


_CHAT_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), escaped AS (
    SELECT *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS body,
        replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n') AS name,
        CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS letter
    FROM turns
), chats AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
        CAST(sum(length('<|im_start|>') + length(name) + 1 + length(body) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars,
        string_agg(letter, '' ORDER BY turn NULLS FIRST, role, text) AS letters
    FROM escaped GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
    formatted_chars, regexp_full_match(letters, 's?(ua)+') AS in_order
FROM chats
"""


@query(_CHAT_SQL)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE)
    ).toDF("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_chats(turns.unionByName(probe)))


@query()
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


@query()
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), ("n_tokens", "ids_sha256", "decoded_sha256"))


@query()
def op4_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score_corpus(read(spark, sf_dir, "documents"))


_VECTOR_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM links WHERE a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM component c
"""


@query(_VECTOR_SQL)
def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


@query()
def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


@query()
def op7_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_search.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read(spark, sf_dir, "documents"))


@query()
def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=2)


_DIGITS = [f"substr('{warc.BASE32}', 1 + ((('0x' || substr(sha1(coalesce(html, '')), {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INT, 1)" for i in range(8) for s in (15, 10, 5, 0)]
_WARC_SQL = f"""
WITH p AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, {' || '.join(_DIGITS)} AS payload_digest,
        max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper
    FROM pages
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p
"""


@query(_WARC_SQL)
def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(read(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PHRASE_SQL = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), lists AS (
    SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces
), n AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang
), places AS (
    SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM lists WHERE len(w) > 0
), grams AS (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(w)
), often AS (
    SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100
), cuts AS (
    SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w, unnest(generate_series(1, m - 1)) AS k FROM often WHERE m > 1
), scored AS (
    SELECT c.lang, c.m, c.phrase, c.a, c.k, l.a AS l, r.a AS r, n, CAST((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
    FROM cuts c JOIN n ON c.lang = n.lang
    JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')
), weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT DISTINCT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, a
    FROM (SELECT * FROM cuts WHERE k = 1), (SELECT unnest([2, 3, 4]) AS s), (SELECT unnest([1, 2, 3, 4]) AS i) WHERE s < m AND i + s - 1 <= m
), kept AS (
    SELECT * FROM weakest x WHERE NOT EXISTS (SELECT 1 FROM inside y WHERE y.lang = x.lang AND y.phrase = x.phrase AND y.a >= x.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


@query(_PHRASE_SQL)
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(read(spark, sf_dir, "documents"))


@query()
def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


@query()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
