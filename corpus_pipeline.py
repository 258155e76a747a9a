"""Documents to training tokens: language ID, near-dedup, secret scan, mixing, BPE."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bpe, langid, minhash, mixing, secrets
from waymark.llm.common import read, small_side, written
from waymark.operators.ordering import number_all

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (``und``: null, or without a letter) go, whatever their label; a missing label becomes the predicted one.

    Rows that repeat are judged each; a score drops nothing, since it depends on how many languages there are.
    """
    judged = langid.predict(docs.select(*COLUMNS), langid.fit(docs))
    kept = judged.filter(F.col("lang_pred") != langid.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays: the one with the smallest id, or one without an id if none has any.

    Of rows equal in id and text one stays.
    """
    keyed = _keyed(_without_repeats(docs.select(*COLUMNS)))
    gone = minhash.near_duplicates(keyed, "_key", shingle_words=5).filter(~F.col("kept")).select(F.col("_key").alias("_gone")).distinct()
    gone = small_side(written(gone, "gone"))
    return keyed.join(gone, F.col("_key") == F.col("_gone"), "left_anti").select(*COLUMNS)


def _without_repeats(docs: DataFrame) -> DataFrame:
    """Of rows equal in id and text the one with the greatest other columns; only rows that repeat are shuffled with their texts."""
    of = F.xxhash64(F.coalesce("text", F.lit(""))).alias("_of")
    again = written(docs.groupBy(F.col("doc_id").alias("_id"), of).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "repeats")
    if again.isEmpty():
        return docs
    keyed = docs.select("*", of.alias("_hash"))
    same = keyed["doc_id"].eqNullSafe(again["_id"]) & (keyed["_hash"] == again["_of"])
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = keyed.join(again, same, "left_semi").groupBy("doc_id", "text").agg(F.max(F.struct(*others)).alias("_rest")).select("doc_id", "text", "_rest.*")
    return written(keyed.join(again, same, "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS)), "unrepeated")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``: the id, and for rows without one a number no id has, behind all ids where there is room."""
    low, high, nameless = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    named = docs.filter("doc_id is not null").withColumn("_key", F.col("doc_id").cast("bigint"))
    if not nameless:
        return named
    numbered = number_all(docs.filter("doc_id is null"), [F.xxhash64("text"), "text"], "_no")
    behind = (high or 0) + nameless < 1 << 63
    key = F.lit(high or 0) + F.col("_no") if behind else F.lit(low) - F.col("_no")
    return named.unionByName(numbered.withColumn("_key", key.cast("bigint")).drop("_no"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, also without text; secrets other than widely copied examples are replaced by a mark.

    Rows that repeat are cleaned each; they count as one repository.
    """
    clean = secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; documents without words are never taken, rows that repeat share what was drawn."""
    return mixing.take(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mixture; a null or empty text has none."""
    return bpe.encode(docs, tokenizer_path(TOKENIZER), ("n_tokens", "token_ids"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mix_sources), ("bpe", encode)]

#: Classifiers, signatures and draws by hash have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
