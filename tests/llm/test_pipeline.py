"""The pipeline's stages against plain readings of what each one decides."""

import collections

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import brute_components, words

SMALL = "/root/testdata/sf0.001"


def with_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = docs.filter("doc_id = 8").first()["text"]
    odd = [(None, None, None, None, None), (5001, "", "en", "src1", 0), (5002, "++ 12", None, "src1", 5), (5003, text, None, None, 1), (5004, text + " again", "en", "src2", 1), (5005, "key token=abcdef123456 end of a text", "en", "src3", 1)]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("key", F.lit(1))


def test_stages_one_after_the_other(spark):
    docs = with_odd_rows(spark).select(*corpus_pipeline.COLUMNS, "key")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "secret_scan", "mixing", "bpe"]

    named = corpus_pipeline.written(stages["language_id"](spark, docs, SMALL), "t")
    assert named.columns == corpus_pipeline.COLUMNS
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in (docs, named))
    assert set(before) - set(after) == {None, 5001, 5002} | {i for i, r in before.items() if r["text"] and not any(c.isalpha() for c in r["text"])}
    assert all(r["text"] == before[i]["text"] and r["lang"] for i, r in after.items())

    kept = corpus_pipeline.written(stages["near_dedup"](spark, named, SMALL), "t")
    _, root = brute_components([(i, r["text"]) for i, r in after.items()], 5, 80)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in after if root[i] == i} and 5003 not in root.values()

    clean = corpus_pipeline.written(stages["secret_scan"](spark, kept, SMALL), "t")
    rows = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == corpus_pipeline.COLUMNS and len(rows) == kept.count()
    assert rows[5005]["text"] == "key [secret] end of a text" and all(r["n_chars"] == len(r["text"]) for r in rows.values())

    mixed = corpus_pipeline.written(stages["mixing"](spark, clean, SMALL), "t")
    taken, size = collections.Counter(), collections.Counter()
    for r in mixed.collect():
        taken[r["source"]] += len(words(r["text"]))
        assert r["text"] == rows[r["doc_id"]]["text"]
    for r in rows.values():
        size[r["source"]] += len(words(r["text"]))
    assert mixed.columns == corpus_pipeline.COLUMNS and abs(sum(taken.values()) / sum(size.values()) - 1) < 0.03
    assert max(collections.Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3

    coded = stages["bpe"](spark, mixed, SMALL).collect()
    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    assert len(coded) == mixed.count()
    for r in coded[:40]:
        assert r["token_ids"] == tok.encode(rows[r["doc_id"]]["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["token_ids"])


def test_repeats_and_rows_without_id_are_near_copies_too(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "en", "s", 1)] * 300 + [(2, b, None, "s", 1), (2, b, "en", "t", 1), (3, b + " more", "en", "s", 1), (None, a, "en", "s", 1)]
    rows += [(None, c, "en", "s", 1)] * 20 + [(None, c + " more", "en", "s", 1), (4, "one text", "en", "s", 1), (None, "alone", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = [(r["doc_id"], r["text"][:2]) for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SMALL).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a0"), (2, "b0"), (None, "c0"), (4, "on"), (None, "al")], key=str)


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), "t")
    assert docs.count() == 0 and np.isin(["doc_id", "n_tokens", "token_ids"], docs.columns).all()
