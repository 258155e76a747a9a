"""Language ID: known words first, then shorter and shorter character n-grams (operator 6).

Fit: about ``sample_docs`` labelled documents per language, those whose hash lies
below a bound that follows from the language's document count, give counts of
words and of the 1- to 4-grams of words.  The ``max_langs`` languages with most
documents are learned.  The model holds the words that are most frequent over all
languages together, and as many n-grams, each with its counts in every language;
at most ``max_entries`` of either, and no more than ``max_cells`` numbers of
either, so its size is bounded whatever the corpus; it is collected and broadcast.

Score of a text: the sum over its words of log frequencies per language.  A word
unknown in every language takes the longest order of which any n-gram is known,
averaged over its known n-grams.  With the log prior, the softmax of the sums is
the score.

Nulls and odd rows: a null text or one without a letter is ``und`` with score 0,
as is every text when nothing could be learned; rows without text or label teach
nothing; a null id counts as remainder 0, so its row is held out.  Rows that repeat
are predicted each.  Ties go to the smaller language name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import bucket, count_bound, small_batches, written

UNKNOWN = "und"
ORDERS = (4, 3, 2, 1)
SAMPLE_DOCS, MAX_ENTRIES, MAX_LANGS, MAX_CELLS = 5_000, 200_000, 500, 8_000_000
_WORD = re.compile(r"[^\W\d_]+")
_EXTRA, _SLICE = 100_000, 50_000


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """n-grams of the word between marks; single letters come without the marks."""
    padded = word if n == 1 else f"_{word}_"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for b in small_batches(batches, "text"):
        seen: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen.setdefault(lang, Counter()).update(words(text))
        rows = []
        for lang, of_words in seen.items():
            of_grams: Counter = Counter()
            for w, c in of_words.items():
                rows.append((lang, 0, w, c))
                for n in ORDERS:
                    for g in grams(w, n):
                        of_grams[n, g] += c
            rows += [(lang, n, g, c) for (n, g), c in of_grams.items()]
        if rows:
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["lang", "n", "item", "c"])


class Model:
    """Log frequencies per language of words (order 0) and n-grams; rows of unknown words are worked out once."""

    def __init__(self, langs: list[str], prior: np.ndarray, tables: dict[int, tuple[list[str], np.ndarray]]):
        self.langs, self.prior = langs, prior
        self.known = {n: dict(zip(items, range(len(items)))) for n, (items, _) in tables.items()}
        self.logs = {n: logs for n, (_, logs) in tables.items()}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not hasattr(self, "rows"):
            self.rows = _Rows(self)
        out = [self._one(t) for t in texts]
        return [o[0] for o in out], [o[1] for o in out]

    def _one(self, text: str | None) -> tuple[str, float]:
        found = words(text) if text else []
        if not self.langs or not any(c.isalpha() for w in found for c in w):
            return UNKNOWN, 0.0
        total = self.prior + sum(self.rows.total(found[i : i + _SLICE]) for i in range(0, len(found), _SLICE))
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.langs[best], float(odds[best] / odds.sum())

    def backed_off(self, word: str) -> np.ndarray:
        for n in ORDERS:
            known = self.known.get(n, {})
            hits = [known[g] for g in grams(word, n) if g in known]
            if hits:
                return self.logs[n][hits].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


class _Rows(dict):
    """Word to row of one matrix: the known words, then a bounded number of unknown ones."""

    def __init__(self, model: Model):
        # The model's own word table moves in here; a second copy would double the worker's memory.
        super().__init__(model.known.pop(0, {}))
        self.model, self.first = model, len(self)
        self.matrix = np.zeros((self.first + _EXTRA, len(model.langs)), np.float32)
        if self.first:
            self.matrix[: self.first] = model.logs[0]
        self.extra: list[str] = []

    def __missing__(self, word: str) -> int:
        row = self[word] = self.first + len(self.extra)
        self.extra.append(word)
        self.matrix[row] = self.model.backed_off(word)
        return row

    def total(self, found: list[str]) -> np.ndarray:
        if len(self.extra) + len(found) > _EXTRA:
            for w in self.extra:
                del self[w]
            self.extra = []
        at = np.fromiter(map(self.__getitem__, found), dtype=np.intp, count=len(found))
        return self.matrix[at].sum(axis=0, dtype=np.float64)


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS, max_entries: int = MAX_ENTRIES, max_langs: int = MAX_LANGS, max_cells: int = MAX_CELLS,
) -> Model:
    """A model from labelled documents; every bound is a parameter and none depends on the corpus size."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(0), {})
    # A language's share of the hashes that gives it the wanted number of documents.
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(1.0, sample_docs / sizes[lang]))))[F.col("lang")]
    drawn = (F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)) < share
    sample = labelled.filter(F.col("lang").isin(langs) & drawn).select("lang", "text")
    counted = sample.mapInArrow(_counts, "lang string, n int, item string, c bigint").groupBy("lang", "n", "item").agg(F.sum("c").alias("c"))
    places = F.create_map(*(F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)))[F.col("lang")]
    items = written(counted.groupBy("n", "item").agg(F.sum("c").alias("all"), F.collect_list(F.struct(places.alias("at"), "c")).alias("of")), "language-items")
    most = max(1, min(max_entries, max_cells // len(langs)))
    of_words, of_grams = F.col("n") == 0, F.col("n") > 0
    low = [count_bound(items.filter(kind), most, "all") for kind in (of_words, of_grams)]
    top = items.filter((of_words & (F.col("all") >= low[0])) | (of_grams & (F.col("all") >= low[1]))).select("n", "item", "of.at", "of.c").toArrow()
    prior = np.log(np.array([sizes[x] for x in langs], float) / sum(sizes.values()))
    return Model(langs, prior, _tables(top, len(langs)))


def _tables(top: pa.Table, langs: int) -> dict[int, tuple[list[str], np.ndarray]]:
    order = np.asarray(top.column("n"))
    out = {}
    for n in np.unique(order).tolist():
        rows = top.filter(pa.array(order == n)).sort_by("item").combine_chunks()
        counts = np.full((rows.num_rows, langs), 0.5)
        of = rows.column("at").combine_chunks()
        counts[np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(of.offsets))), np.asarray(of.flatten())] += np.asarray(rows.column("c").combine_chunks().flatten())
        out[n] = rows.column("item").to_pylist(), np.log(counts / counts.sum(axis=0)).astype(np.float32)
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``lang_pred`` and ``score``, which replace columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*(c for c in docs.columns if c not in ("lang_pred", "score")))

    def judge(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for b in small_batches(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text"):
            lang, score = shared.value.predict(b.column(0).to_pylist())
            langs += lang
            scores += score
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    # Only the text goes to Python and only the verdict comes back.  Marked so, the function is not copied into
    # a filter on its own result, where each text would be judged again by a second worker.
    found = F.arrow_udf(judge, "lang_pred string, score double").asNondeterministic()(F.col(text_col).cast("string"))
    return kept.withColumn("_judged", found).select(*kept.columns, "_judged.lang_pred", "_judged.score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row; documents of fold 0 are never learned from."""
    held = bucket(F.col(id_col), folds) == 0
    model = fit(docs.filter(~held), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in small_batches(batches, "_text"):
            lang, score = shared.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
