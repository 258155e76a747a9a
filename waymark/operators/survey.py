"""Page survey: which known terms a page names, and what is new since last time."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark import fixed
from waymark.functions import occurrences as occ
from waymark.functions.text import SPACES, goods_codes
from waymark.sources.html import small_batches

#: Terms of one pass over the pages; a larger dictionary is passed in as many blocks as it needs.
TERMS_AT_ONCE = 500_000
#: Bytes of pages that are searched together; what a hit costs is a hundred bytes and more.
SEARCH_BYTES = 250_000
#: Stands between texts that are searched together; no term holds it.
_BETWEEN = "\0"
_WORD = re.compile(f"[{fixed.WORD_CHARS}]")
#: White space of any script (the Unicode property).
_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class Dictionary:
    """Finds the terms of a dictionary in many texts, in one pass over each.

    Built once and sent to the workers whole.  The automaton gives (place, term)
    pairs; counts, borders and overlaps are then worked out for all texts of a
    batch together.
    """

    def __init__(self, terms: Sequence[str]):
        import ahocorasick

        self.terms = [t for t in dict.fromkeys(terms) if t and _BETWEEN not in t]
        self.sizes = np.array([len(t) for t in self.terms], np.int64)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.terms):
            self.automaton.add_word(t, i)
        if self.terms:
            self.automaton.make_automaton()

    def find(self, texts: Sequence[str | None], pad: int, max_hits: int | None, contexts: bool) -> dict[str, list | np.ndarray]:
        """Columns text (its place), term (its place), count, suspect, and if asked for ctx and ctxs, by text and term.

        Occurrences of one term do not overlap; with ``max_hits`` later ones are not looked at.
        """
        joined = _BETWEEN.join(t or "" for t in texts) + _BETWEEN
        # Two numbers a hit, never a list of pairs: short terms hit about once a character.
        found = chain.from_iterable(self.automaton.iter(joined)) if self.terms else ()
        hits = np.fromiter(found, np.int64).reshape(-1, 2)
        stops = np.cumsum([len(t or "") + 1 for t in texts])
        term, start = hits[:, 1], hits[:, 0] + 1 - self.sizes[hits[:, 1]]
        text = np.searchsorted(stops, start, "right")
        order = np.lexsort((start, term, text))
        term, start, text = term[order], start[order], text[order]
        fresh = np.append(True, (text[1:] != text[:-1]) | (term[1:] != term[:-1]))[: len(term)]
        keep = self._apart(start, self.sizes[term], fresh)
        term, start, text = term[keep], start[keep], text[keep]
        fresh = np.append(True, (text[1:] != text[:-1]) | (term[1:] != term[:-1]))[: len(term)]
        firsts = np.flatnonzero(fresh)
        if max_hits is not None and len(firsts):
            nth = np.arange(len(term)) - np.repeat(firsts, np.diff(np.append(firsts, len(term))))
            keep = nth < max_hits
            term, start, text, fresh = term[keep], start[keep], text[keep], fresh[keep]
            firsts = np.flatnonzero(fresh)
        clean = ~self._touched(joined, start, start + self.sizes[term])
        count = np.diff(np.append(firsts, len(term)))
        any_clean = np.add.reduceat(clean, firsts) > 0 if len(firsts) else np.zeros(0, bool)
        found = {"text": text[firsts], "term": term[firsts], "count": count, "suspect": ~any_clean}
        if contexts:
            begins = np.append(0, stops[:-1])
            around = lambda i: _GAP.sub(" ", joined[max(begins[text[i]], start[i] - pad) : min(stops[text[i]] - 1, start[i] + self.sizes[term[i]] + pad)]).strip(SPACES)
            first_clean = np.minimum.reduceat(np.where(clean, np.arange(len(term)), len(term)), firsts) if len(firsts) else firsts
            found["ctx"] = [around(c if ok else f) for f, c, ok in zip(firsts.tolist(), first_clean.tolist(), any_clean.tolist())]
            found["ctxs"] = [[around(i) for i in range(f, f + min(3, n))] for f, n in zip(firsts.tolist(), count.tolist())]
        return found

    @staticmethod
    def _apart(start: np.ndarray, size: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Occurrences that do not overlap one before them that counts; only terms that can overlap themselves are walked."""
        keep = np.ones(len(start), bool)
        close = np.flatnonzero(~fresh & (start < np.append(0, start[:-1] + size[:-1])[: len(start)]))
        groups = np.flatnonzero(fresh)
        for g in np.unique(np.searchsorted(groups, close, "right") - 1).tolist():
            end = 0
            for i in range(groups[g], groups[g + 1] if g + 1 < len(groups) else len(start)):
                if start[i] < end:
                    keep[i] = False
                else:
                    end = start[i] + size[i]
        return keep

    @staticmethod
    def _touched(text: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a word character stands right before or behind."""
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, of = np.unique(letters[np.concatenate([np.maximum(start - 1, 0), end])], return_inverse=True)
        word = np.array([_WORD.match(chr(k)) is not None for k in kinds.tolist()], bool)[of]
        return (word[: len(start)] & (start > 0)) | word[len(start) :]


def searched(batches: Iterator[pa.RecordBatch], dictionary: Dictionary, pad: int, max_hits: int | None, kinds: dict[str, pa.DataType], key: str) -> Iterable[pa.RecordBatch]:
    """The findings in (key, text) batches, at most about ``SEARCH_BYTES`` of text, or one longer text, searched at a time."""
    names = pa.array(dictionary.terms, pa.string())
    for b in small_batches(batches, 1, SEARCH_BYTES):
        found = dictionary.find(b.column(1).to_pylist(), pad, max_hits, "ctxs" in kinds)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(found["text"])), names.take(pa.array(found["term"])), *(pa.array(found[c], t) for c, t in kinds.items())], [key, "term", *kinds]
        )


def page_terms(
    pages: DataFrame, terms: DataFrame, key: str = "page_id", text: str = "text",
    pad: int = fixed.CONTEXT_PAD, max_hits: int | None = None, at_once: int = TERMS_AT_ONCE, contexts: bool = True,
) -> DataFrame:
    """(key, term, count, suspect, ctx, ctxs) of every dictionary term that occurs in a page.

    A term is suspect when a word character touches every occurrence.  ``ctx``
    is the context of the first occurrence that none touches, or else of the
    first; ``ctxs`` are the first three; both are left out without ``contexts``.
    The automaton is built once and shared; the pages are scanned once for up to
    ``at_once`` terms, and once per block of so many beyond that.  Only the
    findings leave the task, never the text.  ``max_hits`` stops a term's count;
    the survey's own rule stops at ``fixed.PROBE_MAX_HITS``.
    """
    wanted = terms.select("term").filter("term <> ''").distinct()
    blocks = max(1, -(-wanted.count() // at_once))
    spark = pages.sparkSession
    kinds = {"count": pa.int64(), "suspect": pa.bool_(), "ctx": pa.string(), "ctxs": pa.list_(pa.string())}
    told = {"count": "bigint", "suspect": "boolean", "ctx": "string", "ctxs": "array<string>"}
    columns = list(kinds) if contexts else ["count", "suspect"]
    schema = f"`{key}` {pages.schema[key].dataType.simpleString()}, term string, " + ", ".join(f"{c} {told[c]}" for c in columns)

    def passed(number: int) -> DataFrame:
        # A block holds about at_once terms, dealt by hash.
        own = wanted.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == number).toArrow().column("term").to_pylist()
        shared = spark.sparkContext.broadcast(Dictionary(own))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            return searched(batches, shared.value, pad, max_hits, {c: kinds[c] for c in columns}, key)

        return pages.select(key, text).mapInArrow(run, schema)

    return reduce(DataFrame.union, map(passed, range(blocks)))


_SEEN = T.ArrayType(T.StructType([
    T.StructField("term", T.StringType()), T.StructField("count", T.LongType()), T.StructField("suspect", T.BooleanType()),
    T.StructField("ctx", T.StringType()), T.StructField("ctxs", T.ArrayType(T.StringType())),
]))


def analyze(pages: DataFrame, terms: Sequence[str] = fixed.KNOWN_BRANDS, max_hits: int | None = None) -> DataFrame:
    """Collected pages with confirmed terms, suspect ones with their context, all contexts with counts,
    the brand directory and the text length; terms stand in the dictionary's order."""
    shared = pages.sparkSession.sparkContext.broadcast(Dictionary(terms))

    def seen(texts: pd.Series) -> pd.Series:
        dictionary, out, every = shared.value, [[] for _ in texts], texts.tolist()
        upto = np.cumsum([len(t or "") for t in every])
        # Texts are searched together, as many characters at a time as pages have bytes.
        for part in np.split(np.arange(len(every)), np.flatnonzero(np.diff(upto // SEARCH_BYTES)) + 1):
            found = dictionary.find([every[i] for i in part], fixed.CONTEXT_PAD, max_hits, True)
            for at, t, count, suspect, ctx, ctxs in zip(found["text"].tolist(), found["term"].tolist(), found["count"].tolist(), found["suspect"].tolist(), found["ctx"], found["ctxs"]):
                out[part[at]].append({"term": dictionary.terms[t], "count": count, "suspect": suspect, "ctx": ctx, "ctxs": ctxs})
        return pd.Series(out, dtype=object)

    named = lambda suspect: F.transform(F.filter("_seen", lambda s: s["suspect"] == suspect), lambda s: s["term"])
    doubtful = F.transform(F.filter("_seen", lambda s: s["suspect"]), lambda s: F.struct(s["term"].alias("term"), s["ctx"].alias("ctx")))
    contexts = F.transform("_seen", lambda s: F.struct(s["term"].alias("term"), s["count"].alias("count"), s["ctxs"].alias("ctxs")))
    return pages.withColumn("_seen", F.pandas_udf(seen, _SEEN)(F.col("text"))).select(
        *pages.columns, named(False).alias("confirmed"), named(True).alias("suspect"),
        doubtful.alias("suspect_contexts"), contexts.alias("contexts"),
        occ.list_after(F.col("text")).alias("directory"), F.length("text").alias("text_len"),
    )


def delta(analyzed: DataFrame, known: DataFrame, key: str = "page_id", rules=fixed.GOODS_CODES) -> DataFrame:
    """What a page shows beyond its catalog entry.  Only additions are ever reported.

    ``analyzed`` holds (key, confirmed, directory, cats, text_len), ``known``
    holds (key, known_brands, known_cats).
    """
    none = F.array().cast("array<string>")
    brands = F.array_union(F.coalesce("confirmed", none), F.coalesce("directory", none))
    cats = goods_codes(F.coalesce("cats", none), rules)
    return (
        analyzed.join(known, key, "left")
        .withColumn("_b", brands).withColumn("_c", cats)
        .select(
            key,
            F.array_except("_b", F.coalesce("known_brands", none)).alias("new_brands"),
            F.array_except("_c", F.coalesce("known_cats", none)).alias("new_cats"),
            F.size("_b").alias("seen_brands"), F.size("_c").alias("seen_cats"),
            (F.coalesce("text_len", F.lit(0)) < fixed.THIN_PAGE).alias("thin"),
        )
    )


def run_summary(report: DataFrame) -> DataFrame:
    """One row: pages checked, changed, failed and thin; ``ok`` tells whether a page was read."""
    changed = (F.size("new_brands") > 0) | (F.size("new_cats") > 0)
    return report.agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(F.col("ok") & changed).alias("changed"),
        F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok") & F.col("thin")).alias("thin"),
    )
