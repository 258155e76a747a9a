"""Alignment of two tokenizers' tokens over the same bytes (operator 13).

A is a byte-level BPE from a tokenizers file, B a sentencepiece model with byte
fallback.  A text is encoded by A with one space before it, by B as it is (B adds
the space), without special tokens.  Where both sides' token bytes spell space +
text, tokens are linked that overlap in bytes, and the places where tokens of
both sides end cut the text into groups.

Lockstep merging: all texts of a batch advance together.  One vector of states
holds each text's place in A and in B; a step emits the pair of tokens at every
place as a link, moves A where A's token ends first, B where B's does, both (and
emits a cut) where they end together, and drops the texts that are done.  A long
text enters as several lanes of at least ``lane`` bytes that begin at ends both
sides share, so a batch takes about as many steps as its longest lane has tokens.

Counts: pass one writes per text its digests and its distinct id pairs with how
often each is linked; their sums are the corpus-wide counts, and a pair is best
if no pair with the same B id has a higher count.  In pass two the most frequent
``table_pairs`` pairs, a table of bounded size, are broadcast; texts' other pairs
meet their counts in a join.

A's encoder runs the vocabulary and merges of the file with the byte-level
split; the file is refused if it normalizes, adds a space, cuts, or ranks its
merges other than by id.

Nulls and odd rows: null and empty texts, and those that either side does not
spell exactly, have no tokens: zeros and an empty ``groups_sha256``.  Rows that
repeat are counted each; a null id stays null.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import count_bound, small_batches, written

LANE_BYTES, BATCH_BYTES = 2_048, 1_000_000
TABLE_PAIRS = 1 << 20
#: The split of byte-level BPE into pre-tokens: fixed value of the format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteSide:
    """Tokenizer A: ids of texts, and each id's bytes."""

    def __init__(self, tokenizer_json: str):
        import tiktoken

        said = json.loads(tokenizer_json)
        model, split = said["model"], said["pre_tokenizer"]
        plain = not any((said["normalizer"], said["truncation"], said["padding"], model["dropout"], model["continuing_subword_prefix"], model["end_of_word_suffix"]))
        if not plain or model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("tokenizer A must be a plain byte-level BPE")
        letters = byte_letters()
        special = {t["content"] for t in said["added_tokens"]}
        spelled = {t: i for t, i in model["vocab"].items() if t not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [spelled[a + b] for a, b in merges]
        if ids != sorted(ids):
            raise ValueError("tokenizer A must rank its merges by id")
        ranks = {bytes(letters[c] for c in t): i for t, i in spelled.items()}
        self.spelled = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.spelled[i] = t
        self.coder = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.coder.encode_ordinary(t), np.int32) for t in texts]


class PieceSide:
    """Tokenizer B: ids of texts, and each id's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.spelled = []
        for i in range(self.coder.get_piece_size()):
            piece = self.coder.id_to_piece(i)
            self.spelled.append(bytes([int(piece[3:5], 16)]) if self.coder.is_byte(i) else piece.replace("▁", " ").encode("utf-8"))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in self.coder.encode(texts, num_threads=1)]


def merge(ends_a: list[np.ndarray], ends_b: list[np.ndarray], lane: int = LANE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(link_a, link_b, cut_a, cut_b): linked token places and, at every cut, the places just behind it.

    Places count over all texts, one after the other; each text's two sides end at the same byte.  Order is by
    steps, not by text.
    """
    size = np.array([int(e[-1]) for e in ends_a], np.int64)
    shift = np.cumsum(size) - size
    a = np.concatenate([e + s for e, s in zip(ends_a, shift)])
    b = np.concatenate([e + s for e, s in zip(ends_b, shift)])
    shared = np.intersect1d(a, b, assume_unique=True)
    # The first shared end in every stretch of ``lane`` bytes ends a lane; so does each text.
    first = np.append(True, shared[1:] // lane != shared[:-1] // lane)
    stops = np.union1d(shared[first], shift + size)
    stop_a, stop_b = np.searchsorted(a, stops) + 1, np.searchsorted(b, stops) + 1
    at_a, at_b = np.append(0, stop_a[:-1]), np.append(0, stop_b[:-1])
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(at_a):
        end_a, end_b = a[at_a], b[at_b]
        links_a.append(at_a)
        links_b.append(at_b)
        at_a, at_b = at_a + (end_a <= end_b), at_b + (end_b <= end_a)
        cut = end_a == end_b
        cuts_a.append(at_a[cut])
        cuts_b.append(at_b[cut])
        live = at_a < stop_a
        if not live.all():
            at_a, at_b, stop_a = at_a[live], at_b[live], stop_a[live]
    return tuple(np.concatenate(x) for x in (links_a, links_b, cuts_a, cuts_b))


class Aligner:
    """Digests and linked pairs of texts, a batch at a time."""

    def __init__(self, tokenizer_json: str, model: bytes, lane: int = LANE_BYTES):
        self.a, self.b, self.lane = ByteSide(tokenizer_json), PieceSide(model), lane
        if len(self.b.spelled) > 1 << 15 or len(self.a.spelled) > 1 << 16:
            raise ValueError("a pair of ids must fit 31 bits")
        # Each id's digits with what may follow it: A "," or "|", B "," or ";".
        digits = lambda n, end: [f"{i}{end}" for i in range(n)]
        na, nb = len(self.a.spelled), len(self.b.spelled)
        self.written = digits(na, ",") + digits(na, "|") + digits(nb, ",") + digits(nb, ";")
        self.size_a, self.size_b = (np.array([len(t) for t in side.spelled], np.int64) for side in (self.a, self.b))

    def rows(self, texts: list[str | None]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Per text: n_a, n_b, n_groups, n_links, groups' digest, distinct pairs (A << 15 | B), how often each."""
        none = np.empty(0, np.int32)
        out = [(0, 0, 0, 0, "", none, none)] * len(texts)
        told = [i for i, t in enumerate(texts) if t]
        ids_a = self.a.encode([" " + texts[i] for i in told])
        ids_b = self.b.encode([texts[i] for i in told])
        use = []
        for k, i in enumerate(told):
            data = b" " + texts[i].encode("utf-8")
            if all(b"".join(map(side.spelled.__getitem__, ids[k].tolist())) == data for side, ids in ((self.a, ids_a), (self.b, ids_b))):
                use.append(k)
        if not use:
            return out
        ids_a, ids_b = [ids_a[k] for k in use], [ids_b[k] for k in use]
        la, lb, ca, cb = merge([np.cumsum(self.size_a[x]) for x in ids_a], [np.cumsum(self.size_b[x]) for x in ids_b], self.lane)
        ca, cb = np.sort(ca), np.sort(cb)
        all_a, all_b = np.concatenate(ids_a), np.concatenate(ids_b)
        ends_a, ends_b = np.cumsum([len(x) for x in ids_a]), np.cumsum([len(x) for x in ids_b])
        spelled = self._spelled(all_a, all_b, ca, cb)
        owner = np.searchsorted(ends_a, la, "right")
        keys, often = np.unique(owner << 31 | all_a[la].astype(np.int64) << 15 | all_b[lb], return_counts=True)
        pairs, often = (keys & 0x7FFFFFFF).astype(np.int32), often.astype(np.int32)
        n_links = np.bincount(owner, minlength=len(use))
        starts = np.searchsorted(keys, np.arange(len(use) + 1, dtype=np.int64) << 31)
        groups = np.searchsorted(ca, ends_a, "right")
        begin_a = begin_b = begin_g = 0
        for j, k in enumerate(use):
            end_a, end_b, end_g = int(ends_a[j]), int(ends_b[j]), int(groups[j])
            said = "".join(spelled[begin_a + begin_b : end_a + end_b])[:-1]
            own = slice(starts[j], starts[j + 1])
            out[told[k]] = (end_a - begin_a, end_b - begin_b, end_g - begin_g, int(n_links[j]), hashlib.sha256(said.encode()).hexdigest(), pairs[own], often[own])
            begin_a, begin_b, begin_g = end_a, end_b, end_g
        return out

    def _spelled(self, all_a: np.ndarray, all_b: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> list[str]:
        """Both sides' ids as digits with separators, group by group: the group's A tokens, then its B tokens."""
        na, nb = len(self.a.spelled), len(self.b.spelled)
        code_a, code_b = all_a.astype(np.int64), all_b.astype(np.int64) + 2 * na
        code_a[ca - 1] += na
        code_b[cb - 1] += nb
        group_a = np.repeat(np.arange(len(ca)), np.diff(ca, prepend=0))
        group_b = np.repeat(np.arange(len(cb)), np.diff(cb, prepend=0))
        mixed = np.empty(len(code_a) + len(code_b), np.int64)
        mixed[np.arange(len(code_a)) + np.append(0, cb)[group_a]] = code_a
        mixed[np.arange(len(code_b)) + ca[group_b]] = code_b
        return list(map(self.written.__getitem__, mixed.tolist()))


def align(docs: DataFrame, tokenizer_json: str, model: str, id_col: str = "doc_id", text_col: str = "text", lane: int = LANE_BYTES, table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.  Paths name the two tokenizers' files, read by the driver."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(tokenizer_json, encoding="utf-8") as f, open(model, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        aligner = Aligner(*shared.value, lane)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        names = ("id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "often")
        for b in small_batches(batches, "text", BATCH_BYTES):
            columns = zip(*aligner.rows(b.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    texts = written(rows.mapInArrow(run, f"id {id_type}, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>, often array<int>"), "aligned")
    each = texts.select(F.explode(F.arrays_zip("pairs", "often")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.often").alias("often"))
    counts = written(each.groupBy("pair").agg(F.sum("often").alias("c")), "pair-counts")
    # One row per B id, at most as many as the vocabulary holds.
    of_b = F.col("pair").bitwiseAND(0x7FFF)
    highest = counts.groupBy(of_b.alias("of")).agg(F.max("c").alias("high"))
    counts = written(counts.join(F.broadcast(highest), of_b == F.col("of")).select("pair", "c", (F.col("c") == F.col("high")).alias("best")), "pair-table")
    found, others = _met(texts, counts, count_bound(counts, table_pairs))
    late = others.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("late_best"), F.sum(F.col("often") * F.col("c")).alias("late_sum"))
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return found.join(late, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", (F.col("best") + more("late_best")).cast("bigint").alias("n_best"),
        (F.col("sum") + more("late_sum")).cast("bigint").alias("count_sum"), "groups_sha256",
    )


def _met(texts: DataFrame, counts: DataFrame, low: int) -> tuple[DataFrame, DataFrame]:
    """(texts with best and sum over the pairs of the broadcast table, (row, often, c, best) of the other pairs)."""
    top = counts.filter(F.col("c") >= low).toArrow()
    pair = np.asarray(top.column("pair").combine_chunks())
    order = np.argsort(pair)
    table = pair[order], np.asarray(top.column("c").combine_chunks())[order], np.asarray(top.column("best").combine_chunks().cast(pa.int8()), np.int64)[order]
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        keys, count, best = shared.value
        for b in batches:
            pairs, often = b.column(7), b.column(8)
            ends = np.asarray(pairs.offsets, dtype=np.int64)
            flat, times = np.asarray(pairs.flatten()), np.asarray(often.flatten(), dtype=np.int64)
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            hit = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            n_best, total = (_sums(np.where(hit, times * (of[at] if len(of) else 0), 0), ends) for of in (best, count))
            left = np.concatenate([[0], np.cumsum(~hit)]).astype(np.int32)[ends - ends[0]]
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~hit].astype(np.int32))) for x in (flat, times)]
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(n_best), pa.array(total), *rest], [*b.schema.names[:7], "best", "sum", "pairs", "often"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields[:7])
    met = written(texts.mapInArrow(run, f"{kept}, best bigint, sum bigint, pairs array<int>, often array<int>"), "met")
    others = met.select("row", F.explode(F.arrays_zip("pairs", "often")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.often").alias("often"))
    return met.drop("pairs", "often"), others.join(counts.filter(F.col("c") < low), "pair")


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    at = ends - ends[0]
    return total[at[1:]] - total[at[:-1]]
