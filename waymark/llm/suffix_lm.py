"""Language-model scoring with a probabilistic suffix tree (operator 4).

Tokens are lower-cased words and one end per text.  The root gives every token
(c + 1) / (N + V + 1) from counts over all training texts.  Below it hang
contexts of one to ``depth`` preceding tokens, the first of which may be the
text's start.

* A context is a candidate if it occurs ``least_context`` times, a successor is
  stored if it follows it ``least_next`` times; both are absolute, so the tree
  grows with the corpus.  A longer n-gram is at most as frequent as its parts,
  which are asked first (a Bloom filter of bounded size; what it lets through
  beside them is cut by its own count).
* Distributions are smoothed by absolute discounting: what is taken from the
  stored successors goes to the suffix's distribution, so each context's
  probabilities sum to one.
* A context stays when its distribution diverges from that of its suffix by
  ``divergence`` nats or more, or when a longer context that stays ends in it.
* A token is scored in the longest context that stays.

Since the suffixes of a context that stays stay too, a token's score is a sum: the
root's logarithm, for each context that stays before it the logarithm of what it
leaves to its suffix, and for each of those that stores the token what that adds.
A text's score is therefore a sum over its words, contexts and n-grams of one
number each.  The numbers live in written tables; the ``table`` most frequent
words and as many other entries are broadcast, and what is left of a text's keys
meets the tables in a join, so every number enters every score.

N-grams are counted in slices by their hash.  A task sends a slice its n-grams as
one packed value: columns of tokens, each by its place among the ``table`` most
frequent ones (any other as its hash), and counts.

Tokens and n-grams are told apart by 64-bit hashes.  Nulls and odd rows: a null
text is empty and has its end token; a null id counts as remainder 0; rows that
repeat an id are scored, and learned, each for itself.  Without training texts
N = V = 0 and every token has probability 1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import bucket, count_bound, mix, small_batches, trim, written

DEPTH, LEAST_CONTEXT, LEAST_NEXT, DIVERGENCE, DISCOUNT = 3, 100, 20, 0.01, 0.5
TABLE = 1 << 20
#: The filters grow with what they hold up to this many bits (16 MB).
BLOOM_BITS = 1 << 27
_HELD_ROWS = 1_000_000
#: Slices in which n-grams are counted: one per so many tokens of a small corpus, up to a number; one per so many of a large one.
_SMALL_SLICE, _SLICES, _LARGE_SLICE = 10_000, 1024, 2_000_000
#: The text's end and start; no word holds white space.
_END, _START = b"\n", b"\t"
_ODD, _REST = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


#: White space of the contract; a number for every byte, the same for both cases of a letter; a base and its inverse modulo 2^64.
_IS_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([i]).lower()) for i in range(256)], np.uint64)
_BASE, _LONG = 0x9E3779B97F4A7C13, 32
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n - 1 or more, and those of its inverse; kept for batches of the usual size."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps))
    if n <= 1 << 22:
        _POWERS[:] = made
    return made[0], made[1]


def followed(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Code of a context with one more token: the n-gram's, and that of the longer context."""
    return mix(context * _ODD + token)


def rest_key(context: np.ndarray) -> np.ndarray:
    return mix(context ^ _REST)


class Tokens:
    """Hashes of many texts' tokens in a row, each text between its start and its end."""

    def __init__(self):
        self.start, self.end = (xxhash.xxh3_64_intdigest(x) for x in (_START, _END))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, place behind each text).

        A word's hash is a polynomial in its bytes' random numbers, modulo 2^64,
        taken for all words at once from running sums; a word of more than
        ``_LONG`` bytes, where such polynomials may meet, has its own hash.
        """
        parts = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
        # A blank before and behind each text cuts its words off and keeps an even number of borders.
        raw = np.frombuffer(b"".join(x for t in parts for x in (b" ", t, b" ")), np.uint8)
        sizes = np.array([len(t) + 2 for t in parts], np.int64)
        blank = _IS_BLANK[raw]
        cut = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        first, behind = cut[::2], cut[1::2]
        powers, inverse = _powers(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * powers[: len(raw)], out=sums[1:])
        h = mix((sums[behind] - sums[first]) * inverse[first] + (behind - first).astype(np.uint64) * _ODD)
        for i in np.flatnonzero(behind - first > _LONG):
            h[i] = xxhash.xxh3_64_intdigest(raw[first[i] : behind[i]].tobytes().lower())
        upto = np.searchsorted(first, np.cumsum(sizes), "left")
        ends = upto + 2 * np.arange(1, len(parts) + 1)
        out = np.empty(len(h) + 2 * len(parts), np.uint64)
        is_word = np.ones(len(out), bool)
        begins = np.append(0, ends[:-1]).astype(np.int64)[: len(parts)]
        is_word[begins], is_word[ends - 1] = False, False
        out[is_word], out[begins], out[ends - 1] = h, self.start, self.end
        return out, ends.astype(np.int64)

    def contexts(self, h: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per length 1 to ``depth``: (places of tokens that have such a context, its codes)."""
        at = np.flatnonzero(h != np.uint64(self.start))
        for d in range(1, depth + 1):
            code = h[at - d]
            for back in range(d - 1, 0, -1):
                code = followed(code, h[at - back])
            yield at, code
            # One more token to the left, unless the context begins at the text's start.
            at = at[h[at - d] != np.uint64(self.start)]


class Bloom:
    """Keys of a table, or a few more; two bits each."""

    def __init__(self, keys: DataFrame):
        n = keys.count()
        self.bits = min(BLOOM_BITS, 1 << max(16, (n * 16).bit_length()))
        k = F.col("key")
        spots = keys.select(F.explode(F.array(k.bitwiseAND(self.bits - 1), F.shiftrightunsigned(k, 37).bitwiseAND(self.bits - 1))).alias("spot"))
        words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("set")).toArrow()
        held = np.zeros(self.bits >> 6, np.int64)
        held[np.asarray(words.column("word"), dtype=np.int64)] = np.asarray(words.column("set"), dtype=np.int64)
        self.words = held.view(np.uint64)

    def holds(self, key: np.ndarray) -> np.ndarray:
        held = np.ones(len(key), bool)
        for spot in (key & np.uint64(self.bits - 1), key >> np.uint64(37) & np.uint64(self.bits - 1)):
            held &= (self.words[(spot >> np.uint64(6)).astype(np.intp)] >> (spot & np.uint64(63)) & np.uint64(1)) == 1
        return held


# ---- counting -------------------------------------------------------------------
class _Sums:
    """Distinct keys with columns that belong to them, and how often each came; gives them out when they are many."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, *columns: np.ndarray) -> None:
        """``columns`` begins with the key; equal keys have equal columns."""
        _, first, often = np.unique(columns[0], return_index=True, return_counts=True)
        self.held.append([*(c[first] for c in columns), often])
        self.size += len(first)
        if self.size > _HELD_ROWS:
            self._merge()

    def _merge(self) -> None:
        *columns, often = (np.concatenate(c) for c in zip(*self.held))
        _, first, at = np.unique(columns[0], return_index=True, return_inverse=True)
        self.held = [[*(c[first] for c in columns), np.bincount(at, weights=often).astype(np.int64)]]
        self.size = len(first)

    def out(self, all_of_it: bool) -> Iterator[list[np.ndarray]]:
        """The columns, in order of keys, and the counts."""
        if self.held and (all_of_it or self.size > _HELD_ROWS // 2):
            self._merge()
            if all_of_it or self.size > _HELD_ROWS // 2:
                columns, self.held, self.size = self.held[0], [], 0
                yield columns


def _word_counts(texts: DataFrame) -> DataFrame:
    def rows(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000].view(np.int64)) for c in columns], ["key", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sums, tokens = _Sums(), Tokens()
        for b in small_batches(batches, "text"):
            h, _ = tokens.of(b.column(0))
            sums.add(h[h != np.uint64(tokens.start)])
            for columns in sums.out(False):
                yield from rows(columns)
        for columns in sums.out(True):
            yield from rows(columns)

    return texts.mapInArrow(run, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c"))


class Numbers:
    """Frequent tokens by their place in a list; every other token stays its hash, which is no place in the list."""

    def __init__(self, listed: np.ndarray):
        self.listed = listed
        self.places = np.argsort(listed).astype(np.uint32)
        self.ordered = listed[self.places]

    @classmethod
    def most_frequent(cls, words: DataFrame, least: int, table: int = TABLE) -> Numbers:
        """At most about ``table`` words seen ``least`` times or more, the most frequent first, and the start."""
        low = max(least, count_bound(words.filter(F.col("c") >= least), table))
        # A hash that could be taken for a place in the list is in the list itself.
        rows = words.filter((F.col("c") >= low) | F.col("key").between(0, 2 * table)).toArrow()
        keys = np.asarray(rows.column("key"), dtype=np.int64).view(np.uint64)
        order = np.argsort(-np.asarray(rows.column("c"), dtype=np.int64), kind="stable")
        return cls(np.append(np.uint64(Tokens().start), keys[order]))

    def of(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.listed):
            return tokens
        at = np.minimum(np.searchsorted(self.ordered, tokens), len(self.ordered) - 1)
        return np.where(self.ordered[at] == tokens, self.places[at].astype(np.uint64), tokens)

    def tokens(self, numbers: np.ndarray) -> np.ndarray:
        out, small = numbers.copy(), numbers < np.uint64(len(self.listed))
        out[small] = self.listed[numbers[small].astype(np.intp)]
        return out


def packed(columns: np.ndarray) -> bytes:
    """Rows of unsigned numbers, the first of them rising, as differences and bytes of equal weight side by side."""
    steps = columns.copy()
    steps[0, 1:] = columns[0, 1:] - columns[0, :-1]
    planes = steps.view(np.uint8).reshape(*steps.shape, 8).transpose(0, 2, 1)
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, columns: int, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, columns * n * 8, codec="zstd", asbytes=True), np.uint8).reshape(columns, 8, n)
    steps = planes.transpose(0, 2, 1).copy().view(np.uint64)[:, :, 0]
    np.cumsum(steps[0], out=steps[0])
    return steps


def _slices(tokens: int) -> int:
    return max(min(_SLICES, tokens // _SMALL_SLICE + 1), tokens // _LARGE_SLICE)


def _gram_counts(
    texts: DataFrame, depth: int, contexts: Bloom, shorter: Bloom, numbers: Numbers | None = None, least: int = 1, slices: int = 1, codes: tuple[str, ...] = (),
) -> DataFrame:
    """(ctx, w, c) of contexts of ``depth`` tokens with their next token, seen ``least`` times; ``shorter`` holds what the same places give one token shorter.

    ``codes`` adds the n-gram's own code (key) and that of the n-gram one token shorter (below).
    """
    context = texts.sparkSession.sparkContext
    shared = context.broadcast((contexts, shorter, numbers or Numbers(np.empty(0, np.uint64))))
    last = np.uint64((1 << 22) - 1)

    def pack(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Blocks of n-grams, a few slices at a time; a slice's keys are neighbours."""
        where = (columns[0] >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
        begins = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        ends = np.append(begins[1:], len(where))
        few = max(1, 50_000 * len(begins) // len(where))
        for i in range(0, len(begins), few):
            a, b = begins[i : i + few], ends[i : i + few]
            rows = slice(a[0], b[-1])
            parts = [*(shared.value[2].of(x[rows]) for x in columns[1:-1]), columns[-1][rows].view(np.uint64)]
            # Neighbours that share their first token take less room.
            order = np.argsort(where[rows] - where[a[0]] << np.uint64(44) | np.minimum(parts[0], last) << np.uint64(22) | np.minimum(parts[-2], last))
            table = np.stack(parts)[:, order]
            blocks = [packed(table[:, x:y]) for x, y in zip(a - a[0], b - a[0])]
            yield pa.RecordBatch.from_arrays([pa.array(where[a].astype(np.int32)), pa.array((b - a).astype(np.int32)), pa.array(blocks, pa.binary())], ["slice", "n", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sums, tokens = _Sums(), Tokens()
        known, below, _ = shared.value
        for b in small_batches(batches, "text"):
            h, _ = tokens.of(b.column(0))
            *_, before, (at, code) = [(None, None), *tokens.contexts(h, depth)]
            use = known.holds(code)
            at, code = at[use], code[use]
            if depth == 1:
                use = below.holds(h[at])
            else:
                tail = before[1][np.searchsorted(before[0], at)]
                use = below.holds(followed(tail, h[at]))
            at, code = at[use], code[use]
            if len(at):
                sums.add(followed(code, h[at]), *(h[at - back] for back in range(depth, -1, -1)))
            for columns in sums.out(False):
                yield from pack(columns)
        for columns in sums.out(True):
            yield from pack(columns)
        columns = None
        trim()

    def count(blocks: pa.Table) -> pa.Table:
        of = shared.value[2]
        *parts, often = np.concatenate([unpacked(g, depth + 2, n) for g, n in zip(blocks.column("grams").to_pylist(), blocks.column("n").to_pylist())], axis=1)
        tokens = [of.tokens(x) for x in parts]
        ctx, w = reduce(followed, tokens[:-1]), tokens[-1]
        key, first, at = np.unique(followed(ctx, w), return_index=True, return_inverse=True)
        c = np.bincount(at, weights=often).astype(np.int64)
        enough = c >= least
        first = first[enough]
        of_key = {"key": key[enough], "below": reduce(followed, [x[first] for x in tokens[1:]])}
        columns = {"ctx": ctx[first], "w": w[first], "c": c[enough]} | {name: of_key[name] for name in codes}
        return pa.table({name: x.view(np.int64) for name, x in columns.items()})

    # The tokens tell all codes: they are computed for what stays, not shuffled.
    schema = ", ".join(f"{name} bigint" for name in ("ctx", "w", "c", *codes))
    return texts.mapInArrow(run, "slice int, n int, grams binary").groupBy("slice").applyInArrow(count, schema)


def _with_rest_key(df: DataFrame) -> DataFrame:
    """``df`` with the key of what its context ``ctx`` leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            key = rest_key(np.asarray(batch.column("ctx")).view(np.uint64))
            yield batch.append_column("key", pa.array(key.view(np.int64)))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("key", T.LongType())]))


# ---- learning ---------------------------------------------------------------------
@dataclass
class Model:
    """Counts of the corpus and the tables: words (key, c), entries of the tree (key, c, value), and the kept contexts per depth."""

    tokens: int
    types: int
    words: DataFrame
    entries: DataFrame
    contexts: list[DataFrame]
    depth: int

    @property
    def root_log(self) -> float:
        return float(np.log10(self.tokens + self.types + 1))


def learn(
    training: DataFrame, text_col: str = "text", depth: int = DEPTH, least_context: int = LEAST_CONTEXT, least_next: int = LEAST_NEXT, divergence: float = DIVERGENCE,
) -> Model:
    """The tree over all training texts, in written tables."""
    texts = training.select(F.col(text_col).cast("string").alias("text"))
    words = written(_word_counts(texts), "words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    marks = Tokens()
    end, start = (int(np.uint64(x).view(np.int64)) for x in (marks.end, marks.start))
    # As often as a text ends one begins.
    begins = words.filter(F.col("key") == end).select(F.lit(start).cast("bigint").alias("key"), "c")
    contexts = words.filter(F.col("key") != end).unionByName(begins).filter(F.col("c") >= least_context)
    contexts = contexts.select(F.col("key").alias("ctx"), F.col("c").alias("total"), F.lit(None).cast("bigint").alias("suffix"))
    # No word of an n-gram that is stored occurs less often than it.
    frequent = words.filter(F.col("c") >= least_next)
    below = frequent.select("key", ((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("p"))
    shorter = frequent.select("key")
    numbers, slices, levels = Numbers.most_frequent(words, least_next), _slices(n), []
    for d in range(1, depth + 1):
        contexts = written(contexts, f"contexts{d}")
        grams = _gram_counts(texts, d, Bloom(contexts.select(F.col("ctx").alias("key"))), Bloom(shorter), numbers, least_next, slices, codes=("key", "below"))
        grams = grams.join(contexts, "ctx")
        grams = written(grams.withColumn("own", (F.col("c") - DISCOUNT) / F.col("total")), f"grams{d}")
        rests = grams.groupBy("ctx").agg((1.0 - F.sum("own")).alias("rest"))
        known = grams.join(below.select(F.col("key").alias("below"), F.col("p").alias("q")), "below").join(rests, "ctx")
        known = written(known.withColumn("p", F.col("own") + F.col("rest") * F.col("q")), f"distributions{d}")
        gain = known.groupBy("ctx", "suffix", "total", "rest").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("g"), F.greatest(1.0 - F.sum("p"), F.lit(0.0)).alias("left"))
        levels.append((known, gain.select("ctx", "suffix", "total", "rest", (F.col("g") + F.col("left") * F.log("rest") >= divergence).alias("diverges"))))
        below = known.select("key", "p")
        shorter = known.select("key")
        contexts = known.filter((F.col("c") >= least_context) & (F.col("w") != end)).select(F.col("key").alias("ctx"), F.col("c").alias("total"), F.col("below").alias("suffix"))
    entries, kept, needed = None, [], None
    for d in range(depth, 0, -1):
        known, tested = levels[d - 1]
        if needed is None:
            stays = tested.filter("diverges")
        else:
            stays = tested.join(needed.withColumn("needed", F.lit(True)), "ctx", "left").filter("diverges or needed").drop("needed")
        stays = written(stays.drop("diverges"), f"stays{d}")
        needed = stays.select(F.col("suffix").alias("ctx")).distinct()
        rests = _with_rest_key(stays.select("ctx", F.col("total").alias("c"), F.log10("rest").alias("value"))).select("key", "c", "value")
        adds = known.join(stays.select("ctx"), "ctx", "left_semi").select("key", "c", (F.log10("p") - F.log10("q") - F.log10("rest")).alias("value"))
        both = rests.unionByName(adds)
        entries = both if entries is None else entries.unionByName(both)
        kept.insert(0, stays)
    return Model(int(n), int(v), words, written(entries, "entries"), kept, depth)


# ---- scoring ----------------------------------------------------------------------
class _Table:
    """Keys and numbers, sorted for look-ups."""

    def __init__(self, rows: pa.Table, number: str):
        key = np.asarray(rows.column("key"), dtype=np.int64).view(np.uint64)
        order = np.argsort(key)
        self.keys, self.numbers = key[order], np.asarray(rows.column(number), dtype=np.float64)[order]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, 0 where there is none; whether there is one)."""
        if not len(self.keys):
            return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        return np.where(hit, self.numbers[at], 0.0), hit


def _tree_keys(tokens: Tokens, h: np.ndarray, depth: int, held: Bloom) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of every context and n-gram of the texts that the tree may hold.

    A context is looked for only where its suffix may be held, an n-gram only
    where the shorter one may be.
    """
    places, keys = [], []
    open_ctx = open_gram = None
    for at, code in tokens.contexts(h, depth):
        if open_ctx is not None:
            at, code = at[open_ctx[at]], code[open_ctx[at]]
        key = rest_key(code)
        use = held.holds(key)
        at, code = at[use], code[use]
        places.append(at)
        keys.append(key[use])
        gram, spots = followed(code, h[at]), at
        if open_gram is not None:
            gram, spots = gram[open_gram[spots]], spots[open_gram[spots]]
        stored = held.holds(gram)
        places.append(spots[stored])
        keys.append(gram[stored])
        open_ctx, open_gram = np.zeros(len(h), bool), np.zeros(len(h), bool)
        open_ctx[at], open_gram[spots[stored]] = True, True
    return np.concatenate(places), np.concatenate(keys)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", table: int = TABLE) -> DataFrame:
    """The columns of ``docs`` but the text, with n_tokens, n_known, train_tokens, base_score and score."""
    low_word, low_entry = count_bound(model.words, table), count_bound(model.entries, table)
    top = lambda df, low: df.filter(F.col("c") >= low).toArrow()
    context = docs.sparkSession.sparkContext
    words = _Table(top(model.words.select("key", "c", F.log10(F.col("c") + 1.0).alias("value")), low_word), "value")
    entries = _Table(top(model.entries, low_entry), "value")
    rare, cold = model.words.filter(F.col("c") < low_word), model.entries.filter(F.col("c") < low_entry)
    cold_any = not cold.isEmpty()
    shared = context.broadcast((words, entries, Bloom(model.entries.select("key"))))
    root, depth = model.root_log, model.depth
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        of_words, of_tree, held = shared.value
        tokens = Tokens()
        for b in small_batches(batches, "text"):
            h, ends = tokens.of(b.column(1))
            n = np.diff(ends, prepend=0) - 1
            begins = ends - n - 1
            real = h != np.uint64(tokens.start)
            value, known = of_words.find(h)
            known &= real
            place, key = _tree_keys(tokens, h, depth, held)
            own, hit = of_tree.find(key)
            row = np.searchsorted(ends, place, "right")
            extra = np.bincount(row[hit], weights=own[hit], minlength=len(ends))
            sums = lambda x: np.add.reduceat(x, begins)
            base = sums(np.where(known, value, 0.0)) - n * root
            late = np.flatnonzero(~hit) if cold_any else np.empty(0, np.intp)
            late = late[np.argsort(row[late], kind="stable")]
            unknown = np.flatnonzero(real & ~known)
            lists = []
            for keys, owner in ((h[unknown], np.searchsorted(ends, unknown, "right")), (key[late], row[late])):
                offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=len(ends)))).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(sums(known.astype(np.int64))), pa.array(base), pa.array(base + extra), *lists], ["row", "n", "known", "base", "total", "unknown", "late"])

    numbered = docs.select("*", F.monotonically_increasing_id().alias("_row"))
    # The row number ties a text's partial score to its own columns; both are taken from one written scan.
    parts = numbered.select(F.struct("_row", *rest).alias("row"), F.col(text_col).cast("string").alias("text"))
    long, double, keys = T.LongType(), T.DoubleType(), T.ArrayType(T.LongType())
    kinds = {"n": long, "known": long, "base": double, "total": double, "unknown": keys, "late": keys}
    schema = T.StructType([T.StructField("row", parts.schema["row"].dataType), *(T.StructField(c, t) for c, t in kinds.items())])
    scored = written(parts.mapInArrow(run, schema).select(F.col("row._row").alias("_row"), F.struct(*(F.col("row").getField(c).alias(c) for c in rest)).alias("own"), *kinds), "scored")
    met = scored.select("_row", F.explode("unknown").alias("key")).join(rare, "key").groupBy("_row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count(F.lit(1)).alias("met"))
    out = scored.join(met, "_row", "left")
    if cold_any:
        cool = scored.select("_row", F.explode("late").alias("key")).groupBy("_row", "key").agg(F.count(F.lit(1)).alias("often"))
        out = out.join(cool.join(cold, "key").groupBy("_row").agg(F.sum(F.col("often") * F.col("value")).alias("cool")), "_row", "left")
    more, cool = F.coalesce("more", F.lit(0.0)), F.coalesce("cool", F.lit(0.0)) if cold_any else F.lit(0.0)
    return out.select(
        "own.*", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("total") + more + cool).alias("score"),
    )


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, table: int = TABLE, **options) -> DataFrame:
    """Learns from all folds but one and scores every row."""
    held = bucket(F.col(id_col), folds) == held_fold
    model = learn(docs.filter(~held), text_col, **options)
    return score(docs.select(id_col, held.alias("held_out"), text_col), model, id_col, text_col, table)
