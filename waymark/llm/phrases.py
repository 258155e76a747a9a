"""Phrase collocation mining with weighted acyclic automata (operator 11).

Per language, phrases of 2 to 5 words that occur ``least`` times or more are
scored by the weakest of their cuts into two parts; phrases inside a longer one
that is (nearly) as frequent are dropped; the best ``top`` of each language stay.

1. Words are counted in Spark.  A word of a language is a 64-bit symbol.
2. For 2, 3, … words, each shard sorts its n-grams in runs and adds run after run
   to a count transducer: an acyclic automaton over symbols, minimal in its
   states, whose paths number the n-grams in order; the counts stand in that
   order.  Only n-grams whose two parts of one word less are frequent are taken
   (a Bloom filter of bounded size says so, what it lets through beside them is
   pruned in 3).
3. A shard's transducer is cut at prefix ranges and the pieces are shuffled.  Each
   range unites its pieces, adding weights, and keeps what is frequent.  Ranges
   are even in symbols and split inside words so frequent that they would fill
   one, so no prefix holds more than its share.
4. The parts of each range's phrases, each part once, are sent to the range that
   holds them and composed with its transducer; the counts come back to the range
   that asked.  Scores are exact decimals.

A longer phrase is at most as frequent as what it contains, so a phrase is dropped
exactly if one that is one word longer has the needed count; those are found among
the answers (``keep`` 100 asks for equal counts; a smaller share is looked up over
all longer phrases alike, since a part of a part is at least as frequent).

Exactness rests on 64-bit hashes telling words apart.  Nulls and odd rows: a null
text has no words; a null language is ``und``; ids and other columns are not read;
rows that repeat count each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import GOLDEN, WordHashes, mix, small_batches, written

UNKNOWN = "und"
MOST_WORDS, LEAST, TOP = 5, 100, 2_000
RUN_ROWS, SHARD_ROWS, RANGE_TOKENS = 300_000, 1_200_000, 2_000_000
#: The filter of frequent n-grams grows with them up to this many bits (16 MB).
BLOOM_BITS = 1 << 27
_ODD = np.uint64(0xD6E8FEB86659FD93)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_BREAK = b"\n"


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words, and a line feed between pieces."""
    if not text:
        return []
    return [w for w in text.encode("utf-8").translate(_LOWER).replace(_BREAK, b" \n ").split(b" ") if w]


class Symbols:
    """Symbols of many texts in a row, and the piece each word lies in."""

    def __init__(self):
        self.hashes = WordHashes()
        self.langs: dict[str, np.uint64] = {}
        self.pause = np.uint64(xxhash.xxh3_64_intdigest(_BREAK))

    def of(self, langs: list[str | None], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words: list[bytes] = []
        sizes, keys = [], []
        for lang, text in zip(langs, texts):
            found = tokens(text)
            words += found
            words.append(_BREAK)
            sizes.append(len(found) + 1)
            keys.append(self.lang(lang))
        h = self.hashes.of(words)
        is_break = h == self.pause
        symbols = mix(h ^ np.repeat(np.array(keys, np.uint64), sizes))
        piece = np.cumsum(is_break)
        return symbols[~is_break], piece[~is_break]

    def lang(self, lang: str | None) -> np.uint64:
        lang = UNKNOWN if lang is None else lang
        if lang not in self.langs:
            self.langs[lang] = mix(np.array([xxhash.xxh3_64_intdigest(lang.encode(), seed=7)], np.uint64))[0]
        return self.langs[lang]


def codes(symbols: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit code of the k symbols from each place on."""
    code = symbols
    for j in range(1, k):
        code = mix(code[:-1] * _ODD + symbols[j:])
    return code


class Transducer:
    """Counts of sorted n-grams of one length: layers of states, transitions by symbol, counts in path order."""

    def __init__(self, first: list[np.ndarray], label: list[np.ndarray], target: list[np.ndarray], skip: list[np.ndarray], weights: np.ndarray):
        self.first, self.label, self.target, self.skip, self.weights = first, label, target, skip, weights

    @staticmethod
    def of(grams: np.ndarray, weights: np.ndarray) -> Transducer:
        """From distinct rows in order.  States are made from the last word back; those with equal transitions are one."""
        n, k = grams.shape
        fresh = np.zeros(n, bool)
        fresh[:1] = True
        starts = []
        for d in range(k):
            fresh[1:] |= grams[1:, d] != grams[:-1, d]
            starts.append(np.flatnonzero(fresh))
        first, label, target, skip = ([None] * k for _ in range(4))
        classes, paths = np.zeros(n, np.int64), np.ones(1, np.int64)
        for d in range(k - 1, -1, -1):
            begin = np.searchsorted(starts[d], starts[d - 1]) if d else np.zeros(min(n, 1), np.int64)
            count = np.diff(np.append(begin, len(starts[d])))
            symbol = grams[starts[d], d]
            classes, kept, of = _merged(symbol, classes, begin, count)
            width = count[kept]
            take = np.repeat(begin[kept] - np.cumsum(width) + width, width) + np.arange(width.sum())
            label[d], target[d] = symbol[take], of[take]
            ahead = paths[target[d]]
            total = np.cumsum(ahead)
            first[d] = np.append(0, np.cumsum(width))
            before = (total - ahead)[first[d][:-1]] if len(width) else np.zeros(0, np.int64)
            skip[d] = total - ahead - np.repeat(before, width)
            paths = np.add.reduceat(ahead, first[d][:-1]) if len(width) else np.zeros(0, np.int64)
        return Transducer(first, label, target, skip, np.asarray(weights, np.int64))

    def grams(self) -> np.ndarray:
        """The n-grams, in order."""
        state, columns = np.zeros(min(len(self.weights), 1), np.int64), []
        for d in range(len(self.first)):
            width = self.first[d][state + 1] - self.first[d][state]
            at = np.repeat(self.first[d][state] - np.cumsum(width) + width, width) + np.arange(width.sum())
            columns = [np.repeat(c, width) for c in columns] + [self.label[d][at]]
            state = self.target[d][at]
        return np.stack(columns, axis=1) if len(self.weights) else np.empty((0, len(self.first)), np.uint64)

    def places(self, asked: np.ndarray) -> np.ndarray:
        """Composition with the n-grams asked for: the place of each among this one's paths, or -1."""
        state, place, live = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), np.full(len(asked), len(self.weights) > 0)
        for d in range(asked.shape[1] if len(self.weights) else 0):
            low, high = self.first[d][state], self.first[d][state + 1]
            end, want, label = high, asked[:, d], self.label[d]
            while (low < high).any():
                mid = (low + high) >> 1
                less = label[np.minimum(mid, len(label) - 1)] < want
                low, high = np.where(less & (low < high), mid + 1, low), np.where(less | (low >= high), high, mid)
            at = np.minimum(low, len(label) - 1)
            live &= (low < end) & (label[at] == want)
            state = np.where(live, self.target[d][at], 0)
            place += np.where(live, self.skip[d][at], 0)
        return np.where(live, place, -1)

    def heavy(self, least: int) -> Transducer:
        keep = self.weights >= least
        return self if keep.all() else Transducer.of(self.grams()[keep], self.weights[keep])

    def dump(self) -> bytes:
        parts = [np.array([len(self.first), len(self.weights), *(len(f) for f in self.first), *(len(x) for x in self.label)], np.int64), self.weights]
        for d in range(len(self.first)):
            parts += [self.first[d].astype(np.int64), self.label[d], self.target[d].astype(np.int32), self.skip[d].astype(np.int32)]
        return b"".join(p.tobytes() for p in parts)

    @staticmethod
    def load(blob: bytes) -> Transducer:
        k, n = np.frombuffer(blob, np.int64, 2).tolist()
        sizes = np.frombuffer(blob, np.int64, 2 * k, 16).tolist()
        at = 16 + 16 * k

        def read(kind: type, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        weights = read(np.int64, n)
        layers = [(read(np.int64, sizes[d]), read(np.uint64, sizes[k + d]), read(np.int32, sizes[k + d]), read(np.int32, sizes[k + d])) for d in range(k)]
        first, label, target, skip = (list(x) for x in zip(*layers))
        return Transducer(first, label, [t.astype(np.int64) for t in target], [s.astype(np.int64) for s in skip], weights)


def _merged(symbol: np.ndarray, target: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each state, states that stand for a class, each transition's target) for states with these transitions."""
    if not len(begin):
        return begin, begin, target
    mark = np.add.reduceat(mix(symbol ^ mix(target.astype(np.uint64) * GOLDEN + _ODD)), begin)
    _, kept, classes = np.unique(mark, return_index=True, return_inverse=True)
    # Equal marks are checked on the transitions themselves; where one differs nothing is merged.
    like = begin[kept][classes]
    same = np.array_equal(count, count[kept][classes])
    if same:
        other = np.repeat(like - begin, count) + np.arange(len(symbol))
        same = np.array_equal(symbol, symbol[other]) and np.array_equal(target, target[other])
    if not same:
        kept = classes = np.arange(len(begin))
    return classes, kept, target


def united(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order with added weights."""
    grams, weights = np.concatenate([g for g, _ in parts]), np.concatenate([w for _, w in parts])
    order = np.lexsort(grams.T[::-1])
    grams, weights = grams[order], weights[order]
    fresh = np.append(True, (grams[1:] != grams[:-1]).any(axis=1))[: len(grams)]
    return grams[fresh], np.add.reduceat(weights, np.flatnonzero(fresh)) if len(grams) else weights


class Ranges:
    """Prefix ranges: bounds over the first two symbols."""

    def __init__(self, tokens_in_all: int, frequent: DataFrame, range_tokens: int):
        n = max(8, -(-tokens_in_all // range_tokens))
        bounds = {(i * (1 << 64) // n, 0) for i in range(n)}
        # At most n words fill a range or more.
        for r in frequent.filter(F.col("c") * n >= max(tokens_in_all, 1)).select("symbol", "c").collect():
            s, m = r["symbol"] % (1 << 64), -(-r["c"] * n // tokens_in_all)
            bounds |= {(s, j * (1 << 64) // m) for j in range(m)} | {((s + 1) % (1 << 64), 0)}
        self.one, self.two = (np.array(x, np.uint64) for x in zip(*sorted(bounds)))

    def cut(self, grams: np.ndarray) -> np.ndarray:
        """Where each range begins in rows that are in order."""
        low, high = (np.searchsorted(grams[:, 0], self.one, side) for side in ("left", "right"))
        if grams.shape[1] == 1:
            return np.where(self.two > 0, high, low)
        return np.array([a + np.searchsorted(grams[a:b, 1], t) for a, b, t in zip(low, high, self.two)], np.int64)

    def split(self, grams: np.ndarray) -> Iterator[tuple[int, slice]]:
        cuts = np.append(self.cut(grams), len(grams))
        for i in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            yield i, slice(int(cuts[i]), int(cuts[i + 1]))


class Bloom:
    """Codes of frequent n-grams, or a few more; two bits each."""

    def __init__(self, code: DataFrame):
        n = code.count()
        self.bits = min(BLOOM_BITS, 1 << max(16, (n * 16).bit_length()))
        c = F.col("code")
        spots = code.select(F.explode(F.array(c.bitwiseAND(self.bits - 1), F.shiftrightunsigned(c, 37).bitwiseAND(self.bits - 1))).alias("spot"))
        words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("set")).toArrow()
        self.words = np.zeros(self.bits >> 6, np.int64)
        self.words[np.asarray(words.column("word"), dtype=np.int64)] = np.asarray(words.column("set"), dtype=np.int64)
        self.words = self.words.view(np.uint64)

    def holds(self, code: np.ndarray) -> np.ndarray:
        held = np.ones(len(code), bool)
        for spot in (code & np.uint64(self.bits - 1), code >> np.uint64(37) & np.uint64(self.bits - 1)):
            held &= (self.words[(spot >> np.uint64(6)).astype(np.intp)] >> (spot & np.uint64(63)) & np.uint64(1)) == 1
        return held


def _word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, symbol, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        symbols, seen = Symbols(), {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in seen.items():
                words = list(counts)
                marks = mix(symbols.hashes.of(words) ^ symbols.lang(lang)).view(np.int64)
                for i in range(0, len(words), 100_000):
                    some = words[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array(marks[i : i + 100_000]), pa.array([counts[w] for w in some], pa.int64())], ["lang", "word", "symbol", "c"]
                    )
            seen.clear()

        for b in small_batches(batches, "text"):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(tokens(text))
            for counts in seen.values():
                counts.pop(_BREAK, None)
            if sum(map(len, seen.values())) > 300_000:
                yield from out()
        yield from out()

    return texts.mapInArrow(run, "lang string, word string, symbol bigint, c bigint").groupBy("lang", "word", "symbol").agg(F.sum("c").alias("c"))


def _shards(k: int, shared_ranges, shared_bloom):
    """Count transducers of one shard's n-grams, cut at the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        symbols, ranges, bloom = Symbols(), shared_ranges.value, shared_bloom.value
        held: Transducer | None = None
        runs, waiting = [], 0

        def add() -> None:
            nonlocal held, runs, waiting
            if runs:
                held = Transducer.of(*united(runs + ([(held.grams(), held.weights)] if held else [])))
            runs, waiting = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held is not None:
                grams, weights = held.grams(), held.weights
                for i, part in ranges.split(grams):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([Transducer.of(grams[part], weights[part]).dump()], pa.binary())], ["range", "blob"])
            held = None

        for b in small_batches(batches, "text"):
            s, piece = symbols.of(b.column(0).to_pylist(), b.column(1).to_pylist())
            if len(s) < k:
                continue
            shorter = bloom.holds(codes(s, k - 1))
            use = np.flatnonzero((piece[k - 1 :] == piece[: len(s) - k + 1]) & shorter[:-1] & shorter[1:])
            if not len(use):
                continue
            _, at, often = np.unique(codes(s, k)[use], return_index=True, return_counts=True)
            runs.append((np.stack([s[use[at] + j] for j in range(k)], axis=1), often))
            waiting += len(at)
            if waiting > RUN_ROWS:
                add()
                if len(held.weights) > SHARD_ROWS:
                    yield from out()
        add()
        yield from out()

    return run


def _range_union(least: int):
    """One range's transducer from its pieces: weights added, rare n-grams pruned; with the codes of what stays."""

    def run(key: tuple, pieces: pa.Table) -> pa.Table:
        parts = [Transducer.load(b) for b in pieces.column("blob").to_pylist()]
        grams, weights = united([(p.grams(), p.weights) for p in parts])
        keep = weights >= least
        whole = Transducer.of(grams[keep], weights[keep])
        kept = grams[keep]
        code = kept[:, 0] if len(kept) else np.empty(0, np.uint64)
        for j in range(1, kept.shape[1]):
            code = mix(code * _ODD + kept[:, j])
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([whole.dump()], pa.binary()), "codes": pa.array([code.view(np.int64)], pa.list_(pa.int64()))})

    return run


def _word_ranges(shared_ranges):
    """The words' own transducer, one piece per range and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                grams, weights = united([(np.asarray(b.column(0)).view(np.uint64).reshape(-1, 1), np.asarray(b.column(1)))])
                for i, part in shared_ranges.value.split(grams):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([Transducer.of(grams[part], weights[part]).dump()], pa.binary())], ["range", "blob"])

    return run


_ASK = "range int, level int, from_level int, from_range int, parts binary"
_ANSWER = "level int, from_level int, from_range int, parts binary, counts binary, ids binary"


def _id(level: int, of_range: int, places: np.ndarray) -> np.ndarray:
    return np.int64(level << 58 | of_range << 32) + places


def _ask(shared_ranges):
    """Every part of a range's phrases, once, for the range that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for level, at, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                grams = Transducer.load(blob).grams()
                for j in range(1, level if len(grams) else 1):
                    both = np.concatenate([grams[:, :j], grams[:, level - j :]])
                    parts, _ = united([(both, np.ones(len(both), np.int64))])
                    for i, own in shared_ranges.value.split(parts):
                        yield pa.RecordBatch.from_pydict({"range": pa.array([i], pa.int32()), "level": pa.array([j], pa.int32()), "from_level": pa.array([level], pa.int32()), "from_range": pa.array([at], pa.int32()), "parts": pa.array([np.ascontiguousarray(parts[own]).tobytes()], pa.binary())})

    return run


def _answer(asked: pa.Table, held: pa.Table) -> pa.Table:
    """The asked parts composed with their range's transducers: counts, and the ids of parts that are phrases."""
    own = {level: (at, Transducer.load(blob)) for level, at, blob in zip(*(held.column(c).to_pylist() for c in ("level", "range", "blob")))}
    counts, ids = [], []
    for level, parts in zip(asked.column("level").to_pylist(), asked.column("parts").to_pylist()):
        at, transducer = own[level]
        places = transducer.places(np.frombuffer(parts, np.uint64).reshape(-1, level))
        counts.append(transducer.weights[places].tobytes())
        ids.append(_id(level, at, places).tobytes())
    return asked.select(["level", "from_level", "from_range", "parts"]).append_column("counts", pa.array(counts, pa.binary())).append_column("ids", pa.array(ids, pa.binary()))


_PHRASE = f"id bigint, m int, symbols array<bigint>, a bigint, {', '.join(f'l{k} bigint, r{k} bigint' for k in range(1, MOST_WORDS))}, drops array<bigint>"


def _with_parts(keep: int):
    """A range's phrases with the counts of the parts of every cut, and the ids of the shorter phrases they drop."""

    def run(held: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for level, at, blob in zip(*(held.column(c).to_pylist() for c in ("level", "range", "blob"))):
            whole = Transducer.load(blob)
            grams, a = whole.grams(), whole.weights
            told: dict[int, list] = {}
            for j, *columns in zip(*(answers.column(c).to_pylist() for c in ("level", "parts", "counts", "ids"))):
                told.setdefault(j, []).append((np.frombuffer(columns[0], np.uint64).reshape(-1, j), *(np.frombuffer(c, np.int64) for c in columns[1:])))
            counts, ids = {}, {}
            for j in range(1, level if len(grams) else 1):
                parts, count, name = (np.concatenate(x) for x in zip(*told[j]))
                order = np.lexsort(parts.T[::-1])
                known = Transducer.of(parts[order], count[order])
                for side, asked in (("l", grams[:, :j]), ("r", grams[:, level - j :])):
                    places = known.places(asked)
                    counts[side, j], ids[side, j] = known.weights[places], name[order][places]
            columns = {"id": _id(level, at, np.arange(len(a))), "m": np.full(len(a), level, np.int32), "symbols": list(grams.view(np.int64)), "a": a}
            for k in range(1, MOST_WORDS):
                columns[f"l{k}"], columns[f"r{k}"] = (counts[side, j] if k < level and len(a) else pa.nulls(len(a), pa.int64()) for side, j in (("l", k), ("r", level - k)))
            inside = [np.where(100 * a >= keep * counts[s, level - 1], ids[s, level - 1], -1) for s in "lr"] if level > 2 and len(a) else []
            columns["drops"] = list(np.stack(inside, axis=1)) if inside else [[]] * len(a)
            rows.append(pa.table({n: c if isinstance(c, pa.Array) else pa.array(c, pa.list_(pa.int64()) if isinstance(c, list) else None) for n, c in columns.items()}))
        return pa.concat_tables(rows)

    return run


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, most_words: int = MOST_WORDS, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score)."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = written(_word_counts(texts), "words")
    totals = written(words.groupBy("lang").agg(F.sum("c").alias("n")), "totals")
    frequent = words.filter(F.col("c") >= least)
    ranges = context.broadcast(Ranges(totals.agg(F.sum("n")).first()[0] or 0, frequent, range_tokens))
    pieces, union = "range int, blob binary", _range_union(least)
    levels, code = [], frequent.select(F.col("symbol").alias("code"))
    for k in range(1, most_words + 1):
        shards = frequent.select("symbol", "c").mapInArrow(_word_ranges(ranges), pieces) if k == 1 else texts.mapInArrow(_shards(k, ranges, context.broadcast(Bloom(code))), pieces)
        level = written(shards.groupBy("range").applyInArrow(union, "range int, blob binary, codes array<bigint>").select(F.lit(k).alias("level"), "range", "blob", "codes"), f"level{k}")
        levels.append(level.select("level", "range", "blob"))
        code = level.select(F.explode("codes").alias("code"))
    held = levels[0]
    for level in levels[1:]:
        held = held.union(level)
    phrases = held.filter("level > 1")
    asked = phrases.mapInArrow(_ask(ranges), _ASK)
    answers = written(asked.groupBy("range").cogroup(held.groupBy("range")).applyInArrow(_answer_if_asked, _ANSWER), "answers")
    by = ["level", "range"]
    own = answers.select(F.col("from_level").alias("_l"), F.col("from_range").alias("_r"), "*")
    found = written(phrases.groupBy(*by).cogroup(own.groupBy("_l", "_r")).applyInArrow(_with_parts(100), _PHRASE), "phrases")
    return _ranked(found, frequent, totals, top)


def _answer_if_asked(asked: pa.Table, held: pa.Table) -> pa.Table:
    return _answer(asked, held)


def _ranked(found: DataFrame, frequent: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    dropped = found.select(F.explode("drops").alias("id")).filter("id >= 0").distinct()
    whole = "decimal(19,0)"
    of_lang = frequent.select(F.col("symbol").alias("_s"), "lang").join(totals, "lang")
    scored = found.join(dropped, "id", "left_anti").withColumn("_s", F.col("symbols")[0]).join(of_lang, "_s")
    score = lambda k: F.expr(f"cast(cast(1000 * cast(a as {whole}) as decimal(22,0)) * cast(n as decimal(16,0)) as decimal(38,0)) div (cast(l{k} as {whole}) * cast(r{k} as {whole}))")
    cuts = [F.when(F.col("m") > k, F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, MOST_WORDS)]
    # least() skips the nulls of cuts that a phrase is too short for.
    scored = scored.select("id", "symbols", "lang", "n", "a", F.least(*cuts).alias("cut")).select("*", "cut.score", "cut.l", "cut.r").drop("cut")
    by_score = [F.desc("score"), F.desc("a")]
    near = scored.withColumn("_at", F.rank().over(Window.partitionBy("lang").orderBy(*by_score))).filter(F.col("_at") <= top).drop("_at")
    near = written(near, "near-top")
    spelled = (
        near.select("id", F.posexplode("symbols").alias("pos", "_s")).join(frequent.select(F.col("symbol").alias("_s"), "word"), "_s")
        .groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*by_score, "phrase"))
    return near.join(spelled, "id").withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
