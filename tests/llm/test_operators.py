"""Every operator against a brute-force reading of its rule, with odd rows."""

import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymark.llm import bpe, chat, common, langid, minhash, mixing, secrets, suffix_lm, vector_dedup, vp_search, warc

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, id long, key string, size int, text_hash long, cuts int"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "k", 2, 3, 4) for r in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % vocabulary)


ODD = [(None, "no id here", "en", "s"), (90000, None, None, None), (90001, "", "en", None), (90002, " \n\t ", "en", "s"), (90003, "one", "en", "s"), (90004, "é" * 40, "fr", "s")]


# ---- shared ----------------------------------------------------------------------------
def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2040)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = union_find(edges, {n for e in edges for n in e})
    assert all(got.get(n, n) == c for n, c in want.items()) and set(got) <= set(want)


def test_no_edges(spark):
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---- 1 chat ------------------------------------------------------------------------------
def test_chat_round_trip_and_machine(spark):
    nasty = "a\\b <|im_end|>\n<|im_start|>assistant\n \\| \\n <\\| <<||"
    turns = [
        (1, 0, "user", nasty), (1, 1, "assistant", nasty), (2, 0, "assistant", "x"), (3, 0, "system", None), (3, 1, "user", ""), (3, 2, "assistant", "é😀"),
        (4, 0, "us\\er\n<|", "t"), (5, None, None, None), (None, 1, "user", "u"), (None, 1, "user", "u"), (6, 0, "user", "u"), (6, 1, "user", "v"),
    ]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    made = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.digest(made).collect()}
    segments = {r["conv_id"]: r for r in made.collect()}
    by_chat = collections.defaultdict(list)
    for c, turn, role, text in turns:
        by_chat[c].append((turn is not None, turn, role or "", text or ""))
    for c, own in by_chat.items():
        own.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        learned = "".join(t for _, _, r, t in own if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r["formatted_chars"] == len(segments[c]["formatted"]) == sum(len(s["text"]) for s in segments[c]["segments"])
        assert segments[c]["formatted"].count("<|") == 2 * len(own)
    assert {c: segments[c]["first_fault"] for c in by_chat} == {1: None, 2: 0, 3: None, 4: 0, 5: 0, None: 1, 6: 1}


def test_chat_of_nothing(spark):
    assert chat.digest(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# ---- 2 mixing ----------------------------------------------------------------------------
def test_flight_keeps_both_sums():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 40, 700):
        size = np.sort(rng.lognormal(5, 1.5, n).astype(int))[::-1]
        p = rng.random(n)
        q = mixing.fly(p, size, np.random.default_rng(n), False)
        assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs(q @ size - p @ size) < 1e-3
        assert set(mixing.fly(p, size, np.random.default_rng(n), True)) <= {0.0, 1.0}


def test_flight_is_fair():
    size = np.array([90, 40, 30, 20, 9, 5, 2, 1])
    mean = sum(mixing.fly(np.full(8, 0.3), size, np.random.default_rng(i), True) for i in range(3000)) / 3000
    assert np.abs(mean - 0.3).max() < 0.04


def test_mixture(spark):
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, int(rng.integers(1, 120))), "en", f"s{min(i % 7, 3)}" if i % 50 else None) for i in range(1500)] + [(3000 + i, "tiny words", "en", "s9") for i in range(3)] + ODD
    df = docs_of(spark, rows)
    got = mixing.report(df, block=100).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.report(df, block=100).collect()))
    source = collections.Counter()
    for _, text, _, s in rows:
        source[s] += len(words(text))
    names = sorted(s for s in source if s is not None) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        level = (sum(source.values()) - sum(3 * source[s] for s in names if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 3 * source[s]}
        if not over:
            break
        free -= over
    target = {s: level * weight[s] if s in free else 3 * source[s] for s in names}
    by_id = {r[0]: (len(words(r[1])), r[3]) for r in rows}
    taken = collections.Counter()
    for r in got:
        size, s = by_id[r["doc_id"]]
        assert r["size"] == size and r["source_size"] == source[s] and r["target"] == pytest.approx(target[s]) and r["taken"] <= 3 * size and r["taken"] % max(size, 1) == 0
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(4, 0.02 * target[s]) for s in names)
    drawn = collections.Counter(r["doc_id"] for r in mixing.take(df, block=100).collect())
    assert drawn == +collections.Counter({r["doc_id"]: r["copies"] for r in got})


def test_mixture_deals_out_what_repeats_drew(spark):
    rng = np.random.default_rng(8)
    rows = [(7, "one row that repeats", "en", "hot")] * 2003 + [(None, "no id", "en", None)] * 50 + [(7, "one row that repeats", "en", "b")] * 3
    rows += [(100 + i, prose(rng, 20), "en", f"s{i % 5}") for i in range(300)]
    df = docs_of(spark, rows).repartition(5)
    got = mixing.report(df, block=100).collect()
    drawn, target = collections.Counter(), {r["source_size"]: r["target"] for r in got}
    for r in got:
        drawn[r["doc_id"]] += r["copies"]
    assert len(got) == len(rows)
    hot = [r["copies"] for r in got if r["source_size"] == 4 * 2003]
    assert len(hot) == 2003 and max(hot) - min(hot) == 1 and abs(sum(hot) * 4 - target[4 * 2003]) <= 4
    taken = collections.Counter((r["doc_id"], r["source"]) for r in mixing.take(df, block=100).collect())
    assert taken[7, "hot"] == sum(hot) and collections.Counter({i: sum(n for (j, _), n in taken.items() if j == i) for i in {j for j, _ in taken}}) == +drawn


def test_mixture_of_nothing(spark):
    assert mixing.report(docs_of(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.report(docs_of(spark, [(1, None, None, None)])).collect()] == [0]


# ---- 3 BPE -------------------------------------------------------------------------------
def test_bpe_against_the_library(spark):
    path = public_tokenizers.path(bpe_name := "word_bpe_49k.json")
    assert bpe_name in path
    tok = Tokenizer.from_file(path)
    shared = "Shared passage, with É and 12 numbers; it's long enough to be cut. " * 60
    texts = [
        "", None, "   ", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>", "x" * 9000, "it's DON'T é İstanbul K ſ 日本語 \x1c a\x85b　c q\xa0r", shared, "tail " + shared + "head",
        "퟿\U0001f600" * 500, "stop.,. ,.. a., b.c.", "word\n\n\n\tword", "ΑΣ Σ",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode(df, path, tuple(bpe._OUT)).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        assert got[i]["token_ids"] == ids and got[i]["n_tokens"] == len(ids) and got[i]["decoded"] == decoded, t
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_chunks_are_cut_by_content_and_reused():
    rng = random.Random(1)
    body = " ".join(str(rng.random()) for _ in range(2000)).encode()
    one, two = (set(), set())
    for found, data in ((one, b"abc " + body), (two, body + b" tail")):
        start = 0
        for end in bpe.cuts(data):
            found.add(data[start:end])
            start = end
        assert start == len(data)
    assert len(one & two) > 0.9 * len(one) > 10
    codec = bpe.Codec(open(public_tokenizers.path("word_bpe_49k.json")).read())
    codec.encode([body.decode()])
    codec.encode(["x " + body.decode()])
    assert codec.reused > 0.9 * codec.encoded


def test_tokenizer_that_keeps_white_space_is_refused():
    with pytest.raises(ValueError):
        bpe.Codec(open(public_tokenizers.path("byte_bpe_50k.json")).read())


# ---- 4 suffix tree -----------------------------------------------------------------------
def suffix_tree(texts, depth, least_context, least_next, divergence):
    """The tree from plain dictionaries: (kept contexts with what they leave, probabilities per context, root)."""
    lists = [["<s>", *words(t), "</s>"] for t in texts]
    count = collections.Counter(w for ws in lists for w in ws[1:])
    total = sum(count.values()) + len(count) + 1
    root = lambda w: (count[w] + 1) / total
    grams, size = collections.defaultdict(collections.Counter), collections.Counter()
    for ws in lists:
        for i in range(1, len(ws)):
            for d in range(1, min(depth, i) + 1):
                grams[tuple(ws[i - d : i])][ws[i]] += 1
                size[tuple(ws[i - d : i])] += 1
    p, rest, gain = {}, {}, {}
    for c in sorted(size, key=len):
        stored = {w: n for w, n in grams[c].items() if n >= least_next}
        if size[c] < least_context or not stored:
            continue
        below = {w: (root(w) if len(c) == 1 else p[c[1:]][w]) for w in stored}
        rest[c] = 1 - sum(n - 0.5 for n in stored.values()) / size[c]
        p[c] = {w: (n - 0.5) / size[c] + rest[c] * below[w] for w, n in stored.items()}
        gain[c] = sum(q * math.log(q / below[w]) for w, q in p[c].items()) + max(0, 1 - sum(p[c].values())) * math.log(rest[c])
    kept = {c for c in rest if gain[c] >= divergence}
    kept |= {c[i:] for c in kept for i in range(1, len(c))}
    return kept, rest, p, root


def tree_score(tree, text, depth):
    kept, rest, p, root = tree
    ws, out = ["<s>", *words(text), "</s>"], 0.0
    for i in range(1, len(ws)):
        c = next((tuple(ws[i - d : i]) for d in range(min(depth, i), 0, -1) if tuple(ws[i - d : i]) in kept), ())
        while c and ws[i] not in p[c]:
            out += math.log10(rest[c])
            c = c[1:]
        out += math.log10(p[c][ws[i]] if c else root(ws[i]))
    return out


PATTERN = "the big red dog ran home and the small cat sat down"


def learned_from(r):
    return r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2


def test_hashes_of_tokens_are_those_of_their_words():
    texts = [None, "", " ", "A  b\x0bB a\n", "ab ba", "é É \x1c 1\x852", "x" * 33 + " " + "X" * 33 + " " + "x" * 32, "ab" * 400 + " " + "ba" * 400]
    h, ends = suffix_lm.Tokens().of(pa.array(texts, pa.string()))
    token, seen, begin = suffix_lm.Tokens(), {}, 0
    for t, end in zip(texts, ends):
        ws = common.words_of(t)
        assert end - begin == len(ws) + 2 and (h[begin], h[end - 1]) == (token.start, token.end)
        assert all(seen.setdefault(w, x) == x for w, x in zip(ws, h[begin + 1 : end - 1].tolist()))
        begin = end
    assert len(set(seen.values())) == len(seen)


def test_pairs_are_shuffled_without_their_key(spark):
    words = spark.createDataFrame([(1,)], "key bigint")
    grams = suffix_lm._gram_counts(spark.createDataFrame([("a b",)], "text string"), 1, suffix_lm.Bloom(words), suffix_lm.Bloom(words))
    assert grams.columns == ["ctx", "w", "c"] and grams.count() == 0


def test_ngrams_are_counted_from_packed_slices(spark):
    rng = np.random.default_rng(14)
    texts = [prose(rng, 200, 40) for _ in range(60)] + [None, "", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    h, ends = suffix_lm.Tokens().of(pa.array(texts, pa.string()))
    code, tokens = suffix_lm.followed, suffix_lm.Tokens()
    words = spark.createDataFrame([(int(x),) for x in set(h.view(np.int64).tolist())], "key bigint")
    everything = suffix_lm.Bloom(words)
    everything.words[:] = np.uint64(2**64 - 1)
    frequent = [np.uint64(x) for x, _ in collections.Counter(h.tolist()).most_common()]
    for depth in (1, 3):
        want = collections.Counter()
        for at, context in tokens.contexts(h, depth):
            grams = list(zip(context.tolist(), h[at].tolist()))
        want.update(grams)
        for listed, slices, least in ((0, 1, 1), (7, 5, 1), (len(frequent), 900, 3)):
            numbers = suffix_lm.Numbers(np.array(frequent[:listed], np.uint64))
            got = suffix_lm._gram_counts(df, depth, everything, everything, numbers, least, slices).collect()
            assert {(r["ctx"] % 2**64, r["w"] % 2**64): r["c"] for r in got} == {k: c for k, c in want.items() if c >= least}
            assert len(got) == sum(c >= least for c in want.values())
    more = suffix_lm._gram_counts(df, 3, everything, everything, codes=("key", "below")).collect()
    shorter = {(c, w) for at, context in tokens.contexts(h, 2) for c, w in zip(context.tolist(), h[at].tolist())}
    shorter = set(code(*(np.array(x, np.uint64) for x in zip(*shorter))).view(np.int64).tolist())
    pairs = [np.array([r[x] for r in more], np.int64).view(np.uint64) for x in ("ctx", "w", "key")]
    assert more and np.array_equal(code(pairs[0], pairs[1]), pairs[2]) and {r["below"] for r in more} <= shorter


def test_packed_ngrams_take_few_bytes():
    rng = np.random.default_rng(15)
    n = 5_000
    rows = np.stack([np.sort(rng.zipf(1.2, n) % 2**17), rng.zipf(1.2, n) % 2**20, rng.geometric(0.8, n)]).astype(np.uint64)
    assert len(suffix_lm.packed(rows)) < 5 * n
    odd = np.array([[0, 3, 2**64 - 1], [2**64 - 1, 0, 2**63], [1, 2**40, 1]], np.uint64)
    for x in (rows, odd, odd[:, :1]):
        assert np.array_equal(suffix_lm.unpacked(suffix_lm.packed(x), *x.shape), x)


def test_numbers_of_tokens_are_no_hashes_of_others(spark):
    words = spark.createDataFrame([(3, 1), (-5, 90), (2**62, 80), (2**61, 70), (2**60, 2)], "key bigint, c bigint")
    numbers = suffix_lm.Numbers.most_frequent(words, 20, table=2)
    start = suffix_lm.Tokens().start
    tokens = np.array([2**64 - 5, 2**62, 2**61, 2**60, 3, start], np.uint64)
    assert numbers.listed.tolist() == [start, 2**64 - 5, 2**62, 3]
    assert numbers.of(tokens).tolist() == [1, 2, 2**61, 2**60, 3, 0]
    assert np.array_equal(numbers.tokens(numbers.of(tokens)), tokens)


def test_scores_are_those_of_a_plain_suffix_tree(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"{PATTERN if i % 3 else ''} {prose(rng, int(rng.integers(0, 90)))} {PATTERN}", "en", "s") for i in range(400)] + ODD + [(5007, "the The THE", "en", "s")] * 3
    train = [r[1] for r in rows if learned_from(r)]
    count = collections.Counter(w for t in train for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    tree = suffix_tree(train, 3, 60, 5, 0.01)
    assert {len(c) for c in tree[0]} == {1, 2, 3} and any("<s>" in c for c in tree[0])
    for table in (1 << 20, 40, 0):
        got = collections.defaultdict(list)
        for r in suffix_lm.score_corpus(docs_of(spark, rows).repartition(3), table=table, least_context=60, least_next=5).collect():
            got[r["doc_id"]].append(r)
        assert sum(map(len, got.values())) == len(rows)
        for r in rows:
            tokens, g = [*words(r[1]), None], got[r[0]][0]
            assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(tokens), sum(count[w] > 0 for w in tokens), n)
            assert g["held_out"] == (not learned_from(r))
            assert g["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens))
            assert g["score"] == pytest.approx(tree_score(tree, r[1], 3))


def test_contexts_are_distributions_and_help():
    rng = np.random.default_rng(6)
    texts = [f"{PATTERN} {prose(rng, 20, 60)} {PATTERN}" for _ in range(300)]
    kept, rest, p, root = tree = suffix_tree(texts, 3, 50, 5, 0.01)
    types = {w for t in texts for w in words(t)} | {"</s>"}
    for c in sorted(kept)[:60]:
        total = sum(_chance(tree, c, w) for w in types)
        assert total + _chance(tree, c, "never seen") == pytest.approx(1)
    assert sum(tree_score(tree, t, 3) for t in texts) > 0.8 * sum(math.log10(root(w)) for t in texts for w in [*words(t), "</s>"])


def _chance(tree, c, w):
    kept, rest, p, root = tree
    out = 1.0
    while c and w not in p[c]:
        out, c = out * rest[c], c[1:]
    return out * (p[c][w] if c else root(w))


def test_the_tree_grows_with_the_corpus(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, prose(rng, 60, 300)) for i in range(300)], "doc_id long, text string")
    small, large = (suffix_lm.learn(x, least_context=60, least_next=5) for x in (df, df.union(df).union(df)))
    assert large.tokens == 3 * small.tokens and large.types == small.types
    for a, b in zip(small.contexts, large.contexts):
        assert a.count() < b.count()
    assert 3 * small.entries.count() < large.entries.count()


def test_nothing_to_learn(spark):
    (r,) = suffix_lm.score_corpus(docs_of(spark, [(3, "a b", "en", "s")]).filter("doc_id > 0"), folds=1, held_fold=0).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)
    assert suffix_lm.score_corpus(docs_of(spark, [])).count() == 0


# ---- 5 and 7 vectors ---------------------------------------------------------------------
def vectors_of(spark, x, more=()):
    rows = [(i, [float(y) for y in v], 1) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *more], "vec_id long, embedding array<float>, label int")


ODD_VECTORS = [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 8, 1), (9003, [1.0, None, *[0.0] * 6], 1), (9004, [float("nan")] * 8, 1), (9005, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (9006, [1.0, 2.0], 1)]


def clustered(seed, n=600, d=8):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(40, d))
    x = centers[rng.integers(40, size=n)] + rng.normal(size=(n, d)) * rng.choice([0.02, 0.2, 0.6], size=(n, 1))
    x[:60] = x[0]
    return x.astype(np.float32).astype(float)


def test_near_vectors(spark):
    x = clustered(1)
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(vectors_of(spark, x, ODD_VECTORS), tile=64).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T >= 0.95
    np.fill_diagonal(c, False)
    root = union_find(zip(*map(lambda a: a.tolist(), np.nonzero(c))), range(len(x)))
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (int(c[i].sum()), root[i], root[i] == i)
    for i in [v[0] for v in ODD_VECTORS]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert len(got) == len(x) + len(ODD_VECTORS)


def test_nearest(spark):
    x = clustered(2)
    got = collections.defaultdict(list)
    for r in vp_search.nearest(vectors_of(spark, x, ODD_VECTORS), F.col("vec_id") % 20 == 0, k=7, shard_rows=100, query_rows=20, leaf=8).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, len(x), 20))
    for q, found in got.items():
        exact = [float(np.einsum("i,i->", x[q], v)) for v in x]
        want = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-exact[i], i))[:7]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 8)) and [f[2] for f in found] == pytest.approx([exact[i] for i in want])
        assert [f[1] for f in found] == want or sorted(round(exact[f[1]], 9) for f in found) == sorted(round(exact[i], 9) for i in want)


def test_relaxed_search_keeps_most(spark):
    x = clustered(3)
    found = vp_search.nearest(vectors_of(spark, x), F.col("vec_id") % 20 == 0, k=5, factor=1.3, shard_rows=300, leaf=8).collect()
    exact = {(q, int(i)) for q in range(0, len(x), 20) for i in [i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:5]}
    assert len({(r["query_id"], r["vec_id"]) for r in found} & exact) > 0.8 * len(exact)


def test_no_vectors(spark):
    none = vectors_of(spark, [])
    assert vector_dedup.near_duplicates(none).count() == 0 and vp_search.nearest(none, F.col("vec_id") % 20 == 0).count() == 0


# ---- 6 language ID -----------------------------------------------------------------------
def test_language(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(*r, 0) for r in ODD] + [(90005, "123 +++ 4½", "en", "s", 0), (90006, "漢字", None, "s", 0)], df.schema)
    truth = {r["doc_id"]: r["lang"] for r in df.collect()}
    got = {r["doc_id"]: r for r in langid.identify(df.union(odd)).collect()}
    right = [got[i]["lang_pred"] == truth[i] for i in truth if got[i]["held_out"]]
    assert len(right) > 100 and sum(right) / len(right) > 0.98
    for i, r in got.items():
        assert r["held_out"] == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    assert [got[i]["lang_pred"] for i in (90000, 90001, 90002, 90005)] == ["und"] * 4 and got[90006]["lang_pred"] in set(truth.values())


def plain_language_scores(rows, most_words, most_grams):
    """(language, score) per text by the rule, from plain counters over all labelled rows."""
    letters = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    docs = collections.Counter(lang for _, lang in rows)
    langs, counts = sorted(docs), {}
    for text, lang in rows:
        for w in letters(text):
            counts.setdefault((0, w), collections.Counter())[lang] += 1
            for n in (4, 3, 2, 1):
                for g in langid.grams(w, n):
                    counts.setdefault((n, g), collections.Counter())[lang] += 1

    def kept(grams, most):
        # The bound is a count that at most ``most`` entries reach, in steps of a 16th of an octave.
        mine = {k: c for k, c in counts.items() if (k[0] > 0) == grams}
        step = lambda k: int(math.floor(math.log2(sum(mine[k].values())) * 16))
        by_step, out = collections.defaultdict(list), []
        for k in mine:
            by_step[step(k)].append(k)
        for b in sorted(by_step, reverse=True):
            if len(out) + len(by_step[b]) > most:
                break
            out += by_step[b]
        return out

    table = {k: counts[k] for k in kept(False, most_words) + kept(True, most_grams)}
    totals = collections.Counter()
    for (n, _), c in table.items():
        for lang in langs:
            totals[n, lang] += c[lang] + 0.5
    log = lambda k: np.array([math.log((table[k][x] + 0.5) / totals[k[0], x]) for x in langs])

    def of(text):
        found = letters(text or "")
        if not found:
            return "und", 0.0
        total = np.array([math.log(docs[x] / len(rows)) for x in langs])
        for w in found:
            if (0, w) in table:
                total = total + log((0, w))
                continue
            for n in (4, 3, 2, 1):
                known = [log((n, g)) for g in langid.grams(w, n) if (n, g) in table]
                if known:
                    total = total + np.mean(known, axis=0)
                    break
        odds = np.exp(total - total.max())
        return langs[int(odds.argmax())], float(odds.max() / odds.sum())

    return of


def test_language_scores_are_those_of_plain_counters(spark):
    rng = random.Random(12)
    sound = {"aa": "abeilnorstu", "bb": "aeghknmrtuz", "cc": "aeiloprsvzq", "rare": "xyzwq"}
    made = lambda lang: " ".join("".join(rng.choice(sound[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 25)))
    rows = [(i, made(lang), lang) for i, lang in enumerate(["aa"] * 300 + ["bb"] * 80 + ["cc"] * 20 + ["rare"])]
    df = spark.createDataFrame([(*r, 9.0, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string").repartition(4)
    for entries in (10_000, 300):
        of = plain_language_scores([(t, lang) for _, t, lang in rows], entries, entries)
        found = langid.predict(df, langid.fit(df, max_entries=entries))
        assert sorted(found.columns) == sorted(df.columns)
        for r in found.collect():
            lang, score = of(r["text"])
            assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-3)


def test_language_sample_is_about_its_bound_and_all_languages_are_learned(spark):
    rows = [(i, f"w{i % 50} of a", "en") for i in range(3000)] + [(5000 + i, "ein wort", "de") for i in range(7)] + [(9000, "une fois", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df, sample_docs=100).langs == ["de", "en", "fr"] and langid.fit(df, max_langs=2).langs == ["de", "en"]
    few = langid.fit(df, sample_docs=10, max_cells=6)
    assert all(len(k) <= 2 for n, k in few.known.items() if n == 0)


def test_language_of_nothing(spark):
    assert langid.identify(docs_of(spark, [])).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs_of(spark, [(1, "some words", None, "s")])).collect()} == {"und"}


def test_back_off_takes_the_longest_known_order():
    model = langid.Model(["a", "b"], np.zeros(2), {0: (["known"], np.array([[0.0, -9.0]], np.float32)), 2: (["_z"], np.array([[-5.0, 0.0]], np.float32)), 1: (["q"], np.array([[0.0, -5.0]], np.float32))})
    assert model.predict(["known", "zq", "q", "x", "!"])[0] == ["a", "b", "a", "a", "und"]


# ---- 8 secrets ---------------------------------------------------------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)), collections.Counter(k for _, k, _ in out)


def test_secrets(spark):
    live, example = "Zx9-live_0Token7qwErty12", "Ex4mple_C0py_Ab3dEf9hIjK"
    rows = [
        (1, f"é😀 {live} and token={live}, Secret\" : 'abcdef", "en", "a"), (2, f"see {live}", "en", "a"), (3, "token=abcdef " * 2000 + "AKIA" + "Z" * 16, "en", "a"),
        (4, "password=ab password='abcdefg apikey:token=abcdefgh api_KEY  =  zzzzzz", "en", "b"), (5, "AKIAAKIA12 AKIA" + "A1" * 9 + " " + "0f" * 12 + "f" + " deadbeef", "en", None),
        *[(10 + i, f"copied {example} everywhere", "en", f"o{i}") for i in range(4)], (20, f"prefix-{live}", "en", "c"), (20, "a second row of one id", "en", "c"), *ODD,
    ]
    df = docs_of(spark, rows)
    got = collections.defaultdict(list)
    for r in secrets.report(df).collect():
        got[r["doc_id"]].append(r)
    for i, text, _, _ in rows:
        spelled, count = base_spans(text)
        match = [r for r in got[i] if r["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()]
        assert match and all((r["n_assign"], r["n_access"], r["n_hex"]) == (count[0], count[1], count[2]) for r in match), i
        assert set(spelled.split(",")) <= set(match[0]["spans"].split(",")) or not spelled
    assert got[2][0]["spans"] == f"owned:4:{4 + len(live)}" and "owned" not in got[10][0]["spans"] and got[10][0]["n_example"] == 1
    assert sum(len(r) for r in got.values()) == len(rows)
    cleaned = {(r["doc_id"], r["text"]) for r in secrets.redact(df).collect()}
    assert (2, "see [secret]") in cleaned and (10, f"copied {example} everywhere") in cleaned and (20, "a second row of one id") in cleaned and (90000, None) in cleaned
    assert (1, "é😀 [secret] and [secret], [secret]") in cleaned and secrets.redact(df).columns == df.columns and secrets.redact(df).count() == len(rows)


def test_examples_need_repositories_and_owners(spark):
    pasted, example, copied = "Pa5ted_Cr3dential-0xYzAbQ", "Ex4mple_C0py_Ab3dEf9hIjK", "H0tSource-B0ilerplate_Zq7"
    rows = [(i, f"here token={pasted}", "en", f"s{i}") for i in range(3)] + [(10 + i, f"password={example}", "en", f"s{i % 3}") for i in range(6)]
    rows += [(100 + i, f"see {copied} {i}", "en", "hot") for i in range(2000)]
    rows += [(None, f"by hand token={pasted[::-1]} {i % 4}", "en", f"s{i % 3}") for i in range(12)]
    df = docs_of(spark, rows)
    got = collections.defaultdict(list)
    for r in secrets.report(df).collect():
        got[r["doc_id"]].append(r)
    assert all((r["n_live"], r["n_example"], r["owners"], r["repos"]) == (0, 0, "3", "3") for i in range(3) for r in got[i])
    assert all((r["owners"], r["repos"]) == ("3", "6") and r["n_example"] > 0 for i in range(10, 16) for r in got[i])
    assert all((r["spans"], r["owners"], r["repos"], r["n_live"]) == ("", "", "", 0) for i in range(100, 2100) for r in got[i])
    assert all((r["owners"], r["repos"]) == ("3", "4") for r in got[None]) and len(got[None]) == 12
    cleaned = collections.defaultdict(set)
    for r in secrets.redact(df).collect():
        cleaned[r["doc_id"]].add(r["text"])
    assert all(cleaned[i] == {"here [secret]"} for i in range(3)) and all(cleaned[10 + i] == {f"password={example}"} for i in range(6))


def test_secrets_of_nothing(spark):
    assert secrets.report(docs_of(spark, [])).count() == 0


def test_prefix_sums(spark):
    for n in (1, 2, 255, 256, 257, 1000):
        values = [i % 7 for i in range(n)]
        (r,) = spark.createDataFrame([(values,)], "v array<int>").select(secrets.starts_before(F.col("v")).alias("s")).collect()
        assert r["s"] == [sum(values[:i]) for i in range(n)]


# ---- 9 near copies -----------------------------------------------------------------------
def brute_components(rows, k, percent):
    sets = collections.defaultdict(list)
    for i, text in rows:
        w = words(text)
        sets[i].append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    flat = [(i, s) for i, of in sets.items() if i is not None for s in of if s]
    pairs = [(a, b) for n, (a, s) in enumerate(flat) for b, t in flat[:n] if a != b and (100 + percent) * len(s & t) >= percent * (len(s) + len(t))]
    return sets, union_find(pairs, [i for i in sets if i is not None])


@pytest.mark.parametrize("k", [2, 5])
def test_near_copies(spark, k):
    rng = np.random.default_rng(k)
    base = [prose(rng, 120, 2000).split() for _ in range(6)]
    rows = []
    for i in range(420):
        w = list(base[i % 6])
        for at in rng.integers(len(w), size=int(rng.integers(0, 28) ** 1.2) if i > 30 else 0):
            w[at] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(w[: len(w) - int(rng.integers(0, 9))])))
    rows += [(500 + i, prose(rng, int(rng.integers(1, 30)))) for i in range(60)] + [r[:2] for r in ODD] + [(700, "one"), (701, "ONE"), (702, rows[3][1]), (702, rows[8][1]), (702, rows[8][1])]
    got = collections.defaultdict(set)
    out = minhash.near_duplicates(docs_of(spark, [(*r, "en", "s") for r in rows]), shingle_words=k).collect()
    assert len(out) == len(rows)
    for r in out:
        got[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
    sets, root = brute_components(rows, k, 80)
    for i, of in sets.items():
        assert got[i] == {(len(s), root.get(i), i is None or root[i] == i) for s in of}, i
    assert 3 < len(set(root.values())) < len(root) - 50


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    common_part, rest = rng.integers(2**63, size=600, dtype=np.uint64), rng.integers(2**63, size=(2, 200), dtype=np.uint64)
    a, b = (np.unique(np.concatenate([common_part, r])) for r in rest)
    s = minhash.super_minhash([a, b, a[:3]])
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.1 and np.isfinite(s).all() and (np.floor(s[2]) < 256).all()


def test_near_copies_of_nothing(spark):
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


# ---- 10 WARC -----------------------------------------------------------------------------
PAGES = [(1, "http://b.example/x?q=1", "<p>é</p>"), (2, "http://a.example/", "<p>é</p>"), (3, None, None), (4, "http://a.example/\r\nX: y", ""), (5, "http://a.example:81/WARC/1.1", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (None, "not a url", "<p>é</p>"), (2, "http://a.example/", "<p>é</p>"), (7, "http://[bad", "z" * 50_000)]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, keeper string").repartition(3)
    got = warc.round_trip(df, min_revisit_bytes=least).collect()
    assert [(r["urlkey"], r["ts"]) for r in got] == sorted((r["urlkey"], r["ts"]) for r in got) and len(got) == len(PAGES)
    keeper = {}
    for i, _, html in PAGES:
        if i is not None and len((html or "").encode()) >= least:
            keeper[html or ""] = max(i, keeper.get(html or "", i))
    import base64

    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        first = keeper.get(html or "")
        again = first is not None and i != first
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)


def test_warc_bytes_and_damage(spark, tmp_path):
    path = warc.write_archives(spark.createDataFrame(PAGES[:2], "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("*.gz")))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n") and data.count(b"WARC/1.1\r\n") == 2 and path
    with pytest.raises(ValueError):
        list(warc.parse(data.replace("<p>é".encode(), b"<p>xx"), "a"))


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
