"""Phrases, page texts and token alignment against brute-force readings of their rules, with odd rows."""

import collections
import hashlib
import html as refs
import random
import re
import time

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_operators import ODD, docs_of
from waymark.llm import align, html_text, phrases


# ---- 11 phrases ---------------------------------------------------------------------------
def test_transducer_holds_what_it_is_made_of():
    rng = np.random.default_rng(0)
    for k in (1, 2, 3, 5):
        drawn = rng.integers(0, 7 if k > 1 else 1000, (3000, k)).astype(np.uint64)
        grams, weights = phrases.united([(drawn, np.ones(3000, np.int64))])
        t = phrases.Transducer.load(phrases.Transducer.of(grams, weights).dump())
        assert (t.grams() == grams).all() and (t.weights == weights).all() and weights.sum() == 3000
        assert (t.places(grams) == np.arange(len(grams))).all()
        asked = rng.integers(0, 9, (500, k)).astype(np.uint64)
        known = {tuple(g): i for i, g in enumerate(grams.tolist())}
        assert t.places(asked).tolist() == [known.get(tuple(a), -1) for a in asked.tolist()]
        heavy = t.heavy(3)
        assert (heavy.grams() == grams[weights >= 3]).all()
    # Equal endings are one state.
    grams = np.array([[a, b] for a in range(50) for b in range(20)], np.uint64)
    assert len(phrases.Transducer.of(grams, np.arange(1000)).label[1]) == 20
    empty = phrases.Transducer.load(phrases.Transducer.of(np.empty((0, 2), np.uint64), np.empty(0, np.int64)).dump())
    assert len(empty.grams()) == 0 and empty.places(asked[:, :2]).max() == -1


def plain_phrases(rows, least, top):
    count, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    count[lang, tuple(ws[i : i + k])] += 1
    often = {p: a for p, a in count.items() if len(p[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in often.items():
        if any(x == lang and len(q) > len(p) and f >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), f in often.items()):
            continue
        score, k = min((1000 * a * n[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return {(lang, i): (p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)}


def test_phrases(spark):
    rng = random.Random(9)
    base = "The big red dog, the big red cat; New York City is big. new york\tcity hall é\x0bà é à".split(" ")
    made = lambda: " ".join(rng.choice(base) if rng.random() < 0.3 else " ".join(base[(j := rng.randrange(len(base) - 4)) : j + 4]) for _ in range(rng.randrange(1, 20)))
    rows = [(i, made(), rng.choice(["en", "en", "en", "fr", None]), "s") for i in range(250)] + [(1000, "same words here again " * 400, "en", "s")] + ODD
    df = docs_of(spark, rows).withColumn("rank", F.lit("x")).withColumn("symbol", F.lit(0)).repartition(5)
    for least, top, tokens in ((8, 2000, 2_000_000), (5, 7, 200)):
        want = plain_phrases([(r[1], r[2]) for r in rows], least, top)
        got = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in phrases.mine(df, least=least, top=top, range_tokens=tokens).collect()}
        assert got == want and len(want) > 10


def test_phrases_of_nothing(spark):
    assert phrases.mine(docs_of(spark, [])).count() == 0
    assert phrases.mine(docs_of(spark, ODD)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


# ---- 12 page texts -----------------------------------------------------------------------------
MIXED = """<html><body class="has-sidebar"><header><h1>Site</h1><p>Welcome, all of you, to this site.</p></header><div id="menu"><ul><li><a href=/>Home</a></ul></div>
<div class=wrap><div class=cookie-notice>We use cookies, and more. Accept?</div><h1>Big title</h1><p>First paragraph, with some text. It goes on &amp; on.<p>Second one &lt;here&gt;, longer;
 and better: yes!<div class="share-buttons"><a>Share</a></div><ul><li>One item<li>Two <b>bold</b>&nbsp;items</ul><p>Last.</p></div>
<div class="comments"><p>Great article, thanks. I liked it very much, really.</p></div><form><p>Name, please.</p></form><script>var x="<p>a</p>";</script><footer>&copy; 2020 All, rights.</footer>"""


def test_article_without_what_is_around_it():
    assert html_text.main_text(MIXED) == "Big title\nFirst paragraph, with some text. It goes on & on.\nSecond one <here>, longer; and better: yes!\nOne item\nTwo bold items\nLast."
    assert html_text.main_text("<article><header><h1>T</h1><p>By X</p></header><p>a<script>b</script>c <br>d<p>x &#8364; y</article><aside>q</aside>") == "T\na\nc d\nx € y"
    main = "<main><div class=sidebar><p>Side, one.</p></div><article><p>Text, here.</p><section class='related posts'><p>More, text.</p></section></article></main><p>After, all.</p>"
    assert html_text.main_text(main) == "Text, here."


def test_paths_without_names_are_told_by_their_ratios():
    links = "".join(f"<td><a href='/{i}'>Link number {i}</a></td>" for i in range(30))
    body = "".join(f"<div><p>Sentence {i}, with a clause; and an end. Then another one, as long as this.</p></div>" for i in range(8))
    page = f"<body><table><tr>{links}</tr></table><h2>Heading</h2>{body}<table><tr><td>x</td><td>{links}</td></tr></table>"
    got = html_text.main_text(page)
    assert got.startswith("Heading\nSentence 0") and got.endswith("as long as this.") and "Link" not in got and got.count("\n") == 8


def test_markup_of_any_kind_is_read_in_linear_time():
    assert html_text.main_text("x < y, z") == "x < y, z" and html_text.main_text("<!-- a -->t<!-- b") == "t" and html_text.main_text("<nav>x</nav>") == ""
    start = time.process_time()
    for bad in ("<div>", "<a '\">", "<", "<!--", "<p>x", "<li><a href='x'>y</a>", "<script>", "</p>", "<div>x", "<b>", "&amp;", "<span hidden>x"):
        html_text.main_text(bad * 60_000 + "x")
    assert time.process_time() - start < 60


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x")).withColumn("_html", F.lit(2))
    odd = [(None, None, None), (9001, "u", ""), (9002, "u", "<p></p>"), (9003, "u", "plain words, no tags"), (9003, "u", "plain words, no tags")]
    df = pages.unionByName(spark.createDataFrame([(*r, 1, "x", 2) for r in odd], pages.select("page_id", "url", "html", "text", "n_chars", "_html").schema))
    got = collections.defaultdict(list)
    for r in html_text.extract(df).collect():
        got[r["page_id"]].append((r["url"], r["text"], r["n_chars"]))
    for r in pages.collect():
        article = re.search("(?s)<article>(.*?)</article>", r["html"])[1]
        blocks = (" ".join(refs.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]] == [(r["url"], want, len(want))]
    assert got[None] == [(None, "", 0)] and got[9001] == got[9002] == [("u", "", 0)] and got[9003] == [("u", "plain words, no tags", 20)] * 2
    assert html_text.extract(df.limit(0)).count() == 0


# ---- 13 alignment -----------------------------------------------------------------------------------
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Alignment of one text by comparing every token's bytes."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.letters = align.byte_letters()

    def of(self, text):
        if not text:
            return None
        e, ids = self.a.encode(" " + text, add_special_tokens=False), self.b.encode(text)
        sides = [(e.ids, [bytes(self.letters[c] for c in t) for t in e.tokens])]
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        sides.append((ids, [piece(i) for i in ids]))
        if any(b"".join(t) != (" " + text).encode() for _, t in sides):
            return None
        spans = [[(i, end - len(t), end) for i, t, end in zip(ids, ts, np.cumsum([len(t) for t in ts]).tolist())] for ids, ts in sides]
        cuts = sorted({s[2] for s in spans[0]} & {s[2] for s in spans[1]})
        group = lambda side, low, high: ",".join(str(i) for i, _, end in spans[side] if low < end <= high)
        groups = [f"{group(0, low, high)}|{group(1, low, high)}" for low, high in zip([0, *cuts], cuts)]
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        return len(spans[0]), len(spans[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def test_alignment(spark):
    rng = random.Random(13)
    pieces = ["the", "Überraschung", "naïve café", "\n\n", "  ", "\t", "12345", "<|endoftext|>", "</s>", "I'll", "日本語", "é́ﬁ", "𝒳", "x" * 30, "\x00"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))), "en", "s") for i in range(120)]
    rows += [(500, "▁ spelled otherwise", "en", "s"), (501, "long " * 700 + "end", "en", "s"), (3, "an id again", "en", "s"), (502, " ", "en", "s")] + ODD
    plain = Plain()
    want = [(r[0], plain.of(r[1])) for r in rows]
    count = collections.Counter(x for _, w in want if w for x in w[3])
    high = collections.Counter()
    for (_, b), c in count.items():
        high[b] = max(high[b], c)
    told = []
    for i, w in want:
        if w is None:
            told.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            told.append((i, w[0], w[1], w[2], len(w[3]), sum(count[x] == high[x[1]] for x in w[3]), sum(count[x] for x in w[3]), w[4]))
    assert sum(t[7] == "" for t in told) >= 3 and any(t[4] > t[3] for t in told)
    df = docs_of(spark, rows).withColumn("pair", F.lit(1)).withColumn("n_a", F.lit("x")).repartition(3)
    for lane, table in ((2_048, 1 << 20), (7, 50), (64, 0)):
        got = [tuple(r) for r in align.align(df, A, B, lane=lane, table_pairs=table).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
        assert sorted(got, key=str) == sorted(told, key=str)


def test_lanes_do_not_change_the_links():
    rng = np.random.default_rng(2)
    ends_a, ends_b = [], []
    for _ in range(30):
        n = int(rng.integers(1, 400))
        for ends in (ends_a, ends_b):
            ends.append(np.unique(np.append(rng.integers(1, n + 1, n // 2 + 1), n)))
    results = [align.merge(ends_a, ends_b, lane) for lane in (1, 13, 10_000)]
    sets = [(set(zip(r[0].tolist(), r[1].tolist())), set(zip(r[2].tolist(), r[3].tolist()))) for r in results]
    assert sets[0] == sets[1] == sets[2] and all(len(r[0]) == len(s[0]) for r, s in zip(results, sets))


def test_alignment_of_nothing(spark):
    assert align.align(docs_of(spark, []), A, B).count() == 0
    assert {r["n_a"] for r in align.align(docs_of(spark, [(1, None, "en", "s")]), A, B).collect()} == {0}
