"""Filling in order: searched jumps against one item after the other, in one text and over rows."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from waymark.functions.text import SPACES
from waymark.operators import corpus, packing, reports


def one_by_one(texts, forced, sep, cap, small=None, trim=True):
    """Groups as a plain loop makes them; with ``small`` the rule for small chunks."""
    out = []
    for t, begins in zip(texts, forced):
        grown = f"{out[-1]}{sep}{t}" if out else None
        if grown is not None and trim and small is None:
            grown = grown.strip(SPACES)
        fits = grown is not None and (len(grown) <= cap if small is None else len(t) < small and len(out[-1]) + len(t) <= cap)
        if fits and not begins:
            out[-1] = grown
        else:
            out.append(t)
    return out


def texts_of(rng, n, longest):
    return [" " * rng.choice((0, 0, 0, 2)) + "x" * rng.randrange(1, longest) + " " * rng.choice((0, 0, 1)) for _ in range(n)]


def test_jumps_fill_as_a_loop_does():
    rng = random.Random(1)
    for case in range(300):
        texts = texts_of(rng, rng.randrange(0, 60), rng.choice((3, 12, 40)))
        forced = [rng.random() < 0.1 for _ in texts]
        cap = rng.randrange(10, 60)
        assert packing.filled(texts, forced, " ", cap, SPACES) == one_by_one(texts, forced, " ", cap)
        plain = [t.strip() for t in texts]
        assert packing.small_joined(plain, "\n\n", 15, cap) == one_by_one(plain, [False] * len(plain), "\n\n", cap, 15)


def test_sections_of_any_shape():
    rng = random.Random(2)
    for _ in range(60):
        body = "".join(rng.choice(("낱말 ", "끝다. ", "음 ", "\n", "\n\n", "x" * 950, "y" * 300, "요 ")) for _ in range(rng.randrange(0, 60))).strip()
        chunks = corpus.packed(body)
        assert "".join("".join(chunks).split()) == "".join(body.split()) and all(c and len(c) < 1100 for c in chunks)
    assert corpus.packed("") == [] and corpus.packed("a") == ["a"] and corpus.packed("a\n\nb") == ["a\n\nb"]
    assert [len(c) for c in corpus.packed("x" * 2000)] == [900, 900, 200] and [len(c) for c in corpus.packed("x" * 1990)] == [900, 900 + 2 + 190]


def test_rows_fill_as_one_text_does(spark):
    rng = random.Random(3)
    lists = {"hot": texts_of(rng, 3000, 30), "b": texts_of(rng, 5, 30), "same": ["y" * 9] * 400, None: texts_of(rng, 40, 8), "one": ["z"]}
    rows = [(k, i, t, rng.random() < 0.02, "extra") for k, ts in lists.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "k string, i int, text string, begins boolean, no string").repartition(7)
    for cap in (31, 200, 4000):
        got = {}
        for r in packing.pack_rows(df, ["k"], ["i"], "text", " ", cap, forced=F.col("begins"), spaces=SPACES).collect():
            got.setdefault(r["k"], {})[r["no"]] = r["text"]
        for k, ts in lists.items():
            want = packing.filled(ts, [b for kk, _, _, b, _ in rows if kk == k], " ", cap, SPACES)
            assert [got[k][i] for i in range(len(got[k]))] == want
    small = packing.pack_rows(df, ["k"], ["i"], "text", "--", 40, small=12).collect()
    for k, ts in lists.items():
        assert [r["text"] for r in sorted((r for r in small if r["k"] == k), key=lambda r: r["no"])] == packing.small_joined(ts, "--", 12, 40)
    assert packing.pack_rows(df.limit(0), ["k"], ["i"], "text", " ", 40).count() == 0


def test_lists_match_one_packed_text(spark):
    rng = random.Random(4)
    made = lambda: " ".join(rng.choice(("물건", "상점다. ", "설명요 ", "끝", "w" * 40)) for _ in range(rng.randrange(1, 12)))
    lists = {"long": [made() for _ in range(300)], "short": [made() for _ in range(3)], "wide": ["v" * 2000 + " x", "tail", "q" * 700 + "다. " + "r" * 100], "gap": ["a", "", "b\nc"]}
    df = spark.createDataFrame([(k, i, t) for k, ts in lists.items() for i, t in enumerate(ts)], "k string, i int, t string").repartition(5)
    got = {}
    for r in corpus.table_chunks(df, ["k"], "i", F.concat(F.lit("- "), "t"), F.concat(F.lit("n="), F.count(F.lit(1)).cast("string")), "s").collect():
        got.setdefault(r["k"], {})[r["chunk_no"]] = r["content"]
    for k, ts in lists.items():
        body = "\n".join([f"n={len(ts)}", *(f"- {t}" for t in ts)])
        assert [got[k][i] for i in range(len(got[k]))] == corpus.packed(body), k


def test_a_list_of_a_hundred_megabytes(spark):
    lines = spark.range(1_000_000).select("id", F.concat(F.lpad(F.col("id").cast("string"), 7, "0"), F.repeat(F.lit("x"), 91)).alias("t"))
    chunks = corpus.table_chunks(lines, [], "id", F.col("t"), F.lit("head"), "s")
    n, longest, chars, first = chunks.agg(F.count(F.lit(1)), F.max(F.length("content")), F.sum(F.length(F.regexp_replace("content", r"\s", ""))), F.min_by("content", "chunk_no")).first()
    # Nine lines of 98 characters and their blanks fit into 900, also behind the head; the lone last line joins the chunk before.
    assert (n, longest, chars) == (111_111, 990, 4 + 98_000_000) and first.startswith("head 0000000x")


def test_names_of_a_long_list_are_cut_into_texts(spark):
    rows = spark.range(200).select(F.col("id").alias("ord"), F.format_string("name%03d", "id").alias("name"), F.lit("active").alias("status"), F.lit(True).alias("region_limited"), F.lit("a").alias("kind"))
    got = sorted(reports.region_limited_names(rows, "kind").collect(), key=lambda r: r["no"])
    assert ", ".join(r["names"] for r in got) == ", ".join(f"name{i:03d}" for i in range(200)) and [len(r["names"]) for r in got] == [898, 898]


def test_longest_prefixes(spark):
    from waymark.operators.prefixes import longest_prefix

    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    keys = {word(rng.randrange(1, 9)) for _ in range(60)} | {"z" * n for n in (2, 10, 500)} | {"가나", "가나다"}
    names = [word(rng.randrange(1, 14)) for _ in range(400)] + ["z" * 1000, "z" * 500, "가나다라", "가나다", "q"]
    known = spark.createDataFrame([(k, k.upper()) for k in keys], "key string, standard string")
    got = {r["nk"]: (r["key"], r["standard"]) for r in longest_prefix(spark.createDataFrame([(n,) for n in names * 2], "nk string").repartition(5), known).collect()}
    want = {}
    for n in names:
        best = max((k for k in keys if 2 <= len(k) < len(n) and n.startswith(k)), key=len, default=None)
        if best and len(n) > 2:
            want[n] = (best, best.upper())
    assert got == want and got["z" * 1000][0] == "z" * 500
    assert longest_prefix(spark.createDataFrame([], "nk string"), known).count() == 0


def test_chunks_leave_in_bounded_batches():
    text = "# head\n" + "\n\n".join("word " * 100 + str(i) for i in range(20))
    texts = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": [text] * 1000})
    fields = {"sec_no": "integer", "section": "string", "chunk_no": "integer", "content": "string"}
    out = list(corpus.bounded_rows(iter([texts]), corpus.chunks_of, fields))
    assert max(b.nbytes for b in out) < 1.2 * corpus.TEXT_BYTES
    made = list(corpus.chunks_of(text))
    assert [(r["doc_id"], r["chunk_no"], r["content"]) for b in out for r in b.to_pylist()] == [(i, n, c) for i in range(1000) for _, _, n, c in made]


def test_documents_are_chunked_in_one_python_step(spark, capsys):
    docs = spark.createDataFrame([(1, "# a\nx\n## b\n"), (2, None), (3, "y")], "doc_id int, text string")
    chunks = corpus.chunk_documents(docs)
    assert [tuple(r) for r in chunks.orderBy("doc_id").collect()] == [(1, 0, "a", 0, "x"), (3, 0, "", 0, "y")]
    chunks.explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
