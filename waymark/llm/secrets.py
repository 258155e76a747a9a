"""Secret scan with corpus-wide ownership frequency (operator 8), in column functions only.

Base kinds are found by fixed patterns, leftmost and without overlap per kind.
Beside them every text yields candidate tokens: long runs with letters, digits
and many different characters.  All values are hashed and counted over the whole
corpus by distinct repositories (documents) and owners (sources).  A value is a
widely copied ``example`` only with ``EXAMPLE_OWNERS`` owners or more and
``EXAMPLE_REPOS`` repositories or more: one paste per owner in a few texts is no
example.  It is ``live`` with one owner and fewer than ``WIDE_REPOS``
repositories; what one owner copies more widely, and all that lies between, is
``shared``.  Live tokens that no base span overlaps are added as kind ``owned``;
base spans stay whatever their class.

A value that a third of all texts repeat costs one counter per task before the
shuffle; its class comes back by a join that adaptive execution can split.

Nulls and odd rows: a null text is empty and has no spans; a null owner is an
owner named "".  Offsets are code points, ends exclusive.  Rows that repeat an
id are scanned each for itself and count as one repository; rows without an id
are one repository per text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.text import once
from waymark.llm.common import small_side, written

# The patterns of the base kinds, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "owned")
ASSIGN_VALUE_CHARS = 6
#: Candidate tokens of the method.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
TOKEN_DISTINCT_CHARS = 10
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 4
WIDE_REPOS = 1_000

_SPAN = "array<struct<start:int,end:int,value:string>>"


def starts_before(lengths: Column, block: int = 256) -> Column:
    """Sums of the elements before each one, in time linear in the array: sums inside blocks, then over blocks."""

    def within(values: Column, first: Column) -> Column:
        begin = F.struct(F.array().cast("array<int>").alias("a"), first.cast("int").alias("s"))
        step = lambda acc, v: F.struct(F.concat(acc["a"], F.array(acc["s"])).alias("a"), (acc["s"] + v).alias("s"))
        return F.aggregate(values, begin, step, lambda acc: acc["a"])

    def add_up(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / block).cast("int")
        return once(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * block + 1, block)), over_blocks)

    def over_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v))
        return F.flatten(F.zip_with(blocks, within(sums, F.lit(0)), within))

    return once(lengths, add_up)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value) in code points."""

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.char_length)
        return once(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("value"))), with_starts)

    def with_starts(pieces: Column) -> Column:
        total = F.transform(pieces, lambda p: p["gap"] + F.char_length(p["value"]))
        return F.zip_with(pieces, starts_before(total), span)

    def span(p: Column, before: Column) -> Column:
        start = before + p["gap"]
        return F.struct(start.alias("start"), (start + F.char_length(p["value"])).alias("end"), p["value"].alias("value"))

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m).cast(_SPAN)).otherwise(F.array().cast(_SPAN)))


#: Characters of a block of text that is cut.
BLOCK_CHARS = 1_000


def base_spans(text: Column) -> list[Column]:
    """One array of (start, end, value) per base kind."""
    whole = matches(text, ASSIGN)
    valued = F.transform(whole, lambda m: F.struct(m["start"], m["end"], F.regexp_extract(m["value"], ASSIGN, 2).alias("value")))
    return [F.filter(valued, lambda m: F.char_length(m["value"]) >= ASSIGN_VALUE_CHARS), matches(text, ACCESS), matches(text, HEX)]


def tokens(text: Column) -> Column:
    likely = lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m["value"], ""))) >= TOKEN_DISTINCT_CHARS)
    return F.filter(matches(text, TOKEN), likely)


def _kinded(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), F.sha2(m["value"], 256).alias("value_hash")))


def spell(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined; ``spans`` holds (start, kind, end)."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["text_hash"] == right["text_hash"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(texts, spans): per row its base spans; per span its class and its value's owners and repositories.

    ``texts``: id, text_hash, base (array of start, kind, end, value_hash).
    ``spans``: id, text_hash, start, kind, end, value_hash, n_owners, n_repos, class;
    kinds 0 to 2 are base, 3 is a token that no base span overlaps.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), text.alias("text"))
    arrays = base_spans(F.col("text"))
    found = written(
        plain.select("id", "owner", F.xxhash64("text").alias("text_hash"), *(_kinded(a, i).alias(f"k{i}") for i, a in enumerate([*arrays, tokens(F.col("text"))])))
        .select("id", "owner", "text_hash", F.concat("k0", "k1", "k2").alias("base"), F.col("k3").alias("tokens")), "secrets"
    )
    rows = found.filter("size(base) + size(tokens) > 0").select("id", "owner", "text_hash", F.inline(F.concat("base", "tokens")))
    # A base value is also met as a token: one value of one text counts once.
    repo = F.struct("id", F.when(F.col("id").isNull(), F.col("text_hash")))
    freq = rows.groupBy("value_hash").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct(repo).alias("n_repos"))
    example = (F.col("n_owners") >= EXAMPLE_OWNERS) & (F.col("n_repos") >= EXAMPLE_REPOS)
    live = (F.col("n_owners") == 1) & (F.col("n_repos") < WIDE_REPOS)
    label = F.when(example, "example").when(live, "live").otherwise("shared")
    known = rows.drop("owner").distinct().join(freq, "value_hash").withColumn("class", label)
    text_of = Window.partitionBy("id", "text_hash")
    is_base = F.col("kind") < 3
    before = F.max(F.when(is_base, F.col("end"))).over(text_of.orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(is_base, F.col("start"))).over(text_of.orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    spans = known.withColumn("before", before).withColumn("after", after).filter(is_base | free).drop("before", "after")
    return found.select("id", "text_hash", "base"), spans


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Per row: counts per base kind, digest of the base spans, all spans with their values' owners and repositories, and counts per class.

    ``owners`` and ``repos`` hold one number per span, comma-joined in the order of ``spans``.
    """
    texts, spans = find(docs, id_col, text_col, owner_col)
    texts = texts.withColumn("plain", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    per_text = spans.groupBy("id", "text_hash").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") < 3) | (F.col("class") == "live"), F.struct("start", "kind", "end", "n_owners", "n_repos")))).alias("all"),
        F.count_if(F.col("class") == "live").alias("n_live"), F.count_if(F.col("class") == "example").alias("n_example"),
    )
    of_kind = lambda k: F.size(F.filter("plain", lambda s: s["kind"] == k)).cast("bigint")
    listed = lambda c: F.coalesce(F.array_join(F.transform("all", lambda s: s[c].cast("string")), ","), F.lit("")).alias(c.removeprefix("n_"))
    return texts.join(per_text, _same(texts, per_text), "left").select(
        texts["id"].alias(id_col), of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        F.sha2(spell(F.col("plain")), 256).alias("base_sha256"), F.coalesce(spell(F.col("all")), F.lit("")).alias("spans"),
        listed("n_owners"), listed("n_repos"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every base or live span that is not a widely copied example replaced by ``mark``; all rows and columns stay.

    Linear in the text: what stands between the spans is taken from blocks of
    the text, so no place is counted from the text's start.
    """
    _, spans = find(docs, id_col, text_col, owner_col)
    before = Window.partitionBy("id", "text_hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    cut = spans.filter("class = 'live' or class = 'shared' and kind < 3").select("id", "text_hash", "start", "end", F.coalesce(F.max("end").over(before), F.lit(0)).alias("from"))
    gap = F.when(F.col("start") >= F.col("from"), F.struct("from", "start"))
    cuts = cut.groupBy("id", "text_hash").agg(F.array_sort(F.collect_list(gap)).alias("gaps"), F.max("end").alias("tail"))
    cuts = written(cuts.select(F.col("id").alias("__id"), F.col("text_hash").alias("__of"), F.col("gaps").alias("__gaps"), F.col("tail").alias("__tail")), "cuts")
    cuts = small_side(cuts, 4 + F.size("__gaps"))
    keyed = docs.select("*", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__hash"))
    joined = keyed.join(cuts, keyed[id_col].eqNullSafe(cuts["__id"]) & (keyed["__hash"] == cuts["__of"]), "left")
    text = F.col(text_col)

    def between(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK_CHARS)
        held = F.array_join(F.slice(blocks, (first + 1).cast("int"), (F.ceil(end / BLOCK_CHARS) - first).cast("int")), "")
        return F.substring(held, (start - first * BLOCK_CHARS + 1).cast("int"), (end - start).cast("int"))

    def cleaned(blocks: Column) -> Column:
        kept = F.transform("__gaps", lambda g: F.when(g["start"] > g["from"], between(blocks, g["from"], g["start"])).otherwise(""))
        rest = F.when(F.col("__tail") < F.char_length(text), between(blocks, F.col("__tail"), F.char_length(text))).otherwise("")
        return F.array_join(F.concat(kept, F.array(rest)), mark)

    clean = once(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0)), cleaned)
    return joined.select(*(F.when(F.col("__gaps").isNull(), text).otherwise(clean).alias(c) if c == text_col else keyed[c] for c in docs.columns))
