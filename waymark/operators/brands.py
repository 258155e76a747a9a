"""Brand detection from name statistics.

Branch names end with a mark ("… 역삼점"), so what stands before the last word
is a brand candidate.  Names written without the blank are found by the
longest known candidate they start with.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.text import lookup, name_key, or_empty, strip, without_parentheses
from waymark.operators.prefixes import longest_prefix
from waymark.session import cut_lineage, stored


def vocabulary(
    bases: DataFrame, variants: Mapping[str, str], min_count: int = fixed.VOCABULARY_MIN_COUNT
) -> DataFrame:
    """(key, standard): candidates seen often enough, plus the fixed spellings.

    ``bases`` has one row per name with a branch: (std, seq).  When two
    spellings share a key, the one that appeared later stands.
    """
    counted = bases.groupBy("std").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seen")).filter(F.col("n") >= min_count)
    learned = counted.groupBy(name_key(F.col("std")).alias("key")).agg(F.max_by("std", "seen").alias("standard"))
    if not variants:
        return learned
    spark = bases.sparkSession
    given = spark.createDataFrame(list(variants.items()), "key string, standard string").withColumn("key", name_key(F.col("key")))
    return learned.unionByName(given.join(learned, "key", "left_anti"))


def assign_bases(
    places: DataFrame,
    mark: str = fixed.BRANCH_MARK,
    variants: Mapping[str, str] = fixed.NAME_VARIANTS,
    blocked: Sequence[str] = fixed.BLOCKED_BASES,
    vocabulary_min: int = fixed.VOCABULARY_MIN_COUNT,
) -> DataFrame:
    """(id, seq, addr, base, raw, is_branch) per place: words before the branch, else prefix, else whole name.

    The forms of a name are computed once and written: four steps read them, and
    a filter on them would compute them again.
    """
    staged = stored(name_forms(places, mark, variants, blocked), "names")
    vocab = vocabulary(staged.filter("spaced_ok").select("std", "seq"), variants, vocabulary_min)
    open_names = staged.filter(~F.col("spaced_ok"))
    prefixes = longest_prefix(open_names, vocab)

    by_spaced = staged.filter("spaced_ok").select("id", "seq", "addr", "is_branch", F.col("std").alias("base"), F.col("spaced").alias("raw"))
    by_rest = open_names.join(prefixes, "nk", "left").select(
        "id", "seq", "addr", "is_branch",
        F.coalesce("standard", "whole").alias("base"), F.coalesce("key", "cn").alias("raw"),
    )
    return by_spaced.unionByName(by_rest.filter(F.col("base").isNotNull()))


def name_forms(places: DataFrame, mark: str, variants: Mapping[str, str], blocked: Sequence[str]) -> DataFrame:
    """(id, seq, addr, cn, nk, spaced, is_branch, std, spaced_ok, whole) per place; every pattern runs over a name once."""
    allowed = lambda key: ~F.col(key).isin(list(blocked))
    standard = lambda key, text: F.coalesce(lookup(F.col(key), variants), strip(F.col(text)))
    return places.select(
        "id", "seq", strip(or_empty(F.col("addr"))).alias("addr"), without_parentheses(strip(or_empty(F.col("name")))).alias("cn"),
    ).select(
        "*", F.split("cn", r"(?U)\s+").alias("_words"), name_key(F.col("cn")).alias("nk"), F.col("cn").endswith(mark).alias("is_branch"),
    ).select(
        "id", "seq", "addr", "cn", "nk", "is_branch",
        F.when((F.size("_words") >= 2) & F.element_at("_words", -1).endswith(mark), F.array_join(F.slice("_words", F.lit(1), F.size("_words") - 1), " ")).alias("spaced"),
    ).select("*", name_key(F.col("spaced")).alias("_key")).select(
        "*", standard("_key", "spaced").alias("std"), F.when((F.col("cn") != "") & allowed("nk"), standard("nk", "cn")).alias("whole"),
    ).select("*", name_key(F.col("std")).alias("_std_key")).select(
        "*", (F.col("spaced").isNotNull() & allowed("_std_key")).alias("spaced_ok"),
    ).drop("_key", "_std_key")


def candidates(
    assigned: DataFrame, min_count: int = fixed.BRAND_MIN_COUNT, min_ratio: float = fixed.BRAND_MIN_BRANCH_RATIO
) -> DataFrame:
    """One row per base seen often enough, with its verdict.

    Spellings are reduced per (base, raw) first, so a base with very many places
    never gathers them.
    """
    per_raw = assigned.groupBy("base", "raw").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_branch").alias("branches"),
        F.min(F.when(F.col("addr") != "", F.struct("seq", "addr"))).alias("first_addr"),
    )
    variant = F.when(name_key(F.col("raw")) != name_key(F.col("base")), F.col("raw"))
    per_base = per_raw.groupBy("base").agg(
        F.sum("n").alias("count"),
        F.sum("branches").alias("branches"),
        F.array_sort(F.collect_set(variant)).alias("spellings"),
        F.min("first_addr").alias("first_addr"),
    ).filter(F.col("count") >= min_count)
    ratio = F.col("branches") / F.col("count")
    confirmed = F.col("ratio") >= min_ratio
    percent = f"{min_ratio * 100:.0f}%"
    return per_base.withColumn("ratio", ratio).select(
        F.col("base").alias("brand"),
        "count",
        F.bround("ratio", 2).alias("branch_ratio"),
        F.array_join("spellings", "; ").alias("variants"),
        F.coalesce("first_addr.addr", F.lit("")).alias("sample_addr"),
        F.when(confirmed, fixed.VERDICT_BRAND).otherwise(fixed.VERDICT_REJECTED).alias("verdict"),
        F.concat(
            F.lit("빈도 "), F.col("count").cast("string"), F.lit("·지점비율 "), F.bround(F.col("ratio") * 100, 0).cast("int").cast("string"),
            F.when(confirmed, f"%≥{percent} → 브랜드 확정").otherwise(f"%<{percent} → 일반상호 제외"),
        ).alias("reason"),
        (F.col("count").between(7, 10) | ((F.col("ratio") >= 0.30) & (F.col("ratio") < 0.50))).alias("borderline"),
    )


def ranked(found: DataFrame) -> DataFrame:
    """Confirmed brands first, then the more frequent ones."""
    return found.orderBy(F.col("verdict") != fixed.VERDICT_BRAND, F.desc("count"), "brand")


def brand_of(assigned: DataFrame, found: DataFrame) -> DataFrame:
    """(id, brand) of the places whose base was confirmed."""
    confirmed = found.filter(F.col("verdict") == fixed.VERDICT_BRAND).select(F.col("brand").alias("base"))
    return assigned.join(confirmed, "base").select("id", F.col("base").alias("brand"))


def with_brand(places: DataFrame, brands: DataFrame) -> DataFrame:
    """Places with their brand by id, null where there is none."""
    return places.drop("brand").join(brands, "id", "left")


def detect(places: DataFrame, **rules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bases per place, candidates, brand per place) of one detection run.

    The bases feed both the candidates and the assignment, so they are written once.
    """
    assigned = cut_lineage(assign_bases(places, **rules))
    found = candidates(assigned)
    return assigned, found, brand_of(assigned, found)


def brand_totals(places: DataFrame, found: DataFrame) -> DataFrame:
    """One row: places with and without a brand, and brands confirmed and rejected."""
    verdicts = found.agg(
        F.count_if(F.col("verdict") == fixed.VERDICT_BRAND).alias("confirmed"),
        F.count_if(F.col("verdict") != fixed.VERDICT_BRAND).alias("rejected"),
    )
    return places.agg(
        F.count("brand").alias("assigned"), F.count_if(F.col("brand").isNull()).alias("unassigned")
    ).select(
        "assigned", "unassigned",
        verdicts.select("confirmed").scalar().alias("confirmed"), verdicts.select("rejected").scalar().alias("rejected"),
    )
