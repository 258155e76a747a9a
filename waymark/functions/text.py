"""String columns: trimming, name keys, addresses, rule tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import fixed

#: White space of any script.
SPACES = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def strip(c: Column) -> Column:
    """Cut white space of any script from both ends (``trim`` only knows the blank)."""
    return F.btrim(c, F.lit(SPACES))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spread(df: DataFrame, keep: Sequence[Column | str], array: Column, item: str, pos: str | None = None) -> DataFrame:
    """One row per element of a computed array of non-null elements.

    The outer form with a check on its own output keeps the optimizer from
    copying the array's expression into a filter below, where it would be
    computed again for every copy.
    """
    spot = pos or "_pos"
    rows = df.select(*keep, F.posexplode_outer(array).alias(spot, item)).filter(F.col(spot).isNotNull())
    return rows if pos else rows.drop(spot)


def lines(c: Column) -> Column:
    return F.split(c, _LINE_BREAK)


def blank_to_null(c: Column, max_chars: int | None = None) -> Column:
    """Trim; blank text becomes null; longer text is cut to the column's width."""
    value = F.nullif(strip(c), F.lit(""))
    return value if max_chars is None else F.substring(value, 1, max_chars)


def without_parentheses(name: Column) -> Column:
    return strip(F.regexp_replace(or_empty(name), r"\([^)]*\)", ""))


def name_key(name: Column) -> Column:
    """Spelling-neutral key of a name: no white space, lower case."""
    return F.lower(F.regexp_replace(or_empty(name), r"(?U)\s+", ""))


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value of ``key`` in a fixed table, null where it has none."""
    if not table:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def standard_name(base: Column, variants: Mapping[str, str] = fixed.NAME_VARIANTS) -> Column:
    return F.coalesce(lookup(name_key(base), variants), strip(base))


def has_branch_mark(name: Column, mark: str = fixed.BRANCH_MARK) -> Column:
    return without_parentheses(name).endswith(mark)


def base_before_branch(name: Column, mark: str = fixed.BRANCH_MARK) -> Column:
    """All words but the last, when there are several and the last is a branch name."""
    words = F.split(without_parentheses(name), r"(?U)\s+")
    is_branch = (F.size(words) >= 2) & F.element_at(words, -1).endswith(mark)
    return F.when(is_branch, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))


# ---- addresses ------------------------------------------------------------
def region_prefix(token: Column, regions: Iterable[str] = fixed.REGION_NAMES) -> Column:
    """Name of the region a token starts with, else null."""
    return F.nullif(F.regexp_extract(or_empty(token), "^(" + "|".join(regions) + ")", 1), F.lit(""))


def dong_of(addr: Column) -> Column:
    """Neighbourhood named in parentheses; the last pair that names one counts."""
    groups = F.reverse(F.regexp_extract_all(or_empty(addr), F.lit(r"\(([^)]*)\)"), F.lit(1)))
    named = F.transform(groups, lambda g: F.regexp_extract(g, r"([가-힣]+\d*(?:동|가|리))(?![가-힣])", 1))
    return F.get(F.filter(named, lambda v: v != ""), F.lit(0))


def gu_of(addr: Column, region: Column, city_region: str = fixed.FOUR_LEVEL_REGION) -> Column:
    """District token of an address, after its region token and, in one region, its city token."""
    words = F.split(strip(or_empty(addr)), r"(?U)\s+")

    def district(ws: Column) -> Column:
        word = lambda n: F.coalesce(F.get(ws, n), F.lit(""))
        after_region = F.when(region_prefix(word(F.lit(0))).isNotNull(), 1).otherwise(0)

        def behind_city(i: Column) -> Column:
            return word(i + F.when((region == city_region) & word(i).endswith("시"), 1).otherwise(0))

        return once(once(after_region, behind_city), lambda w: F.when(w.endswith("구") | w.endswith("군"), w))

    return once(words, district)


def only_listed(c: Column, allowed: Iterable[str]) -> Column:
    return F.when(c.isin(list(allowed)), c)


def region_of_code(code: Column, codes: Mapping[str, str] = fixed.REGION_CODES) -> Column:
    return F.coalesce(lookup(F.substring(or_empty(code), 1, 2), codes), F.lit(""))


# ---- rule tables ------------------------------------------------------------
def first_match(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Label of the first rule whose pattern occurs in ``text``, else null."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(label)) for label, pattern in rules])


def all_matches(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    hits = F.array(*[F.when(text.rlike(pattern), F.lit(label)) for label, pattern in rules])
    return F.filter(hits, lambda x: x.isNotNull())


def place_category(
    name: Column,
    trade: Column,
    rules: Iterable[tuple[str, str]] = fixed.NAME_RULES,
    trades: Mapping[str, str] = fixed.TRADE_CODES,
    default: str = fixed.OTHER,
) -> Column:
    return F.coalesce(first_match(or_empty(name), rules), lookup(or_empty(trade), trades), F.lit(default))


def goods_text(name: Column, goods: Column) -> Column:
    return F.concat(or_empty(name), F.lit(" "), or_empty(goods))


def goods_category(name: Column, goods: Column, rules=fixed.GOODS_RULES, default: str = fixed.OTHER) -> Column:
    return F.coalesce(first_match(goods_text(name, goods), rules), F.lit(default))


def chain_of(name: Column, rules=fixed.CHAIN_RULES) -> Column:
    """Struct (brand_cat, brand) of the first matching chain rule, else null."""
    return F.coalesce(
        *[
            F.when(or_empty(name).rlike(p), F.struct(F.lit(group).alias("brand_cat"), F.lit(brand).alias("brand")))
            for group, brand, p in rules
        ]
    )


def goods_codes(
    labels: Column,
    rules=fixed.GOODS_CODES,
    parent: str = fixed.GOODS_PARENT,
    child_prefix: str = fixed.GOODS_CHILD_PREFIX,
) -> Column:
    """Sorted codes of all rules that match any of a page's labels.

    ``\\b`` stands for "no word character follows" in every script, so it is
    spelled out here instead of left to the regex dialect.
    """
    boundary = f"(?![{fixed.WORD_CHARS}])"

    def hit(code: str, pattern: str) -> Column:
        spelled = pattern.replace(r"\b", boundary)
        return F.when(F.exists(labels, lambda x: x.rlike(spelled)), F.lit(code))

    def without_parent(codes: Column) -> Column:
        has_child = F.exists(codes, lambda x: x.startswith(child_prefix))
        return F.array_sort(F.when(has_child, F.array_remove(codes, parent)).otherwise(codes))

    return once(F.filter(F.array(*[hit(c, p) for c, p in rules]), lambda x: x.isNotNull()), without_parent)
