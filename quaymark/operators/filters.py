"""Predicates and filters over findings, offers and pages (section 2.2)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_findings(df: DataFrame, *, as_of: date | None = None, days: int | None = None, types: Sequence[str] = (), severities: Sequence[str] = (), statuses: Sequence[str] = (),
                    least_confidence: float | None = None, seller_id: int | None = None, item_id: int | None = None, text: str | None = None, text_cols: Sequence[str] = ()) -> DataFrame:
    """Findings that meet every given condition; conditions left out do not filter."""
    tests: list[Column] = []
    if days is not None and as_of is not None:
        tests.append(F.col("created_at") >= F.date_sub(F.lit(as_of), days))
    for col, values in (("finding_type", types), ("severity", severities), ("status", statuses)):
        if values:
            tests.append(F.col(col).isin(*values))
    if least_confidence is not None:
        tests.append(F.col("confidence") >= least_confidence)
    if seller_id is not None:
        tests.append(F.col("seller_id") == seller_id)
    if item_id is not None:
        tests.append(F.col("item_id") == item_id)
    if text:
        tests.append(matches_text(text, text_cols))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def matches_text(text: str, cols: Sequence[str]) -> Column:
    """Whether any column holds the text, in any case; % and _ of the text are ordinary characters."""
    safe = text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{safe}%"), F.lit(False)) for c in cols])


def active_in_scope(df: DataFrame) -> DataFrame:
    return df.filter("is_active AND price IS NOT NULL AND category IS NOT NULL")


def in_list(df: DataFrame, col: str, values: Sequence | DataFrame) -> DataFrame:
    """Rows whose column is in a list (a literal list, or the first column of a table)."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(col)), col, "left_semi")
    return df.filter(F.col(col).isin(*values)) if values else df.limit(0)


def seller_or_group(offers: DataFrame, sellers: DataFrame, chosen: Sequence[int]) -> DataFrame:
    """Offers of the chosen sellers and of every seller in one of their groups."""
    named = sellers.select("seller_id", F.coalesce("seller_group", F.col("seller_id").cast("string")).alias("k"))
    keys = named.filter(F.col("seller_id").isin(*chosen)).select("k").distinct()
    return offers.join(named.join(keys, "k", "left_semi").select("seller_id"), "seller_id", "left_semi")


def usable_url(url: Column) -> Column:
    """False for a site root and for carts."""
    path = F.coalesce(F.regexp_extract(url, r"^[a-z]+://[^/?#]*(/[^?#]*)", 1), F.lit(""))
    return ~((F.regexp_replace(path, "/", "") == "") | F.contains(path, F.lit("/cart")))


def distinctive_key(key: Column) -> Column:
    return F.coalesce(key.rlike("^[A-Za-z]{2,}") & (F.length(key) >= 4), F.lit(False))


def in_scope_flag(name: Column, category: Column, always: Sequence[str] = (), negative: str | None = None) -> Column:
    """False without a category, true for the given ones, else false where a negative marker stands in the name."""
    marked = F.lower(name).rlike(negative) if negative else F.lit(False)
    return F.when(category.isNull(), False).when(category.isin(*always), True).otherwise(~F.coalesce(marked, F.lit(False)))


def has_member(json_list: Column, value: str) -> Column:
    return F.coalesce(F.array_contains(F.from_json(json_list, "array<string>"), value), F.lit(False))


def valid_listing(df: DataFrame, title: str, price: str, missing: str, article: str, section: str) -> DataFrame:
    """Parsed listings without not-found pages, articles and section titles that have no price."""
    t = F.lower(F.col(title))
    return df.filter(~t.rlike(missing) & ~t.rlike(article) & ~(F.col(price).isNull() & t.rlike(section)))


def good_title(title: Column, stop: Sequence[str], price: str, call: str, least: int = 6) -> Column:
    t = F.lower(F.trim(title))
    return F.coalesce((F.length(t) >= least) & ~t.isin(*stop) & ~t.rlike(price) & ~t.rlike(call), F.lit(False))


def null_safe_lookup(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """A join in which a null key meets a null key; the right side's keys are dropped."""
    r = right.select(*(F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns))
    test = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(r, test, how).drop(*(f"_r_{c}" for c in on))
