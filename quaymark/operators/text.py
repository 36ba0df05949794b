"""Text, number, date and map columns by caller-supplied rules (section 2.3)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .sizes import bounded
from .terms import find_terms

#: Spaces other than U+0020, and characters without width, that titles carry (fixed values).
ODD_SPACES = "      "
NO_WIDTH = "​‌‍⁠﻿ㅤᅟᅠ"


class Rule(NamedTuple):
    """In order: a label for the first rule whose pattern is found in the field."""

    field: str
    pattern: str
    label: str


@pandas_udf(T.StringType())
def nfkc(s):
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def clean_text(text: Column, compatibility: bool = False) -> Column:
    """Odd spaces become spaces, characters without width go, runs collapse; ``compatibility`` adds NFKC."""
    t = nfkc(text) if compatibility else text
    t = F.translate(t, ODD_SPACES + NO_WIDTH, " " * len(ODD_SPACES))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def parse_price(text: Column, mark: str = r"(?:₽|руб|eur|usd|€|\$)") -> Column:
    """The first number before a currency mark, else in the text; thousands by space or dot, decimals by comma or point."""
    number = r"([0-9][0-9 .,]*)"
    t = F.translate(F.lower(text), ODD_SPACES, " " * len(ODD_SPACES))
    raw = F.regexp_extract(t, number + r"\s*" + mark, 1)
    raw = F.trim(F.when(raw != "", raw).otherwise(F.regexp_extract(t, number, 1)))
    raw = F.regexp_replace(F.regexp_replace(raw, " ", ""), "[.,]+$", "")
    plain = F.when(raw.rlike(r"^[0-9]{1,3}([.][0-9]{3})+$"), F.replace(raw, F.lit("."), F.lit(""))).when(
        raw.rlike(r"^[0-9.]*,[0-9]{1,2}$"), F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit("")))
    v = plain.try_cast("double")
    return F.when((v > 0) & (v <= 1e8), v)


def first_label(rules: Sequence[Rule], otherwise: Column | None = None) -> Column:
    """Label of the first rule that matches; one expression, evaluated in order."""
    out = [F.when(F.coalesce(F.lower(F.col(r.field)).rlike(r.pattern), F.lit(False)), r.label) for r in rules]
    return F.coalesce(*out, *([otherwise] if otherwise is not None else [])) if out else F.lit(None).cast("string")


def first_label_by_table(df: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """The same for lists of any length, rules(ord, pattern, label): one pass finds all patterns that a text holds, the least ord wins."""
    r = rules.select(F.lower("pattern").alias("_pattern"), "ord", "label")
    held = find_terms(df.select(key, text), r, text, "_pattern", "_held").select(key, F.explode("_held").alias("_pattern"))
    hit = held.join(bounded(r), "_pattern").groupBy(key).agg(F.min_by("label", "ord").alias("label"))
    return df.join(hit, key, "left")


def detect_brand(name: Column, brands: Sequence[str], hint: Column | None = None) -> Column:
    found = F.coalesce(*(F.when(F.contains(F.lower(name), F.lit(b.lower())), b) for b in brands))
    return F.coalesce(F.nullif(F.trim(hint), F.lit("")), found) if hint is not None else found


#: Cyrillic letters and the Latin ones that they look like (fixed values).
LOOKALIKES = ("АВЕКМНОРСТХУ", "ABEKMHOPCTXY")


def fold_lookalikes(text: Column) -> Column:
    """Look-alike letters of words that hold a digit become Latin."""
    word = lambda w: F.when(w.rlike("[0-9]"), F.translate(F.upper(w), *LOOKALIKES)).otherwise(w)
    return F.array_join(F.transform(F.split(text, " "), word), " ")


def model_key(name: Column, sku: Column, patterns: Sequence[str], stop: str) -> Column:
    """The first code that an ordered list of patterns finds, without separators; a stop prefix is no code; else the sku up to 32 characters.

    A pattern with two groups gives both joined by a dash, as for models that are a word after a brand.
    """
    t = fold_lookalikes(name)

    def of(p: str) -> Column:
        groups = max(1, re.compile(p).groups)
        part = [F.nullif(F.upper(F.regexp_replace(F.regexp_extract(t, p, g), "[ -]", "")), F.lit("")) for g in range(1, groups + 1)]
        return part[0] if groups == 1 else F.when(part[0].isNotNull(), F.concat_ws("-", *part))

    found = [of(p) for p in patterns]
    usable = [F.when(~f.rlike(stop), f) for f in found]
    return F.coalesce(*usable, F.substring(F.upper(F.nullif(F.trim(sku), F.lit(""))), 1, 32))


def detect_capacity(name: Column, others: Sequence[Column], patterns: Sequence[str], variants: str) -> Column:
    """A number from the name, else the single different number in the other texts; a list of variants makes them void."""
    own = F.coalesce(*(F.regexp_extract(name, p, 1).try_cast("int") for p in patterns))
    usable = [F.when(~F.coalesce(o.rlike(variants), F.lit(False)), o) for o in others]
    every = F.array_distinct(F.flatten(F.array(*(F.coalesce(F.regexp_extract_all(o, F.lit(p), F.lit(1)), F.array().cast("array<string>")) for o in usable for p in patterns))))
    return F.coalesce(own, F.when(F.size(every) == 1, F.get(every, F.lit(0)).try_cast("int")))


def pack_qty(name: Column, pattern: str = r"([0-9]+) ?(?:pcs|pack|шт)") -> Column:
    n = F.regexp_extract(F.lower(name), pattern, 1).try_cast("int")
    return F.when(n >= 2, n)


def unit_price(price: Column, capacity: Column, pack: Column, is_system: Column, per_piece: Column, dear: float = 500) -> Column:
    """Price per unit of capacity for systems, per piece for packed goods; dear packs of unknown size have none."""
    return F.when(is_system, F.when(capacity >= 2, F.bround(price / capacity, 2))).when(
        per_piece, F.when(pack.isNotNull(), F.bround(price / pack, 2)).when(price <= dear, price)).otherwise(price)


def round_retail_price(v: Column) -> Column:
    step = F.when(v < 1000, 10).when(v < 10000, 50).otherwise(100)
    return F.bround(v / step) * step


def name_keys(name: Column, stop: str) -> dict[str, Column]:
    """Four comparison keys of a name."""
    low = F.translate(F.lower(name), "ё", "е")
    words = F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-zа-я0-9]+", " "), rf"\b(?:{stop})\b", " "))
    return {
        "words": F.substring(F.regexp_replace(words, " +", " "), 1, 60),
        "folded": F.translate(F.upper(low), *LOOKALIKES),
        "alnum": F.substring(F.regexp_replace(low, r"[^a-zа-я0-9]", ""), 1, 80),
        "tight": F.regexp_replace(low, r"\s+", ""),
    }


def content_hash(*parts: Column) -> Column:
    return F.sha1(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))).cast("binary"))


def flatten_specs(text: Column) -> Column:
    """A map from a JSON object of one or two levels; a later key overwrites an earlier one."""
    outer = F.from_json(text, "map<string,string>")
    entries = F.flatten(F.transform(F.map_entries(outer), lambda e: F.when(e["value"].startswith("{"), F.map_entries(F.from_json(e["value"], "map<string,string>"))).otherwise(F.array(e))))
    last = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.map_from_entries(F.array(e))))
    return F.coalesce(last, F.create_map().cast("map<string,string>"))


def typed_specs(text: Column, bands: Sequence[tuple[str, str]], specs: Column | None = None, capacity: Column | None = None) -> Column:
    """Range, channels, battery hours, weight, band, capacity and flags from free text and a spec map, each inside its sensible range.

    Entries of the map are read before the text.  For a charging case battery hours and weight would be those of what it holds, so they are void.
    """
    own = F.coalesce(F.array_join(F.transform(F.map_entries(specs), lambda e: F.concat_ws(": ", e["key"], e["value"])), " ; "), F.lit("")) if specs is not None else F.lit("")
    t = F.lower(F.concat_ws(" ; ", own, text))
    case = F.coalesce(t.rlike(r"charging (?:case|station|dock)|docking"), F.lit(False))

    def number(pattern: str, low: float, high: float) -> Column:
        v = F.replace(F.regexp_extract(t, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
        return F.when((v > low) & (v <= high), v)

    seats = number(r"([0-9]+) ?(?:persons|people|receivers|pcs)", 0.999, 1000).cast("int")
    return F.struct(
        number(r"([0-9]+) ?m\b", 19.999, 3000).alias("range_m"), number(r"([0-9]+) ?ch", 1, 20000).alias("channels"), F.when(~case, number(r"([0-9]+(?:[.,][0-9]+)?) ?h\b", 0.999, 200)).alias("battery_h"),
        F.when(~case, number(r"([0-9]+) ?g\b", 9.999, 500)).alias("weight_g"), F.coalesce(*(F.when(t.rlike(p), b) for p, b in bands)).alias("band"),
        t.rlike("two.?way").alias("two_way"), t.rlike("display|screen").alias("display"), (F.coalesce(capacity.cast("int"), seats) if capacity is not None else seats).alias("capacity"))


def spec_summary(spec: Column) -> Column:
    part = lambda f, unit: F.when(spec[f].isNotNull(), F.concat(F.format_number(spec[f], 0), F.lit(unit)))
    return F.concat_ws(", ", part("range_m", " m"), part("channels", " ch"), part("battery_h", " h"), part("weight_g", " g"), spec["band"], F.when(spec["two_way"], "two-way"))


def better_value(field: str, a: Column, b: Column, low: Sequence[str] = ("price", "weight_g")) -> Column:
    """-1, 0 or 1: which of two values of a field is better for the buyer (a first); NULL if one is missing."""
    x, y = a.cast("double"), b.cast("double")
    return F.sign(y - x if field in low else x - y).cast("int")


def domain_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z]+://)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def root_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+)", 1), F.lit(""))


#: Months by name (fixed values).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def parse_month(text: Column) -> Column:
    """struct(start, end) from 2026-08, 2026-08-15, 08.2026, a month's name with a year, or a date; the end is day 28."""
    t = F.lower(F.trim(text))
    named = F.coalesce(*(F.when(t.startswith(m), F.lit(f"{i:02d}")) for i, m in enumerate(MONTHS, 1)))
    year = F.regexp_extract(t, r"([0-9]{4})$", 1)
    month = F.coalesce(
        F.nullif(F.regexp_extract(t, r"^[0-9]{4}-([0-9]{2})(?:-[0-9]{2})?$", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^([0-9]{2})\.[0-9]{4}$", 1), F.lit("")), named)
    y = F.coalesce(F.nullif(F.regexp_extract(t, r"^([0-9]{4})-", 1), F.lit("")), F.nullif(year, F.lit("")))
    start = F.concat_ws("-", y, month, F.lit("01")).try_cast("date")
    return F.struct(F.when(month.isNotNull() & y.isNotNull(), start).alias("start"), F.when(month.isNotNull() & y.isNotNull(), F.date_add(start, 27)).alias("end"))


def format_money(x: Column) -> Column:
    return F.coalesce(F.replace(F.format_number(F.bround(x), 0), F.lit(","), F.lit(" ")), F.lit("—"))


def format_pct(x: Column) -> Column:
    return F.coalesce(F.concat(F.when(x > 0, "+").otherwise(""), F.format_number(F.bround(x * 100, 1), 1), F.lit("%")), F.lit("—"))


def json_list(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def model_spellings(name: Column, pattern: str) -> Column:
    """array<struct<key, raw>> of all codes in a name."""
    raw = F.regexp_extract_all(name, F.lit(pattern), F.lit(0))
    return F.transform(raw, lambda r: F.struct(F.upper(F.regexp_replace(r, "[ -]", "")).alias("key"), r.alias("raw")))


def spec_key(key: Column, synonyms: Sequence[tuple[str, str]]) -> Column:
    k = F.trim(F.lower(F.translate(key, "ёЁ", "еЕ")))
    for a, b in synonyms:
        k = F.replace(k, F.lit(a), F.lit(b))
    return k


def every_label(rules: Sequence[Rule]) -> Column:
    """The labels of all rules that match, each once, in the order of the rules; NULL if none does."""
    found = F.array_distinct(F.array_compact(F.array(*(F.when(F.coalesce(F.lower(F.col(r.field)).rlike(r.pattern), F.lit(False)), r.label) for r in rules))))
    return F.when(F.size(found) > 0, found)


def label_sections(df: DataFrame, overrides: DataFrame, rules: Sequence[Rule], site: str, section: str) -> DataFrame:
    """Own labels (an array) of a site's section: those of an override for that site and name, else of all rules that match."""
    o = overrides.select(F.col("site").alias(site), F.lower("section").alias("_s"), F.col("labels").alias("_labels"))
    x = df.withColumn("_s", F.lower(F.col(section))).join(o, [site, "_s"], "left")
    return x.withColumn("labels", F.coalesce(F.split("_labels", ","), every_label(rules))).drop("_s", "_labels")


def rental_and_category(page_kind: Column, url: Column, own: Column, page: Column, words: str) -> tuple[Column, Column]:
    return F.coalesce((page_kind == "rental") | F.lower(url).rlike(words), F.lit(False)), F.coalesce(own, page)


def normalise_offers(df: DataFrame, rules: Sequence[Rule], brands: Sequence[str], patterns: Sequence[str], stop: str, compatibility: bool = True) -> DataFrame:
    """All normalised columns of offers(name, sku, price_text) in one projection; names are read in their compatibility form (NFKC), so that wide letters and raised digits count."""
    df = df.withColumn("_name", clean_text(F.col("name"), compatibility))
    name = F.col("_name")
    return df.withColumns({
        "clean_name": name, "price": parse_price(F.col("price_text")), "brand_found": detect_brand(name, brands),
        "code": model_key(name, F.col("sku"), patterns, stop), "label": first_label(rules), "pack": pack_qty(name),
        "hash": content_hash(F.col("name"), F.col("sku"), F.col("price_text")),
    }).drop("_name")
