"""Catalogue audit: every check gives rows (item_id, site, area, issue, priority) (section 2.11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import model_spellings, spec_key

ISSUE = ("item_id", "site", "area", "issue", "priority")


def issues(df: DataFrame, area: str, tests: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """One row for every test that an item fails, in one pass."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("issue"), F.lit(p).alias("priority"))) for n, p, c in tests)))
    return df.select("item_id", "site", F.explode(found).alias("x")).select("item_id", "site", F.lit(area).alias("area"), "x.issue", "x.priority")


def audit_prices(df: DataFrame, part: Column, bundle: Column) -> DataFrame:
    w = Window.partitionBy("site", "model_key")
    x = df.withColumn("_part", F.min(F.when(part, F.col("price"))).over(w))
    return issues(x, "prices", [
        ("no price", "P1", F.col("price").isNull()),
        ("old price is not higher", "P2", F.col("old_price") <= F.col("price")),
        ("old price is not a multiple of ten", "P3", F.pmod(F.col("old_price"), F.lit(10.0)) != 0),
        ("bundle is cheaper than a part", "P1", bundle & (F.col("price") < F.col("_part"))),
    ])


def audit_cross_site(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Items on one site only, and items whose price differs."""
    one = lambda a, b, site: a.join(b.select(key), key, "left_anti").select("item_id", F.lit(site).alias("site"), F.lit("sites").alias("area"), F.lit("only on one site").alias("issue"), F.lit("P2").alias("priority"))
    both = left.join(right.select(key, F.col("price").alias("_p")), key).filter(F.abs(F.col("price") - F.col("_p")) >= 1)
    other = both.select("item_id", F.lit("both").alias("site"), F.lit("sites").alias("area"), F.lit("price differs").alias("issue"), F.lit("P1").alias("priority"))
    return one(left, right, "one").unionByName(one(right, left, "two")).unionByName(other)


def audit_duplicates(df: DataFrame, name_key: str, specs: str = "specs", colour: str = "colour") -> DataFrame:
    """Cards of one site and name: colour variants, different goods, price conflicts or plain duplicates.

    Their spec maps are compared key by key (but for the colour): a key differs if a card lacks it or has another value.  Cards
    with all different colours and at most two other differences are variants; from three differences on they are different goods.
    """
    keys = ["site", name_key]
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("price").alias("prices"), F.min("item_id").alias("item_id")).filter("n > 1")
    x = df.join(g.select(*keys, "n"), keys).select(*keys, "n", F.explode(F.map_entries(specs)).alias("e")).select(*keys, "n", F.col("e.key").alias("key"), F.col("e.value").alias("value"))
    per = x.groupBy(*keys, "n", "key").agg(F.count("*").alias("have"), F.count_distinct("value").alias("values"))
    odd = (F.col("have") < F.col("n")) | (F.col("values") > 1)
    d = per.groupBy(*keys).agg(F.count_if(odd & (F.col("key") != colour)).alias("differ"), F.max((F.col("key") == colour) & (F.col("values") == F.col("n"))).alias("coloured"))
    x = g.join(d, keys, "left").withColumn("differ", F.coalesce("differ", F.lit(0))).withColumn("coloured", F.coalesce("coloured", F.lit(False)))
    kind = F.when(F.col("coloured") & (F.col("differ") <= 2), "colour variants").when(F.col("differ") >= 3, "different goods").when(F.col("prices") > 1, "price conflict").otherwise("duplicate")
    return x.select("item_id", "site", F.lit("duplicates").alias("area"), kind.alias("issue"), F.when(kind.isin("different goods", "price conflict"), "P1").otherwise("P2").alias("priority"), "n", "differ")


def audit_naming(df: DataFrame, name: str, text: str, code: str, terms: Sequence[tuple[str, str, str]], unit: str, variant: str, most_units: int = 2) -> DataFrame:
    """Names that are not written alike: (check, key, form, n, common, item_id).

    ``code`` finds model codes, of which one spelling should do; ``terms`` are (name, pattern, ending to cut) of words with one form; ``unit``
    (group 1) should name at most ``most_units`` units; a ``variant`` that is called by its code is no name.
    """
    def minority(x: DataFrame, check: str) -> DataFrame:
        n = x.groupBy("key", "form").agg(F.count("*").alias("n"), F.min("item_id").alias("item_id"))
        w = Window.partitionBy("key")
        n = n.withColumn("common", F.max_by("form", F.struct("n", "form")).over(w))
        return n.filter(F.col("form") != F.col("common")).select(F.lit(check).alias("check"), "key", "form", "n", "common", "item_id")

    own = df.filter("parent IS NULL") if "parent" in df.columns else df
    codes = own.select("item_id", F.explode(model_spellings(F.col(name), code)).alias("s")).select("item_id", F.col("s.key").alias("key"), F.col("s.raw").alias("form"))
    out = minority(codes, "code")
    for term, pattern, ending in terms:
        hits = own.select("item_id", F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" | ", name, text)), F.lit(pattern), F.lit(0))).alias("raw"))
        out = out.unionByName(minority(hits.select("item_id", F.lit(term).alias("key"), F.regexp_replace("raw", ending, "").alias("form")), "term"))
    units = own.select("item_id", F.explode(F.regexp_extract_all(F.lower(name), F.lit(unit), F.lit(1))).alias("form")).select("item_id", F.lit("unit").alias("key"), "form")
    several = units.agg(F.count_distinct("form").alias("k")).filter(F.col("k") > most_units).drop("k")  # one row or none
    out = out.unionByName(minority(units, "unit").join(F.broadcast(several), how="left_semi"))
    if "parent" in df.columns:
        bad = df.filter(F.col("parent").isNotNull() & F.col(name).rlike(variant)).groupBy("site").agg(F.count("*").alias("n"), F.min_by(name, "item_id").alias("form"), F.min("item_id").alias("item_id"))
        out = out.unionByName(bad.select(F.lit("variant").alias("check"), F.col("site").alias("key"), "form", "n", F.lit(None).cast("string").alias("common"), "item_id"))
    return out


def audit_completeness(df: DataFrame, least: int) -> DataFrame:
    return issues(df, "cards", [
        ("no image", "P1", F.size("images") == 0), ("no specs", "P2", F.size("specs") == 0), ("short description", "P3", F.length("description") < least),
        ("no sku", "P2", F.col("sku").isNull()), ("no section", "P2", F.col("category").isNull()), ("brand spelling", "P3", F.col("brand") != F.initcap("brand"))])


def audit_typography(df: DataFrame, text: str) -> DataFrame:
    """Spaces, brackets, mixed alphabets and punctuation of a text column."""
    t = F.col(text)
    opened = F.length(t) - F.length(F.replace(t, F.lit("("), F.lit("")))
    closed = F.length(t) - F.length(F.replace(t, F.lit(")"), F.lit("")))
    return issues(df, "typography", [
        ("double space", "P3", t.rlike("  ")), ("space before punctuation", "P3", t.rlike(" [,.;:!?]")), ("no space after a comma", "P3", t.rlike(",[A-Za-z]")),
        ("unbalanced brackets", "P3", opened != closed), ("mixed alphabets", "P2", t.rlike("[A-Za-z][а-яА-Я]|[а-яА-Я][A-Za-z]")), ("shouting", "P3", t.rlike("!!"))])


def glued_words(df: DataFrame, id_col: str, text: str, least: int = 16, seen: int = 2, part: int = 3) -> DataFrame:
    """Long words that split into two words, both seen often enough elsewhere in the corpus.

    The vocabulary is counted once; only long words are split, and both halves meet it by hash joins.
    """
    words = df.select(id_col, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    vocabulary = words.filter(F.length("word") >= part).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= seen)
    long = words.filter(F.length("word") >= least).select("word").distinct()
    cut = long.select("word", F.explode(F.sequence(F.lit(part), F.length("word") - part)).alias("at"))
    cut = cut.select("word", "at", F.substring(F.col("word"), F.lit(1), F.col("at")).alias("head"), F.substring(F.col("word"), F.col("at") + 1, F.length("word")).alias("tail"))
    v = vocabulary.select("word")
    ok = cut.join(v.withColumnRenamed("word", "head"), "head", "left_semi").join(v.withColumnRenamed("word", "tail"), "tail", "left_semi")
    best = ok.groupBy("word").agg(F.min_by(F.struct("head", "tail"), "at").alias("s")).select("word", "s.head", "s.tail")
    return words.select(id_col, "word").distinct().join(best, "word")


def audit_structure(df: DataFrame, keys: Sequence[str], section: str) -> DataFrame:
    """Items in a minority section of their group, when one section holds most of it."""
    n = df.groupBy(*keys, section).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    x = n.withColumn("usual", F.max_by(section, F.struct("n", section)).over(w)).withColumn("share", F.max("n").over(w) / F.sum("n").over(w))
    odd = x.filter((F.col(section) != F.col("usual")) & (F.col("share") >= 0.5)).select(*keys, section, "usual")
    return df.join(odd, [*keys, section]).select("item_id", "site", F.lit("structure").alias("area"), F.concat(F.lit("usually in "), F.col("usual")).alias("issue"), F.lit("P3").alias("priority"))


def audit_spec_keys(df: DataFrame, specs: str, synonyms: Sequence[tuple[str, str]]) -> DataFrame:
    """Spec names that are not written alike, and those with letters of two alphabets in a word."""
    k = df.select("item_id", "site", F.explode(F.map_keys(specs)).alias("raw")).withColumn("key", spec_key(F.col("raw"), synonyms))
    n = k.groupBy("key", "raw").agg(F.count("*").alias("n"), F.min(F.struct("item_id", "site")).alias("x"))
    common = F.max_by("raw", F.struct("n", "raw")).over(Window.partitionBy("key"))
    odd = n.withColumn("common", common).filter(F.col("raw") != F.col("common")).select("x.*", F.concat_ws(" ", F.lit("spec"), "raw", F.lit("is usually"), "common").alias("issue"), F.lit("P3").alias("priority"))
    mixed = n.filter(F.col("raw").rlike("(?iu)[a-z][а-яё]|[а-яё][a-z]")).select("x.*", F.concat(F.lit("mixed alphabets in spec "), "raw").alias("issue"), F.lit("P2").alias("priority"))
    return odd.unionByName(mixed).select("item_id", "site", F.lit("structure").alias("area"), "issue", "priority")


def audit_run(frames: Sequence[DataFrame], dismissed: DataFrame, fold: int = 6, items: DataFrame | None = None) -> DataFrame:
    """All issues: dismissed ones marked, and ``fold`` or more equal P3 issues of a site folded into one row with their number.

    ``items`` (item_id, category) gives each issue its item's category.
    """
    every = frames[0].select(*ISSUE)
    for f in frames[1:]:
        every = every.unionByName(f.select(*ISSUE))
    w = Window.partitionBy("site", "area", "issue", "priority")
    x = every.withColumn("n", F.count("*").over(w))
    folded = x.filter((F.col("priority") == "P3") & (F.col("n") >= fold)).groupBy("site", "area", "issue", "priority").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n"))
    single = x.filter(~((F.col("priority") == "P3") & (F.col("n") >= fold))).withColumn("n", F.lit(1).cast("long"))
    out = folded.select(*ISSUE, "n").unionByName(single.select(*ISSUE, "n"))
    out = out.join(dismissed.select("item_id", "issue").distinct().withColumn("dismissed", F.lit(True)), ["item_id", "issue"], "left").na.fill(False, ["dismissed"])
    return out if items is None else out.join(items.select("item_id", "category"), "item_id", "left").na.fill("none", ["category"])


def audit_counts(run: DataFrame) -> DataFrame:
    """Issues of an audit that are not dismissed, by site, area and category, and in all, with the number of each priority."""
    of = lambda p: F.count_if(F.col("priority") == p).alias(p)
    x = run.filter("NOT dismissed").groupingSets([[F.col("site")], [F.col("area")], [F.col("category")], []], F.col("site"), F.col("area"), F.col("category"))
    return x.agg(F.count("*").alias("n"), of("P1"), of("P2"), of("P3"))


def stock_totals(report: DataFrame, items: DataFrame) -> DataFrame:
    """For each category the items, those out of stock, those never seen in stock and those that a twin replaces."""
    out = report.groupBy("category").agg(F.count("*").alias("missing"), F.count_if(F.col("last_in_stock").isNull()).alias("never"), F.count_if(F.col("twin_id").isNotNull()).alias("replaced"), F.max("last_in_stock").alias("last"))
    return items.groupBy("category").agg(F.count("*").alias("items")).join(out, "category", "left").na.fill(0, ["missing", "never", "replaced"])


def stock_report(items: DataFrame, obs: DataFrame, twins: DataFrame) -> DataFrame:
    """Unavailable items with their twin and the last day in stock."""
    last = obs.groupBy("item_id").agg(F.max(F.when(F.col("availability") == "InStock", F.to_date("observed_at"))).alias("last_in_stock"), F.max_by("availability", F.struct("observed_at", "seq", "qty", "price")).alias("status"))
    first = twins.groupBy("item_id").agg(F.min("twin_id").alias("twin_id"))
    return items.join(last.filter("status <> 'InStock'"), "item_id").join(first, "item_id", "left").select("item_id", "category", "status", "last_in_stock", "twin_id")
