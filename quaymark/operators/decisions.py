"""Price verdicts, assortment gaps, reports and comparisons (section 2.10, D)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise
from .joins import comparables
from .ranks import medians, with_first_values
from .series import first_rows
from .sizes import bounded
from .text import round_retail_price


def cheapest_per_group(c: DataFrame) -> DataFrame:
    """One comparable per item, seller group and model: the cheapest."""
    return first_rows(c, ["item_id", "seller_group", "model_key"], [F.asc("price"), F.asc("offer_id")]).drop("rn")


def price_review(items: DataFrame, offers: DataFrame, matches: DataFrame, sellers: DataFrame, firm: float = 0.7, loose: float = 0.6, gap: float = 0.10) -> DataFrame:
    """Verdict and recommended price of every item with a market.

    Firm comparables count; an item with under three of them or under two sellers uses loose ones (``approx``) when
    there are three.  Three prices are needed, two when all are identical or exact.
    """
    c = cheapest_per_group(comparables(offers, matches, sellers, loose))
    is_firm = F.col("confidence") >= firm
    strong = lambda x: F.when(is_firm, x)
    x = c.groupBy("item_id").agg(
        F.median("price").alias("l_median"), F.count("*").alias("l_n"), F.median(strong(F.col("price"))).alias("median"), F.count_if(is_firm).alias("n"),
        F.count_distinct(strong(F.col("seller_group"))).alias("sellers"), F.min(strong(F.col("match_type").isin("exact", "identical").cast("int"))).alias("all_sure"))
    weak = F.coalesce((F.col("n") < 3) | (F.col("sellers") < 2), F.lit(True))
    x = x.withColumn("approx", weak & (F.col("l_n") >= 3))
    x = x.withColumn("market", F.when(F.col("approx"), F.col("l_median")).otherwise(F.col("median"))).withColumn("offers", F.when(F.col("approx"), F.col("l_n")).otherwise(F.col("n")))
    enough = F.col("approx") | (F.col("offers") >= 3) | ((F.col("offers") >= 2) & (F.col("all_sure") == 1))
    x = items.join(x.filter(enough), "item_id").withColumn("gap", F.col("price") / F.col("market") - 1)
    x = x.withColumn("verdict", F.when(F.col("gap") > gap, "lower").when(F.col("gap") < -gap, "raise").otherwise("keep"))
    return x.withColumn("recommended", recommended_price(F.col("verdict"), F.col("price"), F.col("market"), F.col("approx")))


def recommended_price(verdict: Column, price: Column, median: Column, approx: Column) -> Column:
    top = price * F.when(approx, 1.15).otherwise(1.25)
    return F.when(verdict == "lower", round_retail_price(median)).when(verdict == "raise", F.greatest(price, round_retail_price(F.least(0.95 * median, top)))).otherwise(price)


def decision_staleness(review: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviews with the decision once taken; stale when the verdict has changed since."""
    d = decisions.select("item_id", "decision", F.col("verdict").alias("decided_verdict"))
    return review.join(d, "item_id", "left").withColumn("stale", F.col("decision").isNotNull() & ~F.col("verdict").eqNullSafe(F.col("decided_verdict")))


#: Facts of models and of own peers beside category, kind, capacity and price.
FACTS = ("range_m", "channels", "battery_h", "weight_g", "two_way", "band")


def model_facts(offers: DataFrame, keys: Sequence[str], unit: Column) -> DataFrame:
    """One row a model: its commonest kind, its cheapest offer of that kind by unit price, and facts filled up from its other offers."""
    x = offers.withColumn("unit", unit)
    kind = x.groupBy(*keys, "kind").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"))
    x = x.join(kind, [*keys, "kind"])
    order = F.struct(F.col("unit").isNull(), "unit", "offer_id")
    fact = lambda f: F.coalesce(F.min_by(f, order), F.min_by(f, F.when(F.col(f).isNotNull(), F.col("offer_id"))))
    return x.groupBy(*keys, "kind").agg(
        F.count("*").alias("offers"), F.min_by("unit", order).alias("unit"), F.min_by("capacity", order).alias("capacity"), *(fact(f).alias(f) for f in FACTS if f != "two_way"), F.bool_or("two_way").alias("two_way"))


def peer_stats(peers: DataFrame, keys: Sequence[str], digital: str = "2.4 GHz") -> DataFrame:
    """What a group of own items offers at best; ``best`` is the cheapest one's (price, item_id, unit)."""
    return peers.groupBy(*keys).agg(
        F.count("*").alias("peers"), F.min("unit").alias("b_unit"), F.max("range_m").alias("b_range_m"), F.max("channels").alias("b_channels"), F.max("battery_h").alias("b_battery_h"), F.min("weight_g").alias("b_weight_g"),
        F.bool_or(F.coalesce("two_way", F.lit(False))).alias("b_two_way"), F.bool_or(F.col("band").isNull() | (F.col("band") == digital)).alias("b_digital"), F.min(F.struct("price", "item_id", "unit")).alias("best"))


def near_stats(models: DataFrame, peers: DataFrame) -> DataFrame:
    """The statistics of peers of close capacity for each (category, kind, capacity) of the models; peers are summed for each capacity first."""
    keys = models.filter("capacity IS NOT NULL").select("category", "kind", F.col("capacity").cast("long").alias("capacity")).distinct()
    reach = F.floor(F.greatest(F.lit(2.0), 0.2 * F.col("capacity")))
    wide = keys.withColumn("pc", F.explode(F.sequence(F.col("capacity") - reach, F.col("capacity") + reach)))
    per = peer_stats(peers.filter("capacity IS NOT NULL").withColumn("pc", F.col("capacity").cast("long")), ["category", "kind", "pc"])
    most = lambda c: F.max(c).alias(c)
    return wide.join(per, ["category", "kind", "pc"]).groupBy("category", "kind", "capacity").agg(
        F.sum("peers").alias("peers"), F.min("b_unit").alias("b_unit"), *map(most, ("b_range_m", "b_channels", "b_battery_h")), F.min("b_weight_g").alias("b_weight_g"), *map(most, ("b_two_way", "b_digital")), F.min("best").alias("best"))


def advantages(spec: Column | bool = True, digital: str = "2.4 GHz") -> Column:
    """Reasons that speak for a model (unit and FACTS) against peer statistics (b_...); ``spec`` says where more than the price counts."""
    c, better = F.col, []
    for f, name in (("range_m", "range"), ("channels", "channels"), ("battery_h", "battery")):
        better.append((name, c(f) >= 1.3 * c(f"b_{f}")))
    better += [("weight", c("weight_g") <= 0.7 * c("b_weight_g")), ("two-way", c("two_way") & ~c("b_two_way")), ("digital band", (c("band") == digital) & ~c("b_digital"))]
    spec = F.lit(spec) if isinstance(spec, bool) else spec
    return F.array_compact(F.array(F.when(c("unit") <= 0.75 * c("b_unit"), "unit price"), *(F.when(spec & test, name) for name, test in better)))


def justify_model(models: DataFrame, peers: DataFrame, system: str = "ring") -> DataFrame:
    """Reasons that speak for each model against own peers of its category and kind, and a verdict.

    Specs are held against all of them; the unit price of a system against peers of close capacity only.
    """
    every = peer_stats(peers, ["category", "kind"])
    near = near_stats(models.filter(F.col("kind") == system), peers).select("category", "kind", F.col("capacity").alias("_c"), F.col("b_unit").alias("_near"))
    x = models.join(every, ["category", "kind"], "left").withColumn("_c", F.col("capacity").cast("long")).join(near, ["category", "kind", "_c"], "left")
    x = x.withColumn("b_unit", F.when(F.col("kind") == system, F.col("_near")).otherwise(F.col("b_unit"))).withColumn("peers", F.coalesce("peers", F.lit(0))).withColumn("reasons", advantages())
    unknown = F.col("unit").isNull() & F.coalesce(*(F.col(f).cast("string") for f in FACTS if f != "two_way")).isNull()
    return x.drop("_c", "_near").withColumn("verdict", F.when(F.size("reasons") > 0, "consider").when(F.col("peers") == 0, "nothing to compare").when(unknown, "no data").otherwise("no advantage"))


def assortment_candidates(
    offers: DataFrame, sellers: DataFrame, items: DataFrame, name_key: Column, unit: Column, system: str = "ring", main: Sequence[str] = (), accessories: Sequence[str] = (), aliases: DataFrame | None = None,
) -> DataFrame:
    """Offered models by verdict (gap, consider, covered, no_data) and score.

    Offers group by brand, code (or, without one, ``name_key``), category and kind.  Own peers are those of the category and kind, for
    systems of close capacity; a system without one, or a ``main`` kind that the category lacks, is a gap.  Other kinds that the
    category lacks are held against the same kind elsewhere (``accessories``, by price only) or the whole category.
    """
    o = offers.filter("price >= 10 AND category IS NOT NULL").join(sellers.select("seller_id", "seller_group"), "seller_id").withColumn("model", F.coalesce("model_key", name_key)).withColumn("unit", unit).withColumn("brand", F.lower("brand"))
    order = F.struct("price", "offer_id")
    has = lambda f: F.when(F.col(f).isNotNull(), order)
    g = o.groupBy("brand", "model", "category", "kind").agg(
        F.countDistinct("seller_group").alias("sellers"), F.count("*").alias("offers"), F.min("price").alias("least"), F.median("price").alias("median"), F.max("price").alias("most"), F.min_by("capacity", has("capacity")).alias("capacity"),
        F.min("unit").alias("unit"), F.max("range_m").alias("range_m"), F.max("channels").alias("channels"), F.max("battery_h").alias("battery_h"), F.min("weight_g").alias("weight_g"), F.bool_or("two_way").alias("two_way"),
        F.min_by("band", has("band")).alias("band"), F.bool_or(F.col("model_key").isNotNull()).alias("coded"))
    i = items.withColumn("unit", unit).filter("price IS NOT NULL")
    names = ("peers", "b_unit", "b_range_m", "b_channels", "b_battery_h", "b_weight_g", "b_two_way", "b_digital", "best")
    packed = lambda df, name: df.select(*(c for c in df.columns if c not in names), F.struct(*names).alias(name))
    near = packed(near_stats(g.filter(F.col("kind") == system), i), "_near").withColumnRenamed("capacity", "_c")
    x = g.withColumn("_c", F.col("capacity").cast("long")).join(near, ["category", "kind", "_c"], "left").join(packed(peer_stats(i, ["category", "kind"]), "_kind"), ["category", "kind"], "left")
    x = x.join(packed(peer_stats(i, ["category"]), "_category"), "category", "left").join(packed(peer_stats(i, ["kind"]), "_any"), "kind", "left")
    codes = items.select("model_key").union(items.select("model_key").join(aliases, F.col("model_key") == F.col("own_code")).select("alias_code")) if aliases is not None else items.select("model_key")
    own = codes.filter("model_key IS NOT NULL").select(F.upper("model_key").alias("_code")).distinct().withColumn("_own", F.lit(True))
    x = x.withColumn("_code", F.upper("model")).join(own, "_code", "left")
    sized = (F.col("kind") == system) & F.col("capacity").isNotNull()
    is_accessory = F.col("kind").isin(*accessories) if accessories else F.lit(False)
    is_main = (F.col("kind") == system) | (F.col("kind").isin(*main) if main else F.lit(False))
    lacks = F.col("_kind").isNull() & F.col("_category").isNotNull() & ~sized
    pool = F.when(sized, F.col("_near")).when(~lacks, F.col("_kind")).when(is_main, F.lit(None)).when(is_accessory, F.coalesce("_any", "_category")).otherwise(F.col("_category"))
    x = x.withColumn("_pool", pool).withColumn("_gap", F.when(sized, F.col("_kind").isNotNull() & F.col("_near").isNull()).otherwise(lacks & is_main)).select("*", *(F.col(f"_pool.{n}").alias(n) for n in names))
    x = x.withColumn("reasons", advantages(~is_accessory))
    x = x.withColumn("verdict", F.when(F.col("_category").isNull() | F.col("_gap"), "gap").when(F.col("peers").isNull(), "no_data").when(F.col("_own"), "covered").when(F.size("reasons") > 0, "consider").otherwise("covered"))
    own_unit = F.coalesce("best.unit", "best.price")
    score = F.when(F.col("verdict") == "gap", 3.0).when(F.col("verdict") == "consider", 2.0).when(F.col("verdict") == "no_data", 0.5).otherwise(0.0) + 0.5 * F.col("sellers") + 0.3 * F.size("reasons")
    score = score - F.when(F.col("brand").isNull() & ~F.col("coded"), 1.0).otherwise(0.0)
    return x.select(
        "brand", "model", "category", "kind", "capacity", "sellers", "offers", "least", "median", "most", F.col("best.item_id").alias("peer_id"), F.bround((F.col("unit") - own_unit) / own_unit * 100, 2).alias("unit_gap"), "reasons", "verdict", F.bround(score, 4).alias("score"))


def category_position(position: DataFrame) -> DataFrame:
    """Verdict of a category from the worst of its kinds; position is what ``position_share`` gives."""
    x = position.groupBy("category").agg(F.max("cheaper_share").alias("worst"), F.max_by("kind", F.struct("cheaper_share", "kind")).alias("worst_kind"), F.sum("n").alias("offers"))
    return x.withColumn("verdict", F.when(F.col("offers") < 3, "no_data").when(F.col("worst") >= 50, "attention").when(F.col("worst") >= 20, "watch").otherwise("ok"))


def compare_table(df: DataFrame, group: Sequence[str], key: str, fields: Sequence[str], low: Sequence[str] = ("price",), same: Sequence[str] = (), raw: str | None = None) -> DataFrame:
    """Long table (group, key, field, value, best): the best value of each field in its direction is marked.

    Of rows equal in ``same`` the first by key counts.  ``raw``, a map, adds its entries as fields of text without a best one.
    """
    if same:
        df = first_rows(df, [*group, *same], [F.asc(key)]).drop("rn")
    long = df.select(*group, key, *(F.col(f).cast("double").alias(f) for f in fields)).unpivot([*group, key], list(fields), "field", "value").filter("value IS NOT NULL")
    w = Window.partitionBy(*group, "field")
    best = F.when(F.col("field").isin(*low), F.min("value").over(w)).otherwise(F.max("value").over(w))
    out = long.withColumn("best", F.col("value") == best)
    if raw is None:
        return out
    more = df.select(*group, key, F.explode(raw).alias("field", "text")).select(*group, key, "field", F.lit(None).cast("double").alias("value"), F.lit(None).cast("boolean").alias("best"), "text")
    return out.withColumn("text", F.lit(None).cast("string")).unionByName(more)


def evidence(df: DataFrame, keys: Sequence[str], id_col: str, most: int = 8) -> DataFrame:
    """(keys, n, confidence, evidence): how many findings a group has, and its ``most`` surest ones."""
    top = first_rows(df, keys, [F.desc("confidence"), F.asc(id_col)], most).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", id_col))), lambda s: s[id_col].cast("string")).alias("evidence"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.max("confidence").alias("confidence")).join(top, list(keys))


def generate_actions(multi: DataFrame, new_categories: DataFrame, growth: DataFrame, use_cases: DataFrame, drops: DataFrame, sellers: int = 3, categories: int = 2) -> DataFrame:
    """Proposed actions (dedupe_key, owner, priority, n, confidence, evidence) by five rules over open findings.

    A model of several sellers with a reason is to be asked for; a category that several sellers have is to be studied; growing
    demand calls for a campaign or a card; use cases for texts; a price drop for an answer, one for each model and kind.
    """
    use_cases, drops = materialise(use_cases), materialise(drops)  # each is read several times
    text = lambda *parts: F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    form = lambda df, key, owner, priority: df.select(key.alias("dedupe_key"), F.lit(owner).alias("owner"), priority.alias("priority"), "n", "confidence", "evidence")
    asked = multi.filter((F.col("sellers") >= sellers) & (F.size("reasons") > 0))
    a = form(asked.withColumn("n", F.col("sellers")).withColumn("evidence", F.col("reasons")), text("model", F.col("brand"), F.col("model_key")), "purchasing", F.lit("P2"))
    c = evidence(new_categories.withColumn("confidence", F.lit(0.6)), ["category"], "seller_id").filter(F.col("n") >= categories)
    b = form(c, text("category", F.col("category"), F.col("n").cast("string")), "product", F.lit("P3"))
    g = growth.withColumn("n", F.col("terms")).withColumn("evidence", F.array(F.col("change").cast("string")))
    d = form(g.filter("kind = 'existing'"), text("growth", F.col("category")), "marketing", F.lit("P2")).unionByName(form(g.filter("kind = 'gap'"), text("growth", F.col("category")), "product", F.lit("P2")))
    u = form(evidence(use_cases.withColumn("confidence", F.lit(0.6)).withColumn("all", F.lit("usecases")), ["all"], "term"), F.col("all"), "marketing", F.lit("P2"))
    family = F.coalesce(text(F.col("model_key"), F.col("kind")), text("item", F.col("item_id").cast("string")))
    family = F.when(F.col("model_key").isNull(), text("item", F.col("item_id").cast("string"))).otherwise(family)
    p = drops.withColumn("family", family)
    high = p.groupBy("family").agg(F.bool_or(F.col("severity") == "high").alias("high"))
    e = form(evidence(p, ["family"], "offer_id", 6).join(high, "family"), text("drop", F.col("family")), "pricing", F.when(F.col("high"), "P2").otherwise("P3"))
    return a.unionByName(b).unionByName(d).unionByName(u).unionByName(e)


def generate_ideas(
    new_categories: DataFrame, multi: DataFrame, growth: DataFrame, substitutes: DataFrame, offers: DataFrame, sellers: DataFrame, demand: DataFrame, least: int = 2, top: int = 5, names: int = 8,
) -> DataFrame:
    """Idea cards: categories of several sellers, models with a reason, growing gaps, substitutes.

    A card has dedupe_key, findings, least, most and upper_median price, offers, the category's ``top`` demand terms by observations (then by name; demand has term,
    category and n) and the first names of the sellers who offer it or, for substitutes, are one.
    """
    own = ["findings", "least", "most", "upper_median", "offers", "terms", "who"]
    no_names = F.array().cast("array<string>")

    def offered(groups: DataFrame, keys: list[str]) -> DataFrame:
        return offers.join(bounded(groups.select(*keys).distinct()), keys, "left_semi")

    def prices(groups: DataFrame, keys: list[str]) -> DataFrame:
        mine = offered(groups, keys)
        stats = mine.groupBy(*keys).agg(F.min("price").alias("least"), F.max("price").alias("most"), F.count("price").alias("offers"))
        middle = medians(mine, keys, "price").drop("median")
        return stats.join(middle.withColumnsRenamed({k: f"_{k}" for k in keys}), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))).drop(*(f"_{k}" for k in keys))

    none = {"least": F.lit(None).cast("double"), "most": F.lit(None).cast("double"), "upper_median": F.lit(None).cast("double"), "offers": F.lit(0).cast("long"), "terms": no_names}
    ranked = demand.withColumn("_rn", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "term"))).filter(F.col("_rn") <= top)
    terms = ranked.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "term"))), lambda s: s["term"]).alias("terms"))
    named = sellers.select("seller_id", "seller")
    c = new_categories.groupBy("category").agg(F.count("*").alias("findings")).filter(F.col("findings") >= least)
    c = with_first_values(c, new_categories.join(named, "seller_id"), ["category"], "seller", names, "who")
    c = c.join(prices(c, ["category"]), "category", "left").join(terms, "category", "left").na.fill(0, ["offers"]).withColumn("terms", F.coalesce("terms", no_names))
    m = multi.filter((F.col("sellers") >= least) & (F.size("reasons") > 0)).select("brand", "model_key", F.col("sellers").alias("findings"))
    m = with_first_values(m, offered(m, ["brand", "model_key"]).join(named, "seller_id"), ["brand", "model_key"], "seller", names, "who").join(prices(m, ["brand", "model_key"]), ["brand", "model_key"], "left").withColumn("terms", no_names)
    g = growth.filter("kind = 'gap'").select(F.concat(F.lit("growth:"), "category").alias("dedupe_key"), F.col("terms").alias("findings")).withColumns(none).withColumn("who", no_names)
    s = substitutes.agg(F.count("*").alias("findings")).filter("findings > 0").withColumn("dedupe_key", F.lit("substitutes"))
    s = with_first_values(s, substitutes.withColumn("dedupe_key", F.lit("substitutes")), ["dedupe_key"], "seller", names, "who").withColumns(none)
    cards = [c.withColumn("dedupe_key", F.concat(F.lit("category:"), "category")), m.withColumn("dedupe_key", F.concat_ws(":", F.lit("model"), "brand", "model_key")), g, s]
    return reduce(DataFrame.unionByName, (x.select("dedupe_key", *own) for x in cards)).withColumnRenamed("who", "sellers")


def report_sections(findings: DataFrame, since: Column, kinds: dict[str, Sequence[str]], review: DataFrame, actions: DataFrame, ideas: DataFrame) -> dict[str, tuple[DataFrame, Sequence[Column], int]]:
    """The ten sections of a periodic report; without a finding since then all findings count.

    ``kinds`` names the finding types of prices, products, demand, gaps and source errors.
    """
    recent = findings.filter(F.col("created_at") >= since)
    f = recent if recent.limit(1).count() else findings
    weight = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    f = f.withColumn("key", F.col("finding_id")).withColumn("value", F.col("confidence")).withColumn("_w", weight)
    order = [F.asc("_w"), F.desc("value"), F.asc("finding_id")]
    of = lambda name: f.filter(F.col("finding_type").isin(*kinds[name]))
    act = actions.withColumn("key", F.col("dedupe_key")).withColumn("value", F.col("confidence"))
    by_priority = [F.asc("priority"), F.asc("key")]
    return {
        "top": (f.filter(~F.col("finding_type").isin(*kinds["errors"])), order, 5),
        "own prices": (review.filter("verdict <> 'keep'").withColumn("key", F.col("item_id")).withColumn("value", F.col("recommended")), [F.asc(F.when(F.col("verdict") == "lower", 0).otherwise(1)), F.asc("item_id")], 10),
        "price changes": (of("prices"), order, 15), "products": (of("products"), order, 15), "demand": (of("demand"), order, 15), "gaps": (of("gaps"), order, 15),
        "ideas": (ideas.withColumn("key", F.col("dedupe_key")).withColumn("value", F.col("findings")), [F.desc("value"), F.asc("key")], 8), "risks": (f.filter("severity = 'high'"), order, 8),
        "owner decisions": (act.filter("priority = 'P1' OR owner = 'purchasing'"), by_priority, 8), "next": (act, by_priority, 12),
    }


def periodic_report(sections: dict[str, tuple[DataFrame, Sequence[Column], int]]) -> DataFrame:
    """Long table (section, rank, key, value) of the top rows of every section; a section is (rows with key and value, order, limit)."""
    out = None
    for name, (df, order, n) in sections.items():
        top = df.orderBy(*order).limit(n)  # at most n rows a section
        x = top.select(F.lit(name).alias("section"), F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order)).alias("rank"), F.col("key").cast("string").alias("key"), F.col("value").cast("double").alias("value"))
        out = x if out is None else out.unionByName(x)
    return out


def feature_comparison(features: DataFrame, manual: DataFrame, own: str, sellers: Sequence[str]) -> DataFrame:
    """Feature by seller with manual values over found ones, the own column first, and how many others offer what the own lacks."""
    m = manual.select("seller", "field", F.col("value").alias("_m"))
    x = features.join(m, ["seller", "field"], "full_outer").select("seller", "field", F.coalesce("_m", "value").alias("value"))
    table = x.groupBy("field").pivot("seller", [own, *sellers]).agg(F.max("value"))
    others = sum((F.col(f"`{s}`").isNotNull().cast("int") for s in sellers), F.lit(0))
    return table.withColumn("others", others).withColumn("better", F.col(f"`{own}`").isNull() & (others > 0))


def feature_gaps(features: DataFrame, own: str, most: int = 4, tenders: DataFrame | None = None, fields: DataFrame | None = None) -> DataFrame:
    """Features that sellers claim, or ``tenders`` (field) ask for, and the own side lacks: numbers, names and first values.

    Those of the known ``fields`` (field) that nobody claims come with n = 0: a chance to be the only one.
    """
    mine = features.filter(F.col("seller") == own).select("field").distinct()
    claimed = features.filter(F.col("seller") != own).groupBy("field").agg(
        F.countDistinct("seller").alias("n"), F.array_join(F.array_sort(F.collect_set("seller")), ", ").alias("sellers"), F.slice(F.array_sort(F.collect_set("value")), 1, most).alias("values"))
    if tenders is None and fields is None:
        return claimed.join(mine, "field", "left_anti")
    x = claimed.join(tenders.groupBy("field").agg(F.count("*").alias("tenders")), "field", "full_outer") if tenders is not None else claimed.withColumn("tenders", F.lit(0).cast("long"))
    x = x.join(fields.select("field").distinct(), "field", "full_outer") if fields is not None else x
    return x.join(mine, "field", "left_anti").na.fill(0, ["n", "tenders"]).withColumn("unclaimed", F.col("n") == 0)
