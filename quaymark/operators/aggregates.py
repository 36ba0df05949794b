"""Market aggregates (section 2.6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import SORTED, medians, with_first_values


def coverage_matrix(offers: DataFrame, seller: str, category: str, categories: Sequence[str]) -> DataFrame:
    """Seller by category: offers, priced offers and distinct models, one row per seller with a column set per category."""
    model = F.concat_ws(":", "brand", F.coalesce("model_key", "name"))
    return offers.groupBy(seller).pivot(category, list(categories)).agg(F.count(F.lit(1)).alias("offers"), F.count("price").alias("priced"), F.countDistinct(model).alias("models")).na.fill(0)


def coverage_gaps(offers: DataFrame, own: DataFrame, category: str) -> DataFrame:
    """Categories that sellers offer and the own catalogue lacks."""
    return offers.groupBy(category).agg(F.countDistinct("seller_id").alias("sellers")).join(own.select(category).distinct(), category, "left_anti")


def seller_summary(offers: DataFrame, matches: DataFrame) -> DataFrame:
    """Per seller and in total (seller_id null): offers, priced, active, matched and their shares."""
    best = matches.select("offer_id").distinct().withColumn("hit", F.lit(1))
    x = offers.join(best, "offer_id", "left")
    out = x.rollup("seller_id").agg(
        F.count("*").alias("n"), F.count("price").alias("priced"), F.count_if("is_active").alias("active"), F.count("hit").alias("matched"),
        F.countDistinct("category").alias("categories"), F.max("last_seen").alias("last_seen"))
    return out.withColumn("matched_share", F.bround(F.col("matched") * 100 / F.col("n"), 2))


def groups_outside(offers: DataFrame, own_keys: DataFrame, keys: Sequence[str], name: str, most: int = 5) -> DataFrame:
    """Groups of offers whose key is not an own key: count, price range and, unless ``most`` is 0, first names."""
    x = offers.join(own_keys, own_keys.columns, "left_anti")
    groups = x.groupBy(*keys).agg(F.count("*").alias("n"), F.min("price").alias("least"), F.max("price").alias("most"), F.min("offer_id").alias("first_offer"))
    return with_first_values(groups, x, keys, name, most, "names").withColumn("names", F.array_join("names", ", ")) if most else groups


def multi_seller_models(offers: DataFrame, sellers: DataFrame, own: DataFrame, least: int = 2, high: int = 3) -> DataFrame:
    """Models that several sellers offer (a group of sites is one seller) and the own catalogue lacks."""
    x = offers.join(sellers.select("seller_id", F.coalesce("seller_group", F.col("seller_id").cast("string")).alias("who")), "seller_id")
    g = x.groupBy("brand", "model_key").agg(F.countDistinct("who").alias("sellers"), F.min("price").alias("least"), F.max("price").alias("most"), F.count("*").alias("offers"))
    return g.filter(F.col("sellers") >= least).join(own, ["brand", "model_key"], "left_anti").withColumn("severity", F.when(F.col("sellers") >= high, "high").otherwise("medium"))


def market(comparables: DataFrame, key: str, sorted_rows: int = SORTED) -> DataFrame:
    """Median, least and most price, offers and distinct sellers for each key; the median is exact for keys of any size."""
    stats = comparables.groupBy(key).agg(F.min("price").alias("least"), F.max("price").alias("most"), F.count("*").alias("n"), F.countDistinct("seller_group").alias("sellers"))
    middle = medians(comparables, [key], "price", sorted_rows).select(F.col(key).alias("_k"), "median")
    return stats.join(middle, F.col(key).eqNullSafe(F.col("_k"))).select(key, "median", "least", "most", "n", "sellers")


def position_share(offers: DataFrame, own: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Against the own least price of each key: share of cheaper offers, gap to the least and to the median."""
    mine = own.groupBy(*keys).agg(F.min("price").alias("own_least"))
    x = offers.join(mine, list(keys))
    return x.groupBy(*keys).agg(
        F.first("own_least").alias("own_least"), F.count("*").alias("n"),
        F.bround(F.avg((F.col("price") < F.col("own_least")).cast("int")) * 100, 2).alias("cheaper_share"),
        F.min("price").alias("least"), F.median("price").alias("median"),
    ).withColumn("gap_least", F.bround((F.col("own_least") / F.col("least") - 1) * 100, 2)).withColumn("gap_median", F.bround((F.col("own_least") / F.col("median") - 1) * 100, 2))


def entity_rollup(df: DataFrame, entity: Column, sums: Sequence[str], best: str) -> DataFrame:
    """Sites of one legal entity summed, with a grand total (entity null)."""
    return df.withColumn("entity", entity).rollup("entity").agg(*(F.sum(c).alias(c) for c in sums), F.max(best).alias(best), F.count("*").alias("sites"))


def revenue_segment(revenue: Column, form: Column, steps: Sequence[tuple[float, str]], other: str, special: dict[str, str]) -> Column:
    """A segment by legal form, else by the first step that the revenue reaches."""
    out = F.lit(other)
    for least, name in sorted(steps):
        out = F.when(revenue >= least, name).otherwise(out)
    for k, name in special.items():
        out = F.when(form == k, name).otherwise(out)
    return out


def role_share(offers: DataFrame, foreign: Column, steps: Sequence[tuple[float, str]], other: str) -> DataFrame:
    """Share of each seller's offers under foreign brands, its three commonest of them and a role."""
    x = offers.withColumn("foreign", foreign)
    share = x.groupBy("seller_id").agg(F.count("*").alias("n"), F.bround(F.avg(F.col("foreign").cast("int")), 4).alias("share"))
    counted = x.filter("foreign").groupBy("seller_id", "brand").agg(F.count("*").alias("k"))
    w = Window.partitionBy("seller_id").orderBy(F.desc("k"), "brand")
    top = counted.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").groupBy("seller_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "brand"))), lambda s: s["brand"]).alias("top"))
    role = F.lit(other)
    for least, name in sorted(steps):
        role = F.when(F.col("share") >= least, name).otherwise(role)
    return share.join(top, "seller_id", "left").withColumn("role", role)


def dominant_spelling(df: DataFrame, key: Sequence[str], raw: str) -> DataFrame:
    """Keys with several spellings: the commonest, the number of rows, and each minority spelling with its rows."""
    n = df.groupBy(*key, raw).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key)
    x = n.withColumn("common", F.max_by(raw, F.struct("n", raw)).over(w)).withColumn("spellings", F.count("*").over(w)).withColumn("rows", F.sum("n").over(w))
    return x.filter((F.col("spellings") > 1) & (F.col(raw) != F.col("common")))


def components_vs_bundle(df: DataFrame, keys: Sequence[str], part: Column, bundle: Column) -> DataFrame:
    """Bundles that cost more than their cheapest parts together, or less than one of them."""
    w = Window.partitionBy(*keys)
    x = df.withColumn("least_part", F.min(F.when(part, F.col("price"))).over(w)).filter(bundle & F.col("least_part").isNotNull())
    return x.withColumn("verdict", F.when(F.col("price") < F.col("least_part"), "below part").when(F.col("price") > 2 * F.col("least_part"), "above parts").otherwise("ok"))


def joined_names(df: DataFrame, keys: Sequence[str], name: str, most: int) -> DataFrame:
    """The first different names of each group in one text, and how many different ones it has.

    Names are ranked in one sort of each group, which spills, and no task holds more than ``most`` names of one.
    """
    keys = list(keys)
    x = df.select(*keys, name).withColumn("_rn", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(name))))
    x = x.withColumn("_rn", F.when(F.col(name).isNotNull(), F.col("_rn")))
    g = x.groupBy(*keys).agg(F.coalesce(F.max("_rn"), F.lit(0)).cast("long").alias("n"), *(F.max(F.when(F.col("_rn") == k + 1, F.col(name))).alias(f"_{k}") for k in range(most)))
    return g.select(*keys, F.array_join(F.array(*(f"_{k}" for k in range(most))), "; ").alias("names"), "n")
