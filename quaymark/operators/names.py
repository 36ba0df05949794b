"""Joins of names by the words that they share (section 2.5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_tokens(name: Column) -> Column:
    """The different words of a name in lower case, sorted."""
    return F.array_sort(F.array_distinct(F.split(F.lower(name), r"[^\p{L}\p{N}]+")))


def token_jaccard(a: Column, b: Column) -> Column:
    """The share of the different words of two names that both have."""
    x, y = name_tokens(a), name_tokens(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def rare_first(sets: DataFrame, counts: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """(keys, tokens, n, token) for the rarest words of each set, as many as one of them must be shared from ``least`` similarity on.

    Of n words at least ceil(least * n) are shared, so of any n - ceil(least * n) + 1 of them at least one is.
    """
    each = sets.select(*keys, "tokens", F.explode("tokens").alias("token")).join(counts, [*keys, "token"], "left")
    ranked = each.groupBy(*keys, "tokens").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "token"))).alias("ranked"))
    n = F.size("tokens")
    return ranked.select(*keys, "tokens", n.alias("n"), F.explode(F.slice("ranked", F.lit(1), n - F.ceil(n * F.lit(least) - 1e-9).cast("int") + 1)).alias("r")).select(*keys, "tokens", "n", F.col("r.token").alias("token"))


def similar_names(left: DataFrame, right: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """(keys, tokens, other_tokens, similarity) of different word sets with the same keys and a Jaccard similarity from ``least`` on.

    Sets meet on one of their rarest words among those of the right side's sets with these keys, and only if their sizes allow the
    similarity; those that do are compared whole.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    counts = right.select(*keys, F.explode("tokens").alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("uses"))
    a = rare_first(left.select(*keys, "tokens").distinct(), counts, keys, least)
    b = rare_first(right.select(*keys, "tokens").distinct(), counts, keys, least).withColumnsRenamed({"tokens": "other_tokens", "n": "other_n"})
    both = a.join(b, [*keys, "token"]).filter(F.least("n", "other_n") + 1e-9 >= F.lit(least) * F.greatest("n", "other_n"))
    shared = F.size(F.array_intersect("tokens", "other_tokens"))
    similar = both.withColumn("similarity", shared / (F.col("n") + F.col("other_n") - shared)).filter(F.col("similarity") >= least)
    # the first shared rare word speaks for a pair
    return similar.groupBy(*keys, "tokens", "other_tokens").agg(F.first("similarity").alias("similarity"))


def same_price(left: DataFrame, right: DataFrame, keys: Sequence[str], apart: float = 0.01) -> DataFrame:
    """Ids of left rows for which a right row with the same keys has a price less than ``apart`` away: an equi join on price cells."""
    cell = F.floor(F.col("price") / apart)
    r = right.select(*keys, cell.alias("cell"), F.col("price").alias("other_price")).distinct()
    near = left.select("item_id", *keys, "price", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).join(r, [*keys, "cell"])
    return near.filter(F.abs(F.col("price") - F.col("other_price")) < apart).select("item_id").distinct()


def reconcile_by_similarity(left: DataFrame, right: DataFrame, keys: Sequence[str], least: float = 0.5) -> DataFrame:
    """For each left row the right row of the same keys with the most similar name (then the smallest id), unless one has the same price.

    Rows with equal words are one set of the join, the smallest id speaks for them.  Rows with a null key or name find nothing.
    """
    keys = list(keys)
    named = lambda df: df.withColumn("tokens", name_tokens(F.col("name"))).filter("tokens IS NOT NULL")
    a = named(left)
    b = named(right).groupBy(*keys, "tokens").agg(F.min("item_id").alias("other_id"))
    pairs = similar_names(a, b, keys, least).join(b.withColumnRenamed("tokens", "other_tokens"), [*keys, "other_tokens"])
    best = pairs.groupBy(*keys, "tokens").agg(F.min(F.struct(-F.col("similarity"), "other_id")).alias("m"))
    best = best.select(*keys, "tokens", F.col("m.other_id").alias("other_id"), (-F.col("m.col1")).alias("similarity"))
    return a.join(same_price(left, right, keys), "item_id", "left_anti").join(best, [*keys, "tokens"]).drop("tokens")
