"""Set operations between catalogues, versions and sites (section 2.8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def own_keys(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct own codes and categories, with the aliases of own codes."""
    codes = items.select(F.lit("code").alias("what"), F.col("model_key").alias("value"))
    also = aliases.join(items.select("model_key").distinct(), F.col("own_code") == F.col("model_key"), "left_semi").select(F.lit("code").alias("what"), F.col("alias_code").alias("value"))
    return codes.union(items.select(F.lit("category"), "category")).union(also).distinct()


def added_removed(old: Column, new: Column) -> tuple[Column, Column]:
    return F.array_except(new, old), F.array_except(old, new)


def missing_in_members(df: DataFrame, group: Sequence[str], member: str, key: str, least: int = 3) -> DataFrame:
    """For each member of a group the keys that other members have and it lacks, when they are few (at most max(least, a third))."""
    every = df.groupBy(*group).agg(F.collect_set(key).alias("all_keys"))
    own = df.groupBy(*group, member).agg(F.collect_set(key).alias("own_keys"))
    x = own.join(every, list(group)).withColumn("missing", F.array_sort(F.array_except("all_keys", "own_keys")))
    return x.filter((F.size("missing") > 0) & (F.size("missing") <= F.greatest(F.lit(least), F.size("all_keys") / 3))).select(*group, member, "missing")


def label_site_matrix(df: DataFrame, labels: str, site: str, name: str, sites: Sequence[str], none: str = "none") -> DataFrame:
    """Own label by site: the sorted names of sections that carry it; sections without a label are under ``none``."""
    x = df.select(F.explode(F.split(F.coalesce(F.nullif(F.col(labels), F.lit("")), F.lit(none)), ",")).alias("label"), site, name)
    return x.groupBy("label").pivot(site, list(sites)).agg(F.array_join(F.array_sort(F.collect_set(name)), ", "))


def out_of_scope_themes(df: DataFrame, own: DataFrame, labels: str, theme: Column) -> DataFrame:
    """Sections none of whose labels is an own one, by theme: sites and sections."""
    mine = own.agg(F.collect_set("label").alias("_own"))  # a list of labels, one row
    x = df.join(mine).filter(~F.arrays_overlap(F.split(labels, ","), "_own"))
    return x.groupBy(theme.alias("theme")).agg(F.countDistinct("site").alias("sites"), F.count("*").alias("sections"))


def union_issues(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
