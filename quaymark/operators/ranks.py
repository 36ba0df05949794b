"""Exact order statistics and first values of groups of any size (section 2.6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise
from .sizes import bounded

#: Rows up to which the values of a group are sorted in one task, and buckets of a histogram of a larger one.
SORTED, BUCKETS = 100_000, 1024


def upper_median(column: str) -> Column:
    """The upper of the two middle values of an even number of values, for groups of a bounded size: the aggregate holds all different values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]):
    """Equality of keys in which null equals null."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def large_groups(df: DataFrame, keys: Sequence[str], value: str, most: int) -> DataFrame | None:
    """(keys, n) of the groups with over ``most`` values; None if there is none."""
    n = df.groupBy(*keys).agg(F.count(value).alias("n")).filter(F.col("n") > most)
    n = materialise(n)
    return n if n.limit(1).count() else None


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, wanted: DataFrame) -> DataFrame:
    """(keys, which, value) for wanted(keys, which, need): the value with ``need`` values below it in sorted order.

    Each pass counts the values of a range in buckets and goes on in the bucket that holds the rank, between the least and the largest value in
    it, until these are one; so no task holds more of a group than its buckets.
    """
    state = wanted.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    rows = df.select(*(F.col(k) for k in keys), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    done = None
    while True:
        left = state.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "which", "need", "low", "high")
        meet = F.lit(True)
        for i, k in enumerate(keys):
            meet = meet & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        inside = rows.join(bounded(left), meet).filter(F.col("low").isNull() | F.col("_v").between(F.col("low"), F.col("high")))
        # the first pass has no range yet and cuts by the size of the number
        scale = F.signum("_v") * F.log1p(F.abs("_v"))
        first = F.floor(scale * 16)
        bucket = F.when(F.col("low").isNull(), first).otherwise(F.least(F.lit(BUCKETS - 1), F.floor((F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BUCKETS)))
        counted = inside.groupBy(*keys, "which", "need", bucket.alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = F.sum("_c").over(Window.partitionBy(*keys, "which").orderBy("_b"))
        found = counted.withColumn("_upto", upto).filter((F.col("need") < F.col("_upto")) & (F.col("need") >= F.col("_upto") - F.col("_c")))
        found = materialise(found.select(*keys, "which", (F.col("need") - (F.col("_upto") - F.col("_c"))).alias("need"), "low", "high"))
        one = found.filter("low = high").select(*keys, "which", F.col("low").alias("value"))
        done = one if done is None else done.unionByName(one)
        state = found.filter("low < high")
        if not state.limit(1).count():
            return done


def medians(df: DataFrame, keys: Sequence[str], value: str, most: int = SORTED) -> DataFrame:
    """(keys, median, upper_median) of each group, exact whatever its size; null without a value.

    Groups of up to ``most`` values are sorted; larger ones go through histograms.
    """
    keys = list(keys)
    plain = lambda x: x.groupBy(*keys).agg(F.median(value).alias("median"), upper_median(value).cast("double").alias("upper_median"))
    large = large_groups(df, keys, value, most)
    if large is None:
        return plain(df)
    small = plain(df.join(large, same_keys(df, large, keys), "left_anti"))
    wanted = large.select(*keys, F.explode(F.array(F.struct(F.lit("lower").alias("which"), F.floor((F.col("n") - 1) / 2).alias("need")), F.struct(F.lit("upper").alias("which"), F.floor(F.col("n") / 2).alias("need")))).alias("w"))
    found = ranked_values(df, keys, value, wanted.select(*keys, "w.which", "w.need"))
    pick = lambda which: F.max(F.when(F.col("which") == which, F.col("value")))
    big = found.groupBy(*keys).agg(((pick("lower") + pick("upper")) / 2).alias("median"), pick("upper").alias("upper_median"))
    return small.unionByName(big)


def first_values(df: DataFrame, keys: Sequence[str], value: str, n: int, to: str) -> DataFrame:
    """(keys, to): the first n different values of each group in order, as an array.

    Different values are ranked in each task before they meet, so a task sends n values of a group, and buffers hold no more.
    """
    few = df.filter(F.col(value).isNotNull()).select(*keys, value).distinct()
    few = few.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).filter(F.col("_rn") <= n)
    return few.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(to))


def with_first_values(groups: DataFrame, df: DataFrame, keys: Sequence[str], value: str, n: int, to: str) -> DataFrame:
    """Groups with the first n different values of their rows, an empty array where there is none."""
    keys = list(keys)
    names = first_values(df, keys, value, n, to)
    joined = groups.join(names, same_keys(groups, names, keys), "left")
    return joined.select(*(groups[c] for c in groups.columns), F.coalesce(names[to], F.array().cast(names.schema[to].dataType)).alias(to))
