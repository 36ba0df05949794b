"""Windows over series and top rows of groups (section 2.7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import same_keys, with_first_values


def asc(cols: Sequence[str]) -> list[Column]:
    return [F.asc_nulls_first(c) for c in cols]


def desc(cols: Sequence[str]) -> list[Column]:
    return [F.desc_nulls_last(c) for c in cols]


def price_moves(obs: DataFrame, order: Sequence[str], key: str = "offer_id", most_ratio: float = 5.0, least_change: float = 0.01) -> DataFrame:
    """Each observation whose price and day differ from the one before, within a ratio and over a relative change."""
    w = Window.partitionBy(key).orderBy(*asc(order))
    x = obs.withColumn("before", F.lag("price").over(w)).withColumn("day_before", F.to_date(F.lag(order[0]).over(w)))
    ratio = F.greatest("price", "before") / F.least("price", "before")
    return x.filter((F.col("before") > 0) & (F.col("price") > 0) & (F.col("price") != F.col("before")) & (F.to_date(order[0]) != F.col("day_before"))).withColumn("change", F.col("price") / F.col("before") - 1).filter(
        (ratio <= most_ratio) & (F.abs("change") >= least_change))


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1, name: str = "rn") -> DataFrame:
    """The newest n rows of each key, numbered from the newest."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*desc(order)))).filter(F.col(name) <= n)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def recent_vs_previous(df: DataFrame, key: Sequence[str], at: str, value: str = "value", width: int = 4, least: int = 8) -> DataFrame:
    """Mean of the last ``width`` points of a series against the ``width`` before them, for series that are long enough and had any value."""
    w = Window.partitionBy(*key).orderBy(F.desc(at))
    x = df.withColumn("rn", F.row_number().over(w)).groupBy(*key).agg(
        F.count("*").alias("points"),
        F.avg(F.when(F.col("rn") <= width, F.col(value))).alias("recent"),
        F.avg(F.when((F.col("rn") > width) & (F.col("rn") <= 2 * width), F.col(value))).alias("previous"),
    )
    return x.filter((F.col("points") >= least) & (F.col("previous") > 0)).withColumn("change", F.col("recent") / F.col("previous") - 1)


def trailing_zscore(df: DataFrame, key: Sequence[str], at: str, value: str = "value", width: int = 12, least_z: float = 2.5, least_value: float = 20, least_mean: float = 3) -> DataFrame:
    """Points far above the mean of the ``width`` points before them; a deviation of 0 counts as 1."""
    w = Window.partitionBy(*key).orderBy(at).rowsBetween(-width, -1)
    x = df.withColumn("mean", F.avg(value).over(w)).withColumn("sd", F.stddev_pop(value).over(w)).withColumn("n", F.count(value).over(w)).filter(F.col("n") == width)
    x = x.withColumn("z", (F.col(value) - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))
    return x.filter((F.col("z") >= least_z) & (F.col(value) >= least_value) & (F.col("mean") >= least_mean)).drop("n")


def latest_value(df: DataFrame, key: Sequence[str], at: str, value: str = "value") -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def collapse_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[Column], collapsible: Column, url: str, most: int | None = None) -> DataFrame:
    """The first row of each key with the number of rows and their urls (the first ``most``, or all); other rows pass through unchanged."""
    keys = list(keys)
    own = df.filter(collapsible)
    first = own.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
    counts = own.groupBy(*keys).agg(F.count("*").alias("copies"), *([F.array_sort(F.collect_set(url)).alias("urls")] if most is None else []))
    counts = counts if most is None else with_first_values(counts, own, keys, url, most, "urls")
    kept = first.join(counts, same_keys(first, counts, keys)).select(*(first[c] for c in first.columns), counts["copies"], counts["urls"])
    rest = df.filter(~F.coalesce(collapsible, F.lit(False))).withColumn("copies", F.lit(1).cast("long")).withColumn("urls", F.array(url))
    return kept.unionByName(rest)


def dedupe_by_page(df: DataFrame, page: Sequence[str], order: Sequence[str], name: str, least: str = "[0-9]") -> tuple[DataFrame, DataFrame]:
    """Of several offers on a page the newest, with the older names that hold a digit, and the ids of the others."""
    w = Window.partitionBy(*page).orderBy(*desc(order))
    x = df.withColumn("rn", F.row_number().over(w))
    old = x.filter((F.col("rn") > 1) & F.col(name).rlike(least)).groupBy(*page).agg(F.array_sort(F.collect_set(name)).alias("old_names"))
    kept = x.filter("rn = 1").drop("rn").join(old, list(page), "left")
    return kept, x.filter("rn > 1").drop("rn")
