"""Sorted sweeps over keys of any size (section 2.7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise


def running_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], counted: Column, to: str) -> DataFrame:
    """The rows with the number of ``counted`` rows of their keys up to and with them, in this order.

    Rows are dealt by range and counted inside their partition; what a key has in earlier partitions is added from one row
    for each key and partition.  So a key may spread over all partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_one", counted.cast("long")).repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    kept = materialise(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    totals = kept.groupBy(*keys, "_part").agg(F.sum("_one").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    here = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    counts = kept.withColumn("_here", F.sum("_one").over(here)).join(offsets, [*keys, "_part"])
    return counts.withColumn(to, F.col("_here") + F.col("_before")).drop("_one", "_at", "_part", "_here", "_before")


def nearest_by_value(df: DataFrame, targets: DataFrame, keys: Sequence[str], value: str, target: str, tie: str, n: int = 4) -> DataFrame:
    """For each target row the n rows of the same keys whose value is nearest, by ``tie`` where two are equally near.

    All values and targets of a key are ordered once; a target meets the n values on each side by their numbers in that order.  Of rows with one value the n with the
    smallest tie are enough.  Null keys, values and targets are near to nothing.
    """
    keys = list(keys)
    whole = lambda x, c: x.filter(F.greatest(*(F.col(k).isNull().cast("int") for k in [*keys, c])) == 0)
    best = Window.partitionBy(*keys, value).orderBy(tie)
    rows = whole(df, value).withColumn("_tie", F.row_number().over(best)).filter(F.col("_tie") <= n).drop("_tie")
    values = rows.select(*keys, F.col(value).cast("double").alias("_v")).distinct().withColumn("_kind", F.lit(1))
    wanted = whole(targets, target).select(*keys, F.col(target).cast("double").alias("_v")).distinct().withColumn("_kind", F.lit(0))
    # a target comes before an equal value, so its count is that of the values below it
    ranked = running_count(values.unionByName(wanted), keys, ["_v", "_kind"], F.col("_kind") == 1, "_rank")
    asked = ranked.filter("_kind = 0").select(*keys, F.col("_v").alias("_t"), F.explode(F.sequence(F.col("_rank") - n + 1, F.col("_rank") + n)).alias("_rank"))
    close = asked.join(ranked.filter("_kind = 1").select(*keys, "_v", "_rank"), [*keys, "_rank"]).drop("_rank")
    found = close.join(rows.withColumn("_v", F.col(value).cast("double")), [*keys, "_v"]).withColumn("gap", F.abs(F.col("_v") - F.col("_t")))
    found = found.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, "_t").orderBy("gap", tie))).filter(F.col("rn") <= n).drop("_v")
    return targets.withColumn("_t", F.col(target).cast("double")).join(found, [*keys, "_t"]).drop("_t")
