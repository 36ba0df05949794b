"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Sizes are summed by source and hash bucket.  The bucket in which a source's running sum
crosses its budget is the only one refined, 10 bits of a 60-bit hash at a time; after
six levels the threshold is a full hash value and a plain filter makes the mix.
No document table is ever sorted.  A budget over the source's size takes every document once
and thresholds the rest, so budgets are nested: a larger one only adds documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
LEVELS, BITS = 6, 10
#: Rows up to which a table of one row per source is broadcast; beyond it a shuffled join is planned.
BROADCAST_ROWS = 100_000


def words(text: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from one row per source.

    Water-filling in closed form: sources in order of cap/weight; those below the water
    level get their cap, the others the level times their weight.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")))
    w = w.withColumn("cap", MOST_COPIES * F.col("source_size")).withColumn("total", F.sum("source_size").over(everything))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("level", (SHARE * F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    # the level rises while capped sources leave and falls afterwards, so its peak is the water level
    w = w.withColumn("water", F.max("level").over(everything))
    w = w.withColumn("capped", F.col("cap") <= F.col("weight") * F.col("water"))
    return w.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("water")).alias("target"))


def placed(df: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[Column, Column]:
    """The source as text and the 60-bit place of a row: a hash of its id and text."""
    text = F.coalesce(df[text_col], F.lit(""))
    key = F.md5(F.concat_ws(":", F.coalesce(df[id_col].cast("string"), F.lit("")), text).cast("binary"))
    return df[source_col].cast("string"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def thresholds(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(s, source_size, target, base, below) for each source of rows(source, size, h), and whether it may be broadcast.

    A row is taken base times, and once more where its place is under ``below``.
    """
    per_source = materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    small = per_source.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda x: x)

    state = per_source.select(
        F.col("source").alias("s"), F.lit(0).cast("long").alias("prefix"),
        (F.col("target") - F.when(F.col("target") >= F.col("source_size"), F.col("source_size")).otherwise(0)).alias("left"),
    )
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows.join(hint(state), rows["source"].eqNullSafe(state["s"]) & (F.shiftright(F.shiftright(rows["h"], shift), BITS) == state["prefix"]))
        hist = inside.groupBy("s", "left", F.shiftright("h", shift).alias("prefix")).agg(F.sum("size").alias("n"))
        running = Window.partitionBy("s").orderBy("prefix")
        hist = hist.withColumn("upto", F.sum("n").over(running.rowsBetween(Window.unboundedPreceding, 0)))
        crossing = hist.filter("upto > left").withColumn("k", F.row_number().over(running)).filter("k = 1")
        state = materialise(crossing.select("s", "prefix", (F.col("left") - (F.col("upto") - F.col("n"))).alias("left"), "n"))
        if level + 1 < LEVELS:
            state = state.drop("n")
    cut = state.select("s", F.when(F.col("left") * 2 >= F.col("n"), F.col("prefix") + 1).otherwise(F.col("prefix")).alias("below"))
    plan = per_source.join(cut, per_source["source"].eqNullSafe(cut["s"]), "left").select(
        F.col("source").alias("s"), "source_size", "target", F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0).alias("base"),
        F.coalesce("below", F.when(F.col("target") >= MOST_COPIES * F.col("source_size"), F.lit(1 << 60)).otherwise(F.lit(0))).alias("below"),
    )
    return materialise(plan), small


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for every row.

    copies is 0, 1 or 2, taken is copies times size.  Null and empty texts have size 0, a text of any length is counted whole; a null
    source is a source of its own, ordered last.  The place of a row is a hash of its id and
    text, so reruns agree and rows equal in both are taken together.  Each source's taken
    words differ from its target by at most half the boundary document.  An
    empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    source, place = placed(df, id_col, text_col, source_col)
    rows = materialise(df.select(df[id_col].alias("id"), source.alias("source"), words(text_col).alias("size"), place.alias("h")))
    plan, small = thresholds(rows)
    return (
        rows.join(F.broadcast(plan) if small else plan, rows["source"].eqNullSafe(plan["s"]))
        .withColumn("copies", F.col("base") + (F.col("h") < F.col("below")).cast("int"))
        .select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix_rows(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves: a row comes as often as it is taken; same columns, no shuffle of texts."""
    source, place = placed(docs, "doc_id", "text", "source")
    rows = materialise(docs.select(source.alias("source"), words().alias("size"), place.alias("h")))
    plan, small = thresholds(rows)
    joined = docs.join(F.broadcast(plan) if small else plan, source.eqNullSafe(plan["s"]))
    times = F.sequence(F.lit(1), plan["base"] + (place < plan["below"]).cast("int"))
    wanted = joined.filter((plan["base"] == 1) | (place < plan["below"]))
    again = f"_again_{uuid.uuid4().hex}"
    return wanted.select(*(docs[c] for c in docs.columns), F.explode(times).alias(again)).drop(again)
