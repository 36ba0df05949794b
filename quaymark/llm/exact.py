"""Exact deduplication by a distributed content sort (DataFrame functions only).

Texts are equal when they are identical after deleting ASCII white space.  Range
partitioning on (a short prefix, a 64-bit hash, a salt) with sampled splitters deals
the normalised texts out, Spark's external sort places equals side by side inside
each partition, and a window over the sorted rows compares whole neighbouring texts.

Groups of over HOT_LEAST rows that hold over 1/65,536 of all rows (so fewer than that many groups) are salted by id
over all partitions; their totals come from a pre-aggregation that sends one row per
task and text, and are attached by a join whose small side has that proven bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, frequent, partitions

HOT_LEAST = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def exact_groups(df: DataFrame, carry: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 and the carried columns.

    Of equal texts the row with the most code points in the original text stays, then
    the smallest id (a null id comes last).  A null text counts as empty, so null,
    empty and all-white-space texts form one group; texts of any length are compared whole.  Repeated rows are one group of
    which one row stays.  An empty table gives an empty result; other columns of
    the input are ignored unless carried.
    """
    spark = df.sparkSession
    n = partitions(spark)
    text = F.col(text_col)
    base = df.select(
        F.col(id_col).alias("_id"),
        normalised(text).alias("_norm"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("_len"),
        F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry))).alias("_row") if carry else F.lit(0).alias("_row"),
    ).withColumn("_h", F.xxhash64("_norm"))

    hot = frequent(base.groupBy("_h").count(), ["_h"], least=HOT_LEAST)
    base = base.withColumn("_hot", F.lit(None).cast("boolean")) if hot is None else base.join(F.broadcast(hot), "_h", "left")  # under SHARES hashes

    salt = ["_salt"] if hot is not None else []  # a constant would keep Spark from seeing that the range partitioning serves the window
    dealt = (
        base.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_id"), F.lit(n))).otherwise(F.lit(0)))
        .withColumn("_prefix", F.substring("_norm", 1, 16))
        .repartitionByRange(n, "_prefix", "_h", *salt)
    )
    same = Window.partitionBy("_prefix", "_h", *salt, "_norm")
    order = same.orderBy(F.desc("_len"), F.asc_nulls_last("_id"))
    found = dealt.select(
        "_id", "_row", "_h", F.sha2("_norm", 256).alias("text_sha256"),
        F.row_number().over(order).alias("_rn"), F.first("_id").over(order).alias("_keep"),
        F.count("*").over(same).alias("_size"),
    )
    if hot is not None:
        totals = (
            base.filter("_hot")
            .groupBy("_h", "_norm")
            .agg(F.count("*").alias("_all"), F.min(F.struct(-F.col("_len"), F.col("_id").isNull(), F.col("_id").alias("id"))).alias("_best"))
            .select("_h", F.sha2("_norm", 256).alias("text_sha256"), "_all", F.col("_best.id").alias("_best"), F.lit(True).alias("_found"))
        )
        found = (
            found.join(F.broadcast(totals), ["_h", "text_sha256"], "left")  # under SHARES hot hashes
            .withColumn("_rn", F.when(F.col("_found") & ~F.col("_best").eqNullSafe(F.col("_id")), F.lit(2)).otherwise(F.col("_rn")))
            .withColumn("_keep", F.when(F.col("_found"), F.col("_best")).otherwise(F.col("_keep")))
            .withColumn("_size", F.when(F.col("_found"), F.col("_all")).otherwise(F.col("_size")))
        )
    return found.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_rn") == 1).alias("kept"), "text_sha256",
        *(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(carry)),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each group of equal texts; same columns."""
    rest = [c for c in docs.columns if c != "doc_id"]
    names = [f"x{i}" for i in range(len(rest))]
    renamed = docs.select("doc_id", F.col("text").alias("_t"), *(F.col(c).alias(n) for c, n in zip(rest, names, strict=True)))
    out = exact_groups(renamed, carry=names, text_col="_t").filter("kept")
    return out.select("doc_id", *(F.col(n).alias(c) for c, n in zip(rest, names, strict=True))).select(*docs.columns)
