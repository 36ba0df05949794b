"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the contracts define it: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session without it (tests) gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quaymark-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that the cluster names."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: A key is frequent from this many rows on, and from this share of all rows on (so at most SHARES - 1 keys are).
HOT_ROWS, SHARES = 100_000, 65_536
#: Groups up to which their sizes are broadcast.
FEW_GROUPS = 10_000


def frequent(counted: DataFrame, keys: list[str], count: str = "count", least: int = HOT_ROWS) -> DataFrame | None:
    """The keys of counted(keys, count) that hold so many rows that one task should not get them all; None if there is none.

    They are fewer than SHARES, so the table may be broadcast.
    """
    many = counted.filter(F.col(count) > least)
    if not many.limit(1).count():
        return None
    total = counted.agg(F.sum(count)).first()[0] or 0
    hot = materialise(many.filter(F.col(count) > total / SHARES).select(*keys, F.lit(True).alias("_hot")))
    return hot if hot.limit(1).count() else None


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """An equi join in which the left rows of frequent keys are dealt over all partitions by a hash of ``by``.

    The right rows of those keys go to each of them; there should be few for each key.
    """
    if hot is None:
        return left.join(right, keys, how)
    n = partitions(left.sparkSession)
    tag = F.broadcast(hot)
    deal = left.join(tag, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(n)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    again = right.join(tag, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return deal.join(again, [*keys, "_salt"], how).drop("_salt")


def smallest_hashes(df: DataFrame, group: list[str], by: str, n: int) -> DataFrame:
    """The n rows of each group whose ``by`` has the smallest hashes, numbered by _rn.

    Rows over a hash below which a group of its size has 40 n rows are left out before any sort, so one task gets few
    however large a group is; that fewer than n of them remain is as good as impossible.
    """
    h = F.xxhash64(by)
    share = F.least(F.lit(1.0), F.lit(40.0 * n) / F.col("_size"))
    sizes = materialise(df.groupBy(*group).agg(F.count("*").alias("_size")))
    # labels and languages are few, and a join by one would send all rows to as many tasks
    near = df.join(F.broadcast(sizes) if sizes.count() <= FEW_GROUPS else sizes, group).filter(h.cast("double") / 2.0**64 + 0.5 <= share).drop("_size")
    return near.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(h, by))).filter(F.col("_rn") <= n)


def settled() -> None:
    """Give freed memory back to the system: the driver's after training, a worker's at a task's end (glibc only)."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return


def integral(df: DataFrame, column: str) -> None:
    """Refuse ids of another type: the smaller of two ids decides."""
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        raise TypeError(f"{column} must be an integer column")


def fold_remainder(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id written as text, modulo k (a null id counts as empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % k
