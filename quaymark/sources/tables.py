"""Stored tables that are kept by buckets of their key, so that an upsert moves only the new rows (section 2.9)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..shared import materialise, shared_folder


class KeyedTable:
    """Versions of a table, each in as many files as it has buckets of its key.

    A join on the key reads every bucket where it lies and sends the other side's rows to it; its result is in buckets again, so writing the next version
    moves nothing either.  The version before the last one goes when a new one is written.
    """

    def __init__(self, start: DataFrame, keys: Sequence[str], buckets: int = 64, name: str | None = None):
        self.spark: SparkSession = start.sparkSession
        self.keys, self.buckets = list(keys), buckets
        self.name, self.version = name or f"keyed_{uuid.uuid4().hex}", -1
        self._write(start.repartition(buckets, *keys))

    def _table(self, version: int) -> str:
        return f"{self.name}_v{version}"

    def _write(self, df: DataFrame) -> None:
        """The rows as the next version; they must lie in partitions by the key."""
        table = self._table(self.version + 1)
        path = f"{shared_folder(self.spark)}/{table}"
        df.write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", path).mode("overwrite").saveAsTable(table)
        self.version += 1
        if self.version > 1:
            self._remove(self.version - 2)

    def _remove(self, version: int) -> None:
        table = self._table(version)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(self.spark)}/{table}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def current(self) -> DataFrame:
        return self.spark.table(self._table(self.version))

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """Write what ``merge(stored, new)`` makes of both, a join on the key such as ``changes.upsert_keyed``, and return it."""
        fixed = materialise(new.repartition(self.buckets, *self.keys))  # else Spark would leave a key out of the join that is constant in the new rows
        self._write(merge(self.current(), fixed))
        return self.current()
