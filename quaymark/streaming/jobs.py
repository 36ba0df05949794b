"""Incremental forms of the change operators as Structured Streaming jobs (section 2.13)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from threading import Event

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..operators.changes import upsert_offers
from ..shared import shared_folder

STORE_CLASS = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_observations(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """New observation files as a stream."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(path)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all that is there (availableNow) into a Parquet table of the shared folder and read it.

    Stateful streams here need the RocksDB store; it is set while the query starts, and the session gets its own setting back.
    """
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(STORE_CLASS, "unset")
    spark.conf.set(STORE_CLASS, STATE_STORE)
    try:
        q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    finally:
        if before == "unset":
            spark.conf.unset(STORE_CLASS)
        else:
            spark.conf.set(STORE_CLASS, before)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


class RowCounts(StreamingQueryListener):
    """Rows that a query has read, and those of them that came under the watermark and were dropped.

    ``seen`` comes from ``observe`` metrics of the source rows, ``late`` from the state operators: rows of a deduplication or a processor, and
    (window, key) groups of a micro-batch where rows are first added up.
    """

    SEEN = "rows_seen"

    def __init__(self):
        self.seen, self.late, self.done = 0, 0, Event()

    def watch(self, stream: DataFrame) -> DataFrame:
        return stream.observe(self.SEEN, F.count(F.lit(1)).alias("n"))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.late += sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        self.seen += (p.observedMetrics.get(self.SEEN) or {"n": 0})["n"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.done.set()


def run_counted(stream: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, RowCounts]:
    """The result of ``apply`` over all that is there, with the counts of rows seen and of late ones.

    The listener is that of one session, in which only this query should run meanwhile.
    """
    spark, counts = stream.sparkSession, RowCounts()
    spark.streams.addListener(counts)
    try:
        out = run_to_end(apply(counts.watch(stream)))
        counts.done.wait(60)  # the end of a query comes after all its progress
    finally:
        spark.streams.removeListener(counts)
    return out, counts


class KeyedState:
    """A Parquet table by buckets of its key, of which a batch rewrites those that it touches.

    Every bucket has a current version; the one before stays until the next batch is done, so that a repeated batch finds it.
    """

    def __init__(self, start: DataFrame, folder: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = start.sparkSession, folder, list(keys), buckets
        self.schema = T.StructType([*start.schema.fields, T.StructField("_bucket", T.IntegerType())])
        self.now, self.before, self.replaced = dict.fromkeys(range(buckets), -1), {}, []
        self._write(start, -1)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, batch: DataFrame) -> list[int]:
        return [r[0] for r in batch.select(self.bucket()).distinct().collect()]  # at most as many as there are buckets

    def _write(self, df: DataFrame, n: int) -> None:
        df.withColumn("_bucket", self.bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/v{n}")

    def _read(self, at: dict[int, int]) -> DataFrame:
        out = None
        for v in sorted(set(at.values())):
            x = self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{v}").filter(F.col("_bucket").isin([b for b, n in at.items() if n == v])).drop("_bucket")
            out = x if out is None else out.unionByName(x)
        return out

    def read(self, n: int, buckets: Sequence[int]) -> DataFrame:
        """The rows of some buckets before batch n."""
        at = {b: self.before[b] if self.now[b] == n else self.now[b] for b in buckets}
        return self._read(at) if at else self._read({0: self.now[0]}).limit(0)

    def write(self, df: DataFrame, n: int, buckets: Sequence[int]) -> None:
        """All rows of some buckets after batch n."""
        self._write(df, n)
        hadoop, fresh = self.spark._jvm.org.apache.hadoop.fs, []
        for b in buckets:
            if self.now[b] != n:
                self.before[b], self.now[b] = self.now[b], n
                fresh.append((n, f"{self.folder}/v{self.before[b]}/_bucket={b}"))
        for _, path in [x for x in self.replaced if x[0] < n]:
            p = hadoop.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.replaced = [x for x in self.replaced if x[0] >= n] + fresh

    def current(self) -> DataFrame:
        return self._read(self.now)


class PriceChanges(StatefulProcessor):
    """Emits a row when price or availability differs from the last one; rows older than the state are ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp, seq long, price double, availability string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).sort_values(["observed_at", "seq", "qty", "price"], kind="stable")
        state = self.last.get() if self.last.exists() else None
        out = []
        for r in x.itertuples(index=False):
            at = r.observed_at.to_pydatetime()
            if state is not None and (at, r.seq) < (state[0], state[1]):
                continue
            if state is None or state[2] != r.price or state[3] != r.availability:
                out.append((key[0], r.observed_at, r.seq, None if state is None else state[2], r.price))
            state = (at, int(r.seq), float(r.price), r.availability)
        if state is not None:
            self.last.update(state)
        if out:
            yield pd.DataFrame(out, columns=["offer_id", "observed_at", "seq", "before", "price"])

    def close(self) -> None:
        pass


class Disappearances(StatefulProcessor):
    """Emits a row when a key had no observation for a while, in event time."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(x["ts"].max().timestamp() * 1000) for x in rows)
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or newest > before:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.quiet)
        yield pd.DataFrame({"key": pd.Series(dtype="int64"), "last_seen": pd.Series(dtype="datetime64[ns]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"key": [key[0]], "last_seen": [pd.Timestamp(at, unit="ms")]})

    def close(self) -> None:
        pass


class FailureStreak(StatefulProcessor):
    """Running number of failures in a row; emits when it reaches the limit."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.streak.get()[0] if self.streak.exists() else 0
        out = []
        for r in pd.concat(list(rows)).sort_values(["finished_at", "run_id"]).itertuples(index=False):
            n = 0 if r.ok else n + 1
            if n == self.limit:
                out.append((key[0], r.run_id, n))
        self.streak.update((n,))
        if out:
            yield pd.DataFrame(out, columns=["source_id", "run_id", "streak"])

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, time_mode: str = "None") -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", time_mode)


def price_changes(stream: DataFrame) -> DataFrame:
    return _stateful(stream, "offer_id", PriceChanges(), "offer_id long, observed_at timestamp, seq long, before double, price double")


def price_change_table(stream: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The same changes set-wise: each micro-batch meets the last row of its keys in one window, and leaves the new last rows.

    Batches overwrite their own output, so a repeated batch changes nothing; rows older than a key's last one are ignored.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    stream_schema = stream.schema
    state = KeyedState(spark.createDataFrame([], stream_schema), f"{folder}/last", [key])

    def apply(batch: DataFrame, n: int) -> None:
        buckets = state.touched(batch)
        last = state.read(n, buckets)
        gate = last.select(F.col(key), F.struct(*order[:2]).alias("_gate"))
        fresh = batch.join(gate, key, "left").filter(F.col("_gate").isNull() | (F.struct(*order[:2]) >= F.col("_gate"))).drop("_gate")
        both = last.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
        w = Window.partitionBy(key).orderBy("_new", *order)
        x = both.withColumn("before", F.lag("price").over(w)).withColumn("_a", F.lag("availability").over(w)).withColumn("_rn", F.row_number().over(w))
        moved = (F.col("_rn") == 1) | ~F.col("before").eqNullSafe(F.col("price")) | ~F.col("_a").eqNullSafe(F.col("availability"))
        x.filter((F.col("_new") == 1) & moved).drop("_new", "_a", "_rn").write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        newest = both.groupBy(key).agg(F.max(F.struct("_new", *order, *(c for c in stream_schema.names if c not in (key, *order)))).alias("r"))
        state.write(newest.select(*(F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in stream_schema.names)), n, buckets)

    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def disappeared(stream: DataFrame, key: str, quiet_ms: int, watermark: str = "1 hour") -> DataFrame:
    x = stream.withColumnRenamed(key, "key").withWatermark("ts", watermark)
    return _stateful(x, "key", Disappearances(quiet_ms), "key long, last_seen timestamp", "EventTime").filter("key IS NOT NULL")


def failure_streaks(stream: DataFrame, limit: int = 4) -> DataFrame:
    return _stateful(stream, "source_id", FailureStreak(limit), "source_id long, run_id long, streak int")


def dedupe(stream: DataFrame, keys: list[str], watermark: str = "14 days") -> DataFrame:
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def daily_counts(stream: DataFrame, kind: str, watermark: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), kind, "n")


def sliding_counts(stream: DataFrame, kind: str, watermark: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", watermark).groupBy(F.window("ts", "24 hours", "1 hour"), kind).agg(F.count("*").alias("n")).select(F.col("window.end").alias("until"), kind, "n")


def upsert_stream(stream: DataFrame, start: DataFrame, keys: list[str], seen_at: str, newest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Current offers after all batches: each micro-batch is upserted into the buckets of the table that its keys touch."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    state = KeyedState(start, f"{folder}/state", keys)

    def apply(batch: DataFrame, n: int) -> None:
        buckets = state.touched(batch)
        state.write(upsert_offers(state.read(n, buckets), newest(batch), keys, seen_at).drop("changed").select(start.columns), n, buckets)

    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return state.current()
