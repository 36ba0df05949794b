"""Queries that run the streaming jobs over the test tables as file streams, to the end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.series import newest_rows
from ..shared import shared_folder
from ..sources import observations as S
from ..streaming import jobs as J
from .bindings import OBS_ORDER, offers, price_obs, read, run_log
from .registry import query


def stream_of(spark, d, name):
    """A table of the test data as a stream of its files; the glob makes a single file a valid source too."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    x = spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")
    return x.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def naive(df):
    """Timestamps as the tables have them, without a zone."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"})


class _Stream:
    """Stands in for a session so that the bindings read a table as a stream."""

    def __init__(self, spark):
        self.spark = spark

    @property
    def read(self):
        return self

    def parquet(self, path):
        folder, _, name = path.rpartition("/")
        return stream_of(self.spark, folder, name.removesuffix(".parquet"))


@query("read_observation_stream", "SELECT event_type, count(*) AS n, round_even(sum(value), 4) AS value FROM events GROUP BY 1")
def read_observation_stream(spark, d):
    return J.run_to_end(stream_of(spark, d, "events")).groupBy("event_type").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 4).alias("value"))


def dated_folders(spark, d, drops):
    """The events in dated folders of the shared folder, written in so many drops by their ids."""
    path = f"{shared_folder(spark)}/observations-{uuid.uuid4().hex}"
    e = read(spark, d, "events")
    for k in range(drops):
        e.filter(F.pmod("event_id", F.lit(drops)) == k).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)
    return path, e.schema


@query("read_observation_folders", "SELECT ts::DATE AS day, event_type, count(*) AS n, round_even(sum(value), 4) AS value FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND value > 1 GROUP BY 1, 2")
def read_observation_folders(spark, d):
    path, schema = dated_folders(spark, d, 1)
    x = S.read_observation_folders(spark, path, schema).filter("day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND value > 1")
    return x.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 4).alias("value"))


@query("stream_observation_folders", "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_observation_folders(spark, d):
    path, schema = dated_folders(spark, d, 2)
    return J.run_to_end(S.stream_observation_folders(spark, path, schema)).groupBy("day", "event_type").agg(F.count("*").alias("n"))


@query("stream_late_rows", """WITH m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAYS AS w, max(ts) - INTERVAL 1 DAY AS cut FROM events) SELECT unnest(['seen', 'late', 'kept']) AS what, unnest([count(*), count(*) FILTER (ts < cut AND ts <= w), count(*) FILTER (ts >= cut OR ts > w)]) AS n FROM events, m""")
def stream_late_rows(spark, d):
    """The last day's events come in two drops, all earlier ones in a third: those under the watermark, which drops follow by one, are dropped and counted."""
    path = f"{shared_folder(spark)}/drops-{uuid.uuid4().hex}"
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    newest = F.lit(e.agg(F.max("ts")).first()[0])
    age = F.when(F.col("ts") >= newest - F.expr("INTERVAL 12 HOURS"), 1).when(F.col("ts") >= newest - F.expr("INTERVAL 1 DAY"), 2).otherwise(3)
    for k in (1, 2, 3):
        e.filter(age == k).coalesce(1).write.parquet(f"{path}/{k}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    kept, counts = J.run_counted(stream, lambda s: J.dedupe(s, ["event_id"], "2 days"))
    told = spark.createDataFrame([("seen", counts.seen), ("late", counts.late)], "what string, n long")
    return told.unionByName(kept.agg(F.count("*").alias("n")).withColumn("what", F.lit("kept")))


@query("stream_price_changes", "{price_obs} SELECT offer_id, observed_at, seq, p AS before, price FROM (SELECT *, lag(price) OVER w AS p, lag(availability) OVER w AS a, row_number() OVER w AS rn FROM price_obs WINDOW w AS (PARTITION BY offer_id ORDER BY observed_at, seq, qty, price)) WHERE rn = 1 OR p IS DISTINCT FROM price OR a IS DISTINCT FROM availability")
def stream_price_changes(spark, d):
    return naive(J.price_change_table(price_obs(_Stream(spark), d).drop("item_id", "seller_id", "flag"), "offer_id", OBS_ORDER)).select("offer_id", "observed_at", "seq", "before", "price")


@query("stream_dedupe", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events) GROUP BY 1, 2")
def stream_dedupe(spark, d):
    s = stream_of(spark, d, "events").withColumn("day", F.to_date("ts"))
    return J.run_to_end(J.dedupe(s, ["user_id", "event_type", "day"], "60 days").select("user_id", "event_type", "day")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("stream_disappeared", "WITH m AS (SELECT max(ts) AS tm FROM events) SELECT user_id AS key, date_trunc('millisecond', max(ts)) AS last_seen FROM events, m GROUP BY 1, tm HAVING date_trunc('millisecond', max(ts)) + INTERVAL 12 HOURS <= date_trunc('millisecond', tm) - INTERVAL 1 HOUR")
def stream_disappeared(spark, d):
    return naive(J.run_to_end(J.disappeared(stream_of(spark, d, "events").select("user_id", "ts"), "user_id", 12 * 3600 * 1000)))


@query("stream_daily_counts", "WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events) SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events, m WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= w GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    return naive(J.run_to_end(J.daily_counts(stream_of(spark, d, "events"), "event_type")))


@query("stream_sliding_counts", "WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events), x AS (SELECT event_type, date_trunc('hour', ts) + INTERVAL (k) HOUR AS until FROM events, (SELECT unnest(range(1, 25)) AS k)) SELECT until::TIMESTAMP AS until, event_type, count(*) AS n FROM x, m WHERE until <= w GROUP BY 1, 2")
def stream_sliding_counts(spark, d):
    return naive(J.run_to_end(J.sliding_counts(stream_of(spark, d, "events"), "event_type")))


@query("stream_failure_streak", """{run_log} , x AS (SELECT *, sum(ok::INT) OVER (PARTITION BY source_id ORDER BY finished_at, run_id) AS island FROM run_log), y AS (SELECT *, row_number() OVER (PARTITION BY source_id, island ORDER BY finished_at, run_id) AS k FROM x WHERE NOT ok) SELECT source_id, run_id, 3::INT AS streak FROM y WHERE k = 3""")
def stream_failure_streak(spark, d):
    return J.run_to_end(J.failure_streaks(run_log(_Stream(spark), d), 3))


@query("stream_upsert", """{offers} SELECT item_id, seller_id, price, is_active FROM offers""".replace("SELECT item_id, seller_id, price, is_active FROM offers", ", last AS (SELECT item_id, seller_id, price FROM (SELECT l_partkey AS item_id, l_suppkey AS seller_id, l_extendedprice / l_quantity AS price, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC, l_quantity DESC, l_extendedprice / l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1) SELECT item_id, seller_id, last.price, true AS is_active FROM offers JOIN last USING (item_id, seller_id)"))
def stream_upsert(spark, d):
    start = offers(spark, d).filter("offer_id % 3 = 0").select(
        "item_id", "seller_id", "name", "price", "availability", F.col("first_seen").cast("timestamp").alias("first_seen"), F.col("last_seen").cast("timestamp").alias("last_seen"), "is_active")
    s = price_obs(_Stream(spark), d).withColumn("name", F.lit("seen"))
    return J.upsert_stream(s, start, ["item_id", "seller_id"], "observed_at", lambda b: newest_rows(b, ["item_id", "seller_id"], OBS_ORDER).drop("rn")).select("item_id", "seller_id", "price", "is_active")
