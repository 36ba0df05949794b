"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as O
from ..operators.sweep import nearest_by_value as nearest
from .bindings import OBS_ORDER, catalog, demand_obs, findings, offers, page_versions, price_obs, run_log, sellers
from .registry import query

ORDER_SQL = "ORDER BY observed_at, seq, qty, price"
MOVES = f"""moves AS (SELECT *, price / before - 1 AS change FROM (SELECT *, lag(price) OVER w AS before, lag(observed_at) OVER w AS prev_at FROM price_obs WINDOW w AS (PARTITION BY offer_id {ORDER_SQL}))
    WHERE before > 0 AND price > 0 AND price <> before AND observed_at::DATE <> prev_at::DATE AND greatest(price, before) / least(price, before) <= 5 AND abs(price / before - 1) >= 0.01)"""


@query("price_moves", "{price_obs} , " + MOVES + " SELECT offer_id, observed_at, seq, before, price, round_even(change, 6) AS change FROM moves")
def price_moves(spark, d):
    return O.price_moves(price_obs(spark, d), OBS_ORDER).select("offer_id", "observed_at", "seq", "before", "price", F.bround("change", 6).alias("change"))


@query("last_two_observations", "{price_obs} SELECT offer_id, rn, price, observed_at FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY observed_at DESC, seq DESC, qty DESC, price DESC) AS rn FROM price_obs) WHERE rn <= 2")
def last_two_observations(spark, d):
    return O.newest_rows(price_obs(spark, d), ["offer_id"], OBS_ORDER, 2).select("offer_id", F.col("rn").cast("long").alias("rn"), "price", "observed_at")


RECENT = """recent AS (SELECT term, category, points, recent, previous, recent / previous - 1 AS change FROM (SELECT term, category, count(*) AS points, avg(value) FILTER (rn <= 4) AS recent, avg(value) FILTER (rn > 4 AND rn <= 8) AS previous
    FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY day DESC) AS rn FROM demand_obs) GROUP BY term, category) WHERE points >= 8 AND previous > 0)"""


@query("recent_vs_previous", "{demand_obs} , " + RECENT + " SELECT term, points, round_even(recent, 6) AS recent, round_even(previous, 6) AS previous, round_even(change, 6) AS change FROM recent")
def recent_vs_previous(spark, d):
    r = O.recent_vs_previous(demand_obs(spark, d), ["term", "category"], "day")
    return r.select("term", "points", *(F.bround(c, 6).alias(c) for c in ("recent", "previous", "change")))


ZSCORE = """z AS (SELECT term, category, day, value, mean, (value - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS z FROM (SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd, count(value) OVER w AS n FROM demand_obs
    WINDOW w AS (PARTITION BY term ORDER BY day ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE n = 12)"""


@query("trailing_zscore", "{demand_obs} , " + ZSCORE + " SELECT term, day, value, round_even(mean, 6) AS mean, round_even(z, 5) AS z FROM z WHERE z >= 1.5 AND value >= 3 AND mean >= 1")
def trailing_zscore(spark, d):
    z = O.trailing_zscore(demand_obs(spark, d), ["term"], "day", least_z=1.5, least_value=3, least_mean=1)
    return z.select("term", "day", "value", F.bround("mean", 6).alias("mean"), F.bround("z", 5).alias("z"))


@query("latest_value", "{demand_obs} SELECT term, arg_max(value, day) AS value, max(day) AS day FROM demand_obs GROUP BY term")
def latest_value(spark, d):
    return O.latest_value(demand_obs(spark, d), ["term"], "day")


@query("last_row_per_key", "{run_log} SELECT source_id, run_id, ok FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY finished_at DESC, run_id DESC) AS rn FROM run_log) WHERE rn = 1")
def last_row_per_key(spark, d):
    return O.newest_rows(run_log(spark, d), ["source_id"], ["finished_at", "run_id"]).select("source_id", "run_id", "ok")


@query("keep_last_n", "SELECT conv_id AS page_id, turn AS version FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def keep_last_n(spark, d):
    return O.newest_rows(page_versions(spark, d), ["page_id"], ["version"], 3).select("page_id", "version")


@query("top_k_per_group", "{offers} SELECT kind, offer_id, price, rn FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY price, offer_id) AS rn FROM offers WHERE is_active) WHERE rn <= 8")
def top_k_per_group(spark, d):
    return O.first_rows(offers(spark, d).filter("is_active"), ["kind"], [F.asc("price"), F.asc("offer_id")], 8).select("kind", "offer_id", "price", F.col("rn").cast("long").alias("rn"))


@query("ordered_listing", "{findings} SELECT finding_id, severity, confidence FROM findings ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, confidence DESC, finding_id LIMIT 50 OFFSET 20")
def ordered_listing(spark, d):
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return findings(spark, d).orderBy(rank, F.desc("confidence"), "finding_id").offset(20).limit(50).select("finding_id", "severity", "confidence")


@query("first_per_key_by_price", "{sellers offers} SELECT item_id, seller_group, offer_id, price FROM (SELECT *, row_number() OVER (PARTITION BY item_id, seller_group ORDER BY price, offer_id) AS rn FROM offers JOIN sellers USING (seller_id)) WHERE rn = 1")
def first_per_key_by_price(spark, d):
    x = offers(spark, d).join(sellers(spark, d), "seller_id")
    return O.first_rows(x, ["item_id", "seller_group"], [F.asc("price"), F.asc("offer_id")]).select("item_id", "seller_group", "offer_id", "price")


@query("nearest_by_value", """{catalog} , t AS (SELECT item_id AS target_id, category, brand, price AS target_price FROM catalog WHERE capacity = 7)
    SELECT target_id, item_id, rn FROM (SELECT target_id, item_id, row_number() OVER (PARTITION BY target_id ORDER BY abs(price - target_price), item_id) AS rn FROM t JOIN catalog USING (category, brand)) WHERE rn <= 4""")
def nearest_by_value(spark, d):
    c = catalog(spark, d)
    t = c.filter("capacity = 7").select("category", "brand", F.col("item_id").alias("target_id"), F.col("price").alias("target_price"))
    return nearest(c, t, ["category", "brand"], "price", "target_price", "item_id").select("target_id", "item_id", F.col("rn").cast("long").alias("rn"))


@query("collapse_duplicates", """{offers} , x AS (SELECT *, lower(replace(name, ' ', '')) AS nk, round_even(price, -2) AS rp, 'u' || (item_id % 50) AS url FROM offers)
    SELECT offer_id, copies, urls FROM (SELECT offer_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY seller_id, nk, rp) AS copies, list_sort(list_distinct(list(url) OVER (PARTITION BY seller_id, nk, rp))) AS urls FROM x WHERE is_active
        WINDOW w AS (PARTITION BY seller_id, nk, rp ORDER BY offer_id)) WHERE rn = 1
    UNION ALL SELECT offer_id, 1, [url] FROM x WHERE NOT is_active""")
def collapse_duplicates(spark, d):
    x = offers(spark, d).withColumn("nk", F.lower(F.replace("name", F.lit(" "), F.lit("")))).withColumn("rp", F.bround("price", -2)).withColumn("url", F.concat(F.lit("u"), (F.col("item_id") % 50).cast("string")))
    return O.collapse_duplicates(x, ["seller_id", "nk", "rp"], [F.asc("offer_id")], F.col("is_active"), "url").select("offer_id", "copies", "urls")


@query("dedupe_by_page", """{offers} , x AS (SELECT *, item_id % 300 AS page, name || ' ' || capacity AS title FROM offers), r AS (SELECT *, row_number() OVER (PARTITION BY seller_id, page ORDER BY last_seen DESC, offer_id DESC) AS rn FROM x)
    SELECT a.offer_id, a.title, b.old_names FROM r a LEFT JOIN (SELECT seller_id, page, list_sort(list_distinct(list(title))) AS old_names FROM r WHERE rn > 1 AND regexp_matches(title, '[0-9]') GROUP BY 1, 2) b USING (seller_id, page) WHERE a.rn = 1""")
def dedupe_by_page(spark, d):
    x = offers(spark, d).withColumn("page", F.col("item_id") % 300).withColumn("title", F.concat_ws(" ", "name", F.col("capacity").cast("string")))
    return O.dedupe_by_page(x, ["seller_id", "page"], ["last_seen", "offer_id"], "title")[0].select("offer_id", "title", "old_names")


@query("by_day_and_top", "{price_obs} , " + MOVES + """ , days AS (SELECT observed_at::DATE::VARCHAR AS k, count(*) AS n FROM moves GROUP BY 1), top AS (SELECT seller_id::VARCHAR AS k, count(*) AS n FROM moves GROUP BY 1 ORDER BY n DESC, k LIMIT 4)
    SELECT 'day' AS what, k, n FROM days UNION ALL SELECT 'seller', k, n FROM top""")
def by_day_and_top(spark, d):
    m = O.price_moves(price_obs(spark, d), OBS_ORDER)
    days = m.groupBy(F.to_date("observed_at").cast("string").alias("k")).agg(F.count("*").alias("n"))
    top = m.groupBy(F.col("seller_id").cast("string").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(4)
    return days.select(F.lit("day").alias("what"), "k", "n").unionByName(top.select(F.lit("seller").alias("what"), "k", "n"))
