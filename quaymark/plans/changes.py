"""Queries of the change-tracking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as O
from ..sources.tables import KeyedTable
from .bindings import OBS_ORDER, catalog, demand_obs, findings, matches, offers, price_obs, read, run_log
from .registry import query

NEW_OFFERS = """nw AS (SELECT item_id, seller_id, name || '!' AS name, CASE WHEN offer_id % 3 = 0 THEN price * 1.1::DOUBLE ELSE price END AS price, availability, DATE '2005-01-01' AS seen FROM offers WHERE offer_id % 4 < 2), od AS (SELECT * FROM offers WHERE offer_id % 4 > 0)"""


def two_runs(spark, d):
    o = offers(spark, d)
    new = o.filter("offer_id % 4 < 2").select("item_id", "seller_id", F.concat("name", F.lit("!")).alias("name"), F.when(F.col("offer_id") % 3 == 0, F.col("price") * 1.1).otherwise(F.col("price")).alias("price"), "availability", F.lit("2005-01-01").cast("timestamp").alias("seen"))
    return o.filter("offer_id % 4 > 0"), new


@query("upsert_offers", "{offers} , " + NEW_OFFERS + """ SELECT item_id, seller_id, coalesce(od.name, nw.name) AS name, coalesce(nw.price, od.price) AS price, coalesce(nw.seen IS NOT NULL, false) OR coalesce(is_active, false) AS is_active,
    nw.seen IS NOT NULL AND (od.last_seen IS NULL OR od.price <> nw.price OR NOT od.is_active) AS changed FROM od FULL JOIN nw USING (item_id, seller_id)""")
def upsert_offers(spark, d):
    old, new = two_runs(spark, d)
    return O.upsert_offers(old.drop("offer_id"), new, ["item_id", "seller_id"], "seen").select("item_id", "seller_id", "name", "price", "is_active", "changed")


@query("upsert_keyed", """{demand_obs} , o AS (SELECT term, day, value FROM demand_obs WHERE day < DATE '2024-01-20'), n AS (SELECT term, day, value + (CASE WHEN term LIKE '%1' THEN 1 ELSE 0 END) AS value FROM demand_obs WHERE day >= DATE '2024-01-10')
    SELECT term, day, coalesce(n.value, o.value) AS value, CASE WHEN n.value IS NULL THEN 'kept' WHEN o.value IS NULL THEN 'inserted' WHEN o.value = n.value THEN 'unchanged' ELSE 'updated' END AS action FROM o FULL JOIN n USING (term, day)""")
def upsert_keyed(spark, d):
    x = demand_obs(spark, d).select("term", "day", "value")
    old = x.filter("day < DATE '2024-01-20'")
    new = x.filter("day >= DATE '2024-01-10'").withColumn("value", F.col("value") + F.when(F.col("term").endswith("1"), 1).otherwise(0))
    return O.upsert_keyed(old, new, ["term", "day"], ["value"])


UPSERT_TABLE = """{demand_obs} , o AS (SELECT term, day, value FROM demand_obs WHERE day < DATE '2024-01-20'), n AS (SELECT term, day, value + (CASE WHEN term LIKE '%1' THEN 1 ELSE 0 END) AS value FROM demand_obs WHERE day >= DATE '2024-01-10'),
    m AS (SELECT term, day, coalesce(n.value, o.value) AS value FROM o FULL JOIN n USING (term, day)) SELECT term, day, CASE WHEN day = DATE '2024-01-02' THEN 0 ELSE value END::DOUBLE AS value FROM m"""


@query("upsert_keyed_table", UPSERT_TABLE)
def upsert_keyed_table(spark, d):
    """Two upserts in a row into a table kept by buckets of its key."""
    x = demand_obs(spark, d).select("term", "day", "value")
    keys = ["term", "day"]
    stored = KeyedTable(x.filter("day < DATE '2024-01-20'"), keys, 16)
    merge = lambda old, new: O.upsert_keyed(old, new, keys).drop("action")
    stored.upsert(x.filter("day >= DATE '2024-01-10'").withColumn("value", F.col("value") + F.when(F.col("term").endswith("1"), 1).otherwise(0)), merge)
    return stored.upsert(x.filter("day = DATE '2024-01-02'").withColumn("value", F.lit(0.0)), merge)


@query("append_price_if_changed", "{price_obs} SELECT offer_id, observed_at, seq, price FROM (SELECT *, lag(price) OVER w AS p, lag(availability) OVER w AS a, row_number() OVER w AS rn FROM price_obs WINDOW w AS (PARTITION BY offer_id ORDER BY observed_at, seq, qty, price)) WHERE rn = 1 OR p IS DISTINCT FROM price OR a IS DISTINCT FROM availability")
def append_price_if_changed(spark, d):
    return O.price_history(price_obs(spark, d), "offer_id", OBS_ORDER).select("offer_id", "observed_at", "seq", "price")


@query("append_batch_if_changed", """{offers} SELECT offer_id, CASE WHEN offer_id % 2 = 0 THEN price + 1 ELSE price END AS price FROM offers WHERE offer_id % 2 = 0 OR offer_id % 5 = 0""")
def append_batch_if_changed(spark, d):
    o = offers(spark, d)
    new = o.select("offer_id", F.when(F.col("offer_id") % 2 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"), "availability")
    return O.append_if_changed(o.filter("offer_id % 5 <> 0"), new, "offer_id", "last_seen").select("offer_id", "price")


@query("expand_variants", "{catalog} SELECT item_id, name, price, NULL AS parent FROM catalog UNION ALL SELECT item_id * 10 + 1000000, name || ' S', price + 1, item_id FROM catalog WHERE capacity > 20")
def expand_variants(spark, d):
    v = F.array(F.struct((F.col("item_id") * 10 + 1000000).alias("id"), F.concat("name", F.lit(" S")).alias("name"), (F.col("price") + 1).alias("price")))
    c = catalog(spark, d).select("item_id", "name", "price", F.when(F.col("capacity") > 20, v).alias("variants"))
    return O.expand_variants(c, "variants", "item_id").select("item_id", "name", "price", "parent")


@query("gone_from_sitemap", """{offers} , x AS (SELECT offer_id, is_active, last_seen, item_id % 20 AS k FROM offers) SELECT offer_id, CASE WHEN k = 3 THEN true WHEN last_seen < TIMESTAMP '1998-01-01' AND k > 3 THEN false ELSE is_active END AS is_active FROM x""")
def gone_from_sitemap(spark, d):
    page = F.concat(F.lit("http://h/p"), (F.col("item_id") % 20).cast("string"))
    items = offers(spark, d).select("offer_id", "is_active", F.concat(page, F.lit("#"), F.col("seller_id").cast("string")).alias("url"), F.col("last_seen").alias("fetched_at"))
    urls = catalog(spark, d).select((F.col("item_id") % 20).alias("k"), page.alias("url")).distinct()
    return O.gone_from_sitemap(items, urls.filter("k < 3"), urls.filter("k = 3"), F.lit("1998-01-01").cast("timestamp"), 20).select("offer_id", "is_active")


@query("mark_disappeared", """{offers} , c AS (SELECT seller_id, count(*) AS n FROM offers WHERE offer_id % 3 = 0 GROUP BY 1) SELECT offer_id, coalesce(is_active AND offer_id % 3 <> 0 AND n > 10 AND last_seen < TIMESTAMP '2001-06-01' - INTERVAL 2 DAYS, false) AS disappeared FROM offers LEFT JOIN c USING (seller_id)""")
def mark_disappeared(spark, d):
    o = offers(spark, d)
    seen = o.filter("offer_id % 3 = 0")
    checks = seen.groupBy("seller_id").agg(F.count("*").alias("seen_count")).withColumn("ok", F.lit(True))
    return O.mark_disappeared(o, seen, checks, F.lit("2001-06-01").cast("timestamp")).select("offer_id", "disappeared")


@query("appeared_since_baseline", "{offers} SELECT offer_id, CASE WHEN NOT is_active THEN 'gone' WHEN first_seen::DATE > min(first_seen::DATE) OVER (PARTITION BY seller_id) THEN 'new' ELSE 'ok' END AS state FROM offers")
def appeared_since_baseline(spark, d):
    return O.appeared_since_baseline(offers(spark, d)).select("offer_id", "state")


EMIT = """st AS (SELECT dedupe_key, arg_max(finding_type, finding_id) AS finding_type, max(confidence) AS confidence, arg_max(status, finding_id) AS status FROM findings WHERE item_id % 500 < 350 GROUP BY 1), em AS (SELECT dedupe_key, arg_min(finding_type, finding_id) AS finding_type, min(confidence) AS confidence FROM findings WHERE item_id % 500 >= 200 GROUP BY 1)"""


def stored_and_emitted(spark, d):
    f = findings(spark, d)
    st = f.filter("item_id % 500 < 350").groupBy("dedupe_key").agg(F.max_by("finding_type", "finding_id").alias("finding_type"), F.max("confidence").alias("confidence"), F.max_by("status", "finding_id").alias("status"))
    em = f.filter("item_id % 500 >= 200").groupBy("dedupe_key").agg(F.min_by("finding_type", "finding_id").alias("finding_type"), F.min("confidence").alias("confidence"))
    return st, em


@query("emit_findings", "{findings} , " + EMIT + """ SELECT dedupe_key, CASE WHEN em.confidence IS NOT NULL AND coalesce(st.status, 'new') = 'new' THEN em.finding_type ELSE st.finding_type END AS finding_type, CASE WHEN em.confidence IS NOT NULL AND coalesce(st.status, 'new') = 'new' THEN em.confidence ELSE st.confidence END AS confidence,
    coalesce(st.status, 'new') AS status, em.confidence IS NOT NULL AND st.status IS NULL AS inserted FROM st FULL JOIN em USING (dedupe_key)""")
def emit_findings(spark, d):
    return O.emit_findings(*stored_and_emitted(spark, d))


@query("auto_close", "{findings} , " + EMIT + """ SELECT dedupe_key, finding_type, CASE WHEN status = 'new' AND (finding_type = 'LOW' OR finding_type IN ('URGENT', 'HIGH') AND dedupe_key NOT IN (SELECT dedupe_key FROM em)) THEN 'done' ELSE status END AS status,
    CASE WHEN status = 'new' AND finding_type = 'LOW' THEN 'type retired' WHEN status = 'new' AND finding_type IN ('URGENT', 'HIGH') AND dedupe_key NOT IN (SELECT dedupe_key FROM em) THEN 'no longer found' END AS comment FROM st""")
def auto_close(spark, d):
    return O.auto_close(*stored_and_emitted(spark, d), ["URGENT", "HIGH"], ["LOW"]).select("dedupe_key", "finding_type", "status", "comment")


@query("refresh_matches", """{offers matches} , o AS (SELECT *, CASE offer_id % 7 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' END AS review FROM matches WHERE offer_id % 3 > 0), n AS (SELECT offer_id, item_id, confidence - 0.05::DOUBLE AS confidence, CASE WHEN offer_id % 2 = 0 THEN 'identical' ELSE match_type END AS match_type FROM matches WHERE offer_id % 3 < 2),
    x AS (SELECT offer_id, item_id, review, coalesce(review IN ('confirmed', 'rejected'), false) AS human, o.confidence AS oc, o.match_type AS ot, n.confidence AS nc, n.match_type AS nt FROM o FULL JOIN n USING (offer_id, item_id)),
    y AS (SELECT *, CASE WHEN human THEN oc ELSE nc END AS confidence, CASE WHEN review = 'confirmed' THEN CASE WHEN nt = 'identical' THEN 'identical' ELSE ot END WHEN human THEN ot ELSE nt END AS match_type FROM x WHERE human OR nc IS NOT NULL)
    SELECT offer_id, item_id, confidence, match_type, review, NOT human AND confidence < 0.7 AND match_type IN ('exact', 'identical', 'direct', 'kit') AS needs_review FROM y""")
def refresh_matches(spark, d):
    m = matches(spark, d)
    old = m.filter("offer_id % 3 > 0").withColumn("review", F.when(F.col("offer_id") % 7 == 0, "confirmed").when(F.col("offer_id") % 7 == 1, "rejected"))
    new = m.filter("offer_id % 3 < 2").withColumn("confidence", F.col("confidence") - 0.05).withColumn("match_type", F.when(F.col("offer_id") % 2 == 0, "identical").otherwise(F.col("match_type")))
    return O.refresh_matches(old, new)


@query("label_rows_again", "{catalog} SELECT item_id, CASE WHEN category = 'PROMO' AND item_id % 2 = 0 THEN NULL ELSE coalesce(CASE WHEN item_id % 3 = 0 THEN category END, CASE WHEN contains(name, 'ring') THEN 'round' ELSE 'flat' END) END AS category FROM catalog")
def label_rows_again(spark, d):
    from ..operators.text import Rule, first_label

    c = catalog(spark, d)
    old = F.when(F.col("item_id") % 3 == 0, F.col("category"))
    out_of_scope = (F.col("category") == "PROMO") & (F.col("item_id") % 2 == 0)
    return c.select("item_id", F.when(~out_of_scope, F.coalesce(old, first_label([Rule("name", "ring", "round")], F.lit("flat")))).alias("category"))


@query("version_pages", "SELECT conv_id AS page_id, turn AS version, rn = 1 AS baseline FROM (SELECT *, role AS h, lag(role) OVER w AS b, row_number() OVER w AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE rn = 1 OR b <> h")
def version_pages(spark, d):
    v = read(spark, d, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("version"), F.sha1(F.col("role").cast("binary")).alias("digest"))
    return O.version_pages(v, "page_id", "version", "digest").select("page_id", "version", "baseline")


@query("failure_streaks", """{run_log} , x AS (SELECT *, sum(ok::INT) OVER (PARTITION BY source_id ORDER BY finished_at, run_id) AS island FROM run_log), s AS (SELECT source_id, island, count(*) FILTER (NOT ok) AS streak FROM x GROUP BY 1, 2)
    SELECT source_id, max(streak) AS longest, arg_max(streak, island) AS current, max(streak) >= 4 AS disabled FROM s GROUP BY 1""")
def failure_streaks(spark, d):
    return O.failure_streaks(run_log(spark, d))


@query("error_report", "SELECT 'u' || (user_id % 30) AS url, count(*) AS n, max(ts) AS last_at, arg_max(props, struct_pack(ts, event_id)) AS message FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def error_report(spark, d):
    e = read(spark, d, "events").filter("event_type = 'error'").select(F.concat(F.lit("u"), (F.col("user_id") % 30).cast("string")).alias("url"), F.col("ts").alias("at"), F.col("event_id").alias("error_id"), F.col("props").alias("message"))
    return O.error_report(e, F.lit("2024-01-15").cast("timestamp"))


@query("replace_partition_keep_manual", """SELECT p_partkey AS id, p_brand AS site, 'old' AS name, p_partkey % 5 = 0 AS manual FROM part WHERE p_partkey % 5 = 0 OR p_brand NOT IN ('Brand#1', 'Brand#2') UNION ALL SELECT p_partkey, p_brand, 'new', false FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_partkey % 2 = 0""")
def replace_partition_keep_manual(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("site"), F.lit("old").alias("name"), (F.col("p_partkey") % 5 == 0).alias("manual"))
    new = p.filter("site IN ('Brand#1', 'Brand#2') AND id % 2 = 0").withColumn("name", F.lit("new")).drop("manual")
    return O.replace_keep_manual(p, new, "site")


@query("staleness_check", "{run_log} SELECT source_id, max(finished_at) FILTER (ok) AS last_ok, coalesce(max(finished_at) FILTER (ok) < TIMESTAMP '2024-01-30' - INTERVAL 26 HOURS, true) AS stale FROM run_log GROUP BY 1")
def staleness_check(spark, d):
    return O.stale_sources(run_log(spark, d), F.lit("2024-01-30").cast("timestamp"))
