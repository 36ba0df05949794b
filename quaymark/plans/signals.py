"""Queries of the findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes
from ..operators import joins as J
from ..operators import signals as O
from ..operators.sizes import bounded
from ..shared import materialise
from .bindings import OBS_ORDER, catalog, demand_obs, findings, matches, offers, price_obs, read, run_log, sellers, stored_offers
from .joins import SITES, sites
from .registry import query
from .series import MOVES, RECENT, ZSCORE

PRICE_SIG = "SELECT m.offer_id, m.observed_at, m.seq, round_even(change, 6) AS change, CASE WHEN abs(change) >= 0.15 AND h.offer_id IS NOT NULL THEN 'high' WHEN abs(change) >= 0.07 THEN 'medium' ELSE 'low' END AS severity FROM moves m LEFT JOIN (SELECT DISTINCT offer_id FROM matches WHERE confidence >= 0.8) h USING (offer_id) WHERE abs(change) >= 0.03 AND observed_at > TIMESTAMP '1997-01-01' AND observed_at >= TIMESTAMP '2001-01-01' - INTERVAL 400 DAYS"


@query("signal_price_change", "{price_obs offers matches} , " + MOVES + " " + PRICE_SIG)
def signal_price_change(spark, d, o=None):
    x = O.price_change_signals(price_obs(spark, d), OBS_ORDER, matches(spark, d, o).filter("confidence >= 0.8"), F.lit("2001-01-01").cast("timestamp"), 400, F.lit("1997-01-01").cast("timestamp"))
    return x.select("offer_id", "observed_at", "seq", F.bround("change", 6).alias("change"), "severity")


@query("signal_appear_disappear", """{offers} , s AS (SELECT *, CASE WHEN NOT is_active THEN 'gone' WHEN first_seen::DATE > min(first_seen::DATE) OVER (PARTITION BY seller_id) THEN 'new' ELSE 'ok' END AS state FROM offers)
    SELECT offer_id, CASE WHEN state = 'gone' THEN 'disappeared' WHEN kind = 'ring' THEN 'new_kit' ELSE 'new_offer' END AS finding_type FROM s WHERE state <> 'ok'""")
def signal_appear_disappear(spark, d):
    return O.appearance_signals(changes.appeared_since_baseline(offers(spark, d)), F.col("kind") == "ring").select("offer_id", "finding_type")


@query("signal_new_category", "{catalog offers} SELECT category, seller_id, count(*) AS n, 'new_category' AS finding_type FROM offers WHERE category NOT IN (SELECT category FROM catalog WHERE category > 'M') GROUP BY 1, 2")
def signal_new_category(spark, d, o=None):
    from ..operators.aggregates import groups_outside

    own = catalog(spark, d).filter("category > 'M'").select("category").distinct()
    return groups_outside(offers(spark, d) if o is None else o, own, ["category", "seller_id"], "name", 0).select("category", "seller_id", "n", F.lit("new_category").alias("finding_type"))


@query("signal_new_seller", "{sellers offers} SELECT seller_id, created, 'new_seller' AS finding_type FROM (SELECT s.seller_id, min(first_seen) AS created FROM sellers s JOIN offers USING (seller_id) GROUP BY 1) WHERE created > TIMESTAMP '1995-01-10'")
def signal_new_seller(spark, d):
    s = offers(spark, d).groupBy("seller_id").agg(F.min("first_seen").alias("created"))
    return O.new_seller_signals(s, "created", F.lit("1995-01-10").cast("timestamp"))


COMP = "comp AS (SELECT m.item_id, offer_id, seller_id, seller_group, model_key, name, price, confidence, match_type FROM matches m JOIN offers o USING (offer_id) JOIN sellers USING (seller_id) WHERE is_active AND price >= 10 AND confidence >= 0.7 AND match_type IN ('exact', 'identical', 'direct'))".replace("m.item_id, offer_id, seller_id, seller_group, model_key, name, price", "m.item_id, m.offer_id, o.seller_id, seller_group, o.model_key, o.name, o.price")


@query("signal_price_vs_market", "{catalog sellers offers matches} , " + COMP + """ , m AS (SELECT item_id, median(price) AS median, count(*) AS n, count(DISTINCT seller_group) AS sellers, avg(confidence) AS ac FROM comp GROUP BY 1)
    SELECT item_id, round_even(price / median - 1, 6) AS gap, CASE WHEN price > median THEN 'above_market' ELSE 'below_market' END AS finding_type, CASE WHEN abs(price / median - 1) >= 0.2 THEN 'high' ELSE 'medium' END AS severity, round_even(least(ac + 0.15, 0.45 + 0.05 * n, 0.95), 6) AS confidence
    FROM catalog JOIN m USING (item_id) WHERE n >= 3 AND sellers >= 2 AND abs(price / median - 1) >= 0.1""")
def signal_price_vs_market(spark, d):
    x = O.market_price_signals(catalog(spark, d), offers(spark, d), matches(spark, d), sellers(spark, d))
    return x.select("item_id", F.bround("gap", 6).alias("gap"), "finding_type", "severity", F.bround("confidence", 6).alias("confidence"))


MOVED = "SELECT term, category, CASE WHEN change > 0 THEN 'growth' ELSE 'decline' END AS finding_type, CASE WHEN abs(change) >= 0.5 THEN 'medium' ELSE 'low' END AS severity, round_even(change, 5) AS size FROM recent WHERE abs(change) >= 0.25 AND least(recent, previous) >= 1"


@query("signal_demand_change", "{demand_obs} , " + RECENT + " " + MOVED)
def signal_demand_change(spark, d):
    return O.demand_signals(demand_obs(spark, d), "day", least_mean=1).filter("finding_type <> 'anomaly'").withColumn("size", F.bround("size", 5))


ANOMALY = "SELECT term, category, 'anomaly' AS finding_type, 'medium' AS severity, round_even(z, 5) AS size FROM (SELECT *, max(day) OVER (PARTITION BY term) AS last FROM z WHERE z >= 0.5 AND value >= 2 AND mean >= 1) WHERE day = last"


@query("signal_demand_anomaly", "{demand_obs} , " + ZSCORE + " " + ANOMALY)
def signal_demand_anomaly(spark, d):
    return O.demand_signals(demand_obs(spark, d), "day", z={"least_z": 0.5, "least_value": 2, "least_mean": 1}).filter("finding_type = 'anomaly'").withColumn("size", F.bround("size", 5))


GROWTH = "SELECT category, round_even(median(change), 6) AS change, count(*) AS terms, CASE WHEN category < 'l' THEN 'existing' ELSE 'gap' END AS kind FROM recent GROUP BY 1 HAVING count(*) >= 3 AND median(change) >= -0.5"


@query("signal_category_growth", "{demand_obs} , " + RECENT + " " + GROWTH)
def signal_category_growth(spark, d):
    own = read(spark, d, "events").select(F.col("event_type").alias("category")).filter("category < 'l'").distinct()
    return O.category_growth(demand_obs(spark, d), "day", own, change=-0.5).withColumn("change", F.bround("change", 6))


def use_cases(spark, d):
    """Texts, terms, and the terms that texts of several sources hold and own texts lack."""
    docs = read(spark, d, "documents").select("doc_id", "source", "text")
    t = read(spark, d, "benchmark").select(F.lower(F.split_part("text", F.lit(" "), F.lit(3))).alias("term")).filter(F.length("term") >= 6).distinct()
    return docs, t, J.mentions_gap(docs.filter("source <> 'src1'"), docs.filter("source = 'src1'"), t, "text", "source")


USE_CASES = """t AS (SELECT DISTINCT lower(split_part(text, ' ', 3)) AS term FROM benchmark WHERE length(split_part(text, ' ', 3)) >= 6), h AS (SELECT term, doc_id, source FROM documents JOIN t ON contains(lower(text), term) WHERE source <> 'src1'),
    g AS (SELECT term, count(DISTINCT source) AS sellers FROM h GROUP BY 1 HAVING count(DISTINCT source) >= 2 AND term NOT IN (SELECT term FROM documents JOIN t ON contains(lower(text), term) WHERE source = 'src1'))"""


@query("signal_use_case_gap", "WITH " + USE_CASES + " SELECT term, doc_id, rn FROM (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS rn FROM h JOIN g USING (term)) WHERE rn <= 10")
def signal_use_case_gap(spark, d):
    from ..operators.series import first_rows

    docs, t, gap = use_cases(spark, d)
    hits = docs.filter("source <> 'src1'").join(bounded(t), F.contains(F.lower("text"), F.col("term"))).join(gap, "term", "left_semi")
    return first_rows(hits.select("term", "doc_id"), ["term"], [F.asc("doc_id")], 10).select("term", "doc_id", F.col("rn").cast("long").alias("rn"))


@query("signal_cross_site", "{catalog} , " + SITES + """ SELECT item_id::VARCHAR AS key, 'price' AS issue FROM one o JOIN two t USING (item_id) WHERE abs(o.price - t.price) >= 1 AND NOT (abs(o.price - t.price) < 500 AND abs(o.price - t.price) / least(o.price, t.price) < 0.01) AND greatest(o.price, t.price) / least(o.price, t.price) <= 5
    UNION ALL SELECT sku, 'left' FROM one WHERE sku NOT IN (SELECT sku FROM two) UNION ALL SELECT sku, 'right' FROM two WHERE sku NOT IN (SELECT sku FROM one)""")
def signal_cross_site(spark, d):
    one, two = sites(spark, d)
    pairs = one.select("item_id", F.col("price").alias("a")).join(two.select("item_id", F.col("price").alias("b")), "item_id")
    gaps = J.price_gaps(pairs, "a", "b").select(F.col("item_id").cast("string").alias("key"), F.lit("price").alias("issue"))
    return gaps.unionByName(J.only_on_one_side(one, two, "sku").select(F.col("sku").alias("key"), F.col("side").alias("issue")))


@query("signal_source_error", """{run_log} , x AS (SELECT *, sum(ok::INT) OVER (PARTITION BY source_id ORDER BY finished_at, run_id) AS island FROM run_log), s AS (SELECT source_id, island, count(*) FILTER (NOT ok) AS streak FROM x GROUP BY 1, 2), l AS (SELECT source_id, arg_max(streak, island) AS current, max(streak) AS longest FROM s GROUP BY 1)
    SELECT source_id, current, longest, CASE WHEN current >= 2 THEN 'open' ELSE 'close' END AS verdict FROM l WHERE longest >= 2""")
def signal_source_error(spark, d):
    return O.source_error_signals(run_log(spark, d))


REASONS = """peer AS (SELECT category, kind, max(price / capacity) AS dear FROM catalog GROUP BY 1, 2), rs AS (SELECT brand, model_key FROM offers JOIN peer USING (category, kind) GROUP BY 1, 2 HAVING min(price / capacity) <= 0.75 * max(dear))"""


MULTI = "SELECT brand, model_key, count(DISTINCT seller_group) AS sellers FROM offers JOIN sellers USING (seller_id) JOIN rs USING (brand, model_key) WHERE (brand, model_key) NOT IN (SELECT brand, model_key FROM catalog WHERE item_id % 2 = 0) GROUP BY 1, 2 HAVING count(DISTINCT seller_group) >= 2"


MULTI_REASONS = MULTI.replace("count(DISTINCT seller_group) AS sellers", "count(DISTINCT seller_group) AS sellers, ['cheaper per unit'] AS reasons")


def multi_models(spark, d, o=None):
    c, o = catalog(spark, d), offers(spark, d) if o is None else o
    peer = c.groupBy("category", "kind").agg(F.max(F.col("price") / F.col("capacity")).alias("dear"))
    r = o.join(peer, ["category", "kind"]).groupBy("brand", "model_key").agg(F.min(F.col("price") / F.col("capacity")).alias("unit"), F.max("dear").alias("dear"))
    reasons = r.select("brand", "model_key", F.array_compact(F.array(F.when(F.col("unit") <= 0.75 * F.col("dear"), "cheaper per unit"))).alias("reasons"))
    own = c.filter("item_id % 2 = 0").select("brand", "model_key").distinct()
    return O.multi_seller_signals(o, sellers(spark, d), own, reasons).select("brand", "model_key", "sellers").join(reasons, ["brand", "model_key"])


@query("signal_multi_seller_model", "{catalog sellers offers} , " + REASONS + " " + MULTI)
def signal_multi_seller_model(spark, d):
    return multi_models(spark, d).drop("reasons")


@query("run_signals", "{catalog sellers offers price_obs demand_obs matches} , " + ", ".join((MOVES, RECENT, ZSCORE, REASONS, USE_CASES)) + """ , e AS (SELECT 'price:' || offer_id AS dedupe_key, 'price_change' AS finding_type FROM (""" + PRICE_SIG + """) UNION SELECT 'cat:' || category || ':' || seller_id, 'new_category' FROM offers WHERE category NOT IN (SELECT category FROM catalog WHERE category > 'M')
    UNION SELECT 'multi:' || brand || ':' || model_key, 'multi_seller_model' FROM (""" + MULTI + """) UNION SELECT 'demand:' || term, finding_type FROM (""" + MOVED + """) UNION SELECT 'anom:' || term, finding_type FROM (""" + ANOMALY + """) UNION SELECT 'usecase:' || term, 'use_case_gap' FROM g)
    SELECT dedupe_key, finding_type, CASE WHEN dedupe_key LIKE 'cat:E%' THEN 'seen' ELSE 'new' END AS status, dedupe_key NOT LIKE 'cat:E%' AS inserted FROM e""")
def run_signals(spark, d):
    o = stored_offers(spark, d)
    price = signal_price_change(spark, d, o).select(F.concat(F.lit("price:"), F.col("offer_id").cast("string")).alias("dedupe_key"), F.lit("price_change").alias("finding_type"))
    cat = materialise(signal_new_category(spark, d, o).select(F.concat_ws(":", F.lit("cat"), "category", F.col("seller_id").cast("string")).alias("dedupe_key"), "finding_type"))
    dem = signal_demand_change(spark, d).select(F.concat(F.lit("demand:"), F.col("term")).alias("dedupe_key"), "finding_type")
    odd = signal_demand_anomaly(spark, d).select(F.concat(F.lit("anom:"), F.col("term")).alias("dedupe_key"), "finding_type")
    multi = multi_models(spark, d, o).select(F.concat_ws(":", F.lit("multi"), "brand", "model_key").alias("dedupe_key"), F.lit("multi_seller_model").alias("finding_type"))
    use = use_cases(spark, d)[2].select(F.concat(F.lit("usecase:"), F.col("term")).alias("dedupe_key"), F.lit("use_case_gap").alias("finding_type"))
    every = price.unionByName(cat).unionByName(multi).unionByName(dem).unionByName(odd).unionByName(use).distinct()
    stored = cat.filter("dedupe_key LIKE 'cat:E%'").withColumn("status", F.lit("seen"))
    return changes.emit_findings(stored, every)


DECISIONS = "dec AS (SELECT lang AS finding_type, CASE WHEN source <> 'src0' THEN source END AS category, quality AS decision, doc_id FROM labels JOIN documents USING (doc_id))"


def decided(spark, d):
    return read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id").select(F.col("lang").alias("finding_type"), F.when(F.col("source") != "src0", F.col("source")).alias("category"), F.col("quality").alias("decision"), "doc_id")


@query("calibrate_confidence", "WITH " + DECISIONS + """ , a AS (SELECT finding_type, category, count(*) AS n, sum(decision) AS c FROM dec GROUP BY 1, 2 HAVING count(*) >= 3), b AS (SELECT finding_type, count(*) AS n, sum(decision) AS c FROM dec GROUP BY 1 HAVING count(*) >= 3), f AS (SELECT doc_id, lang AS finding_type, CASE WHEN source <> 'src0' THEN source END AS category, 0.3::DOUBLE + doc_id % 60 / 100.0::DOUBLE AS confidence FROM documents)
    SELECT doc_id, round_even(least(greatest(confidence * coalesce(0.6::DOUBLE + 0.55::DOUBLE * (a.c + 1) / (a.n + 2), 0.6::DOUBLE + 0.55::DOUBLE * (b.c + 1) / (b.n + 2), 1), 0.2), 0.98), 6) AS calibrated FROM f LEFT JOIN a ON f.finding_type = a.finding_type AND f.category IS NOT DISTINCT FROM a.category LEFT JOIN b ON f.finding_type = b.finding_type""")
def calibrate_confidence(spark, d):
    f = read(spark, d, "documents").select("doc_id", F.col("lang").alias("finding_type"), F.when(F.col("source") != "src0", F.col("source")).alias("category"), (0.3 + F.col("doc_id") % 60 / F.lit(100.0)).alias("confidence"))
    return O.calibrate(f, decided(spark, d)).select("doc_id", F.bround("calibrated", 6).alias("calibrated"))


@query("feedback_stats", "WITH " + DECISIONS + " SELECT finding_type, category, count(*) AS n, sum(decision)::BIGINT AS confirmed, round_even((sum(decision) + 1) / (count(*) + 2)::DOUBLE, 6) AS rate FROM dec GROUP BY GROUPING SETS ((finding_type), (finding_type, category))")
def feedback_stats(spark, d):
    return O.feedback_stats(decided(spark, d))


@query("propagate_feedback", """{findings} , dc AS (SELECT unnest([doc_id, doc_id + 1]) AS finding_id, quality AS decision, doc_id AS tm FROM labels), l AS (SELECT finding_id, arg_max(decision, struct_pack(tm, decision)) AS decision FROM dc GROUP BY 1)
    SELECT item_id AS offer_id, finding_id, decision, CASE WHEN decision = 1 THEN 'confirmed' ELSE 'flagged' END AS review FROM findings JOIN l USING (finding_id)""")
def propagate_feedback(spark, d):
    dec = read(spark, d, "labels").select(F.array(F.col("doc_id"), F.col("doc_id") + 1).alias("evidence"), F.col("quality").alias("decision"), F.col("doc_id").alias("at"))
    return O.propagate_feedback(dec, "evidence", findings(spark, d).select(F.col("item_id").alias("offer_id"), "finding_id"))
