"""Queries of verdicts, reports and comparisons; ``price_review`` is the flagship."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import decisions as O
from ..shared import materialise
from .bindings import catalog, demand_obs, findings, matches, offers, read, sellers, stored_offers
from . import signals as S
from .registry import query
from .series import MOVES, RECENT
from .signals import COMP
from .text import RETAIL

COMP6 = COMP.replace("confidence >= 0.7", "confidence >= 0.6")
REVIEW = COMP6 + """ , ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, seller_group, model_key ORDER BY price, offer_id) AS rn FROM comp) WHERE rn = 1), l AS (SELECT item_id, median(price) AS lm, count(*) AS ln FROM ch GROUP BY 1),
    f AS (SELECT item_id, median(price) AS m, count(*) AS n, count(DISTINCT seller_group) AS sellers, bool_and(match_type IN ('exact', 'identical')) AS sure FROM ch WHERE confidence >= 0.7 GROUP BY 1),
    j AS (SELECT *, coalesce(n < 3 OR sellers < 2, true) AND ln >= 3 AS approx FROM l LEFT JOIN f USING (item_id)), k AS (SELECT *, CASE WHEN approx THEN lm ELSE m END AS market, CASE WHEN approx THEN ln ELSE n END AS offers FROM j),
    v AS (SELECT c.item_id, c.price, k.market, k.offers, k.approx, CASE WHEN c.price / market - 1 > 0.1 THEN 'lower' WHEN c.price / market - 1 < -0.1 THEN 'raise' ELSE 'keep' END AS verdict FROM catalog c JOIN k USING (item_id) WHERE approx OR k.offers >= 3 OR k.offers >= 2 AND sure),
    review AS (SELECT *, CASE verdict WHEN 'lower' THEN """ + RETAIL.format("market") + " WHEN 'raise' THEN greatest(price, " + RETAIL.format("least(0.95 * market, price * CASE WHEN approx THEN 1.15 ELSE 1.25 END)") + ") ELSE price END AS recommended FROM v)"


def review(spark, d, o=None):
    return O.price_review(catalog(spark, d), offers(spark, d) if o is None else o, matches(spark, d, o), sellers(spark, d))


@query("price_review", "{catalog sellers offers matches} , " + REVIEW + " SELECT item_id, round_even(market, 6) AS market, offers, approx, verdict, round_even(recommended, 6) AS recommended FROM review")
def price_review(spark, d):
    return review(spark, d).select("item_id", F.bround("market", 6).alias("market"), "offers", "approx", "verdict", F.bround("recommended", 6).alias("recommended"))


@query("recommended_price", "{catalog} SELECT item_id, verdict, CASE verdict WHEN 'lower' THEN " + RETAIL.format("m") + " WHEN 'raise' THEN greatest(price, " + RETAIL.format("least(0.95 * m, price * CASE WHEN capacity < 20 THEN 1.15 ELSE 1.25 END)") + ") ELSE price END AS recommended FROM (SELECT *, price * (0.7::DOUBLE + capacity / 60.0::DOUBLE) AS m, ['lower', 'raise', 'keep'][(item_id % 3 + 1)::INT] AS verdict FROM catalog)")
def recommended_price(spark, d):
    c = catalog(spark, d).withColumn("m", F.col("price") * (0.7 + F.col("capacity") / F.lit(60.0))).withColumn("verdict", F.element_at(F.array(F.lit("lower"), F.lit("raise"), F.lit("keep")), (F.col("item_id") % 3 + 1).cast("int")))
    return c.select("item_id", "verdict", O.recommended_price(F.col("verdict"), F.col("price"), F.col("m"), F.col("capacity") < 20).alias("recommended"))


@query("decision_staleness", "{catalog sellers offers matches} , " + REVIEW + " SELECT item_id, verdict, CASE WHEN item_id % 2 = 0 THEN 'done' END AS decision, item_id % 2 = 0 AND verdict <> 'lower' AS stale FROM review")
def decision_staleness(spark, d):
    dec = catalog(spark, d).filter("item_id % 2 = 0").select("item_id", F.lit("done").alias("decision"), F.lit("lower").alias("verdict"))
    return O.decision_staleness(review(spark, d), dec).select("item_id", "verdict", "decision", "stale")


def with_facts(df, id_col):
    """Rows with facts and a brand that may be missing, all following from their ids."""
    i = F.col(id_col)
    return df.withColumns({
        "range_m": F.when(i % 7 != 0, i % 50 * 10), "channels": i % 40, "battery_h": (i % 30).cast("double"), "weight_g": F.when(i % 5 != 0, 20 + i % 60), "two_way": i % 11 == 0,
        "band": F.element_at(F.array(F.lit("2.4 GHz"), F.lit("UHF"), F.lit(None)), (i % 3 + 1).cast("int"))})


def facts_sql(name, source, i, more=""):
    return f"""{name} AS (SELECT *, CASE WHEN {i} % 7 <> 0 THEN {i} % 50 * 10 END AS range_m, {i} % 40 AS channels, ({i} % 30)::DOUBLE AS battery_h, CASE WHEN {i} % 5 <> 0 THEN 20 + {i} % 60 END AS weight_g, {i} % 11 = 0 AS two_way,
    ['2.4 GHz', 'UHF', NULL][({i} % 3 + 1)::INT] AS band, CASE WHEN kind = 'ring' THEN price / capacity ELSE price END AS unit{more} FROM {source})"""


STATS = """count(*) AS peers, min(p.unit) AS b_unit, max(p.range_m) AS b_range_m, max(p.channels) AS b_channels, max(p.battery_h) AS b_battery_h, min(p.weight_g) AS b_weight_g, bool_or(p.two_way) AS b_two_way, bool_or(p.band IS NULL OR p.band = '2.4 GHz') AS b_digital, arg_min(struct_pack(item_id := p.item_id, unit := coalesce(p.unit, p.price)), struct_pack(a := p.price, b := p.item_id)) AS best"""


def reasons_sql(m, b, b_unit, spec="true"):
    tests = [("range", f"{m}.range_m >= 1.3 * {b}.b_range_m"), ("channels", f"{m}.channels >= 1.3 * {b}.b_channels"), ("battery", f"{m}.battery_h >= 1.3 * {b}.b_battery_h"), ("weight", f"{m}.weight_g <= 0.7 * {b}.b_weight_g"),
             ("two-way", f"{m}.two_way AND NOT {b}.b_two_way"), ("digital band", f"{m}.band = '2.4 GHz' AND NOT {b}.b_digital")]
    return f"list_filter([CASE WHEN {m}.unit <= 0.75 * {b_unit} THEN 'unit price' END, " + ", ".join(f"CASE WHEN {spec} AND {t} THEN '{n}' END" for n, t in tests) + "], lambda v: v IS NOT NULL)"


def unit():
    return F.when(F.col("kind") == "ring", F.col("price") / F.col("capacity")).otherwise(F.col("price"))


def peers_of(spark, d):
    return with_facts(catalog(spark, d).filter("item_id % 3 = 0"), "item_id")  # the own side of the comparison


def priced_offers(spark, d):
    return with_facts(offers(spark, d).withColumn("price", F.col("price") * (0.4 + F.col("offer_id") % 7 / F.lit(10.0))), "offer_id")


PEERS = facts_sql("pe", "(SELECT * FROM catalog WHERE item_id % 3 = 0)", "item_id")
PRICED = facts_sql("po", "(SELECT * REPLACE (price * (0.4::DOUBLE + offer_id % 7 / 10.0::DOUBLE) AS price) FROM offers)", "offer_id")
NEAR = "SELECT k.category, k.kind, k.capacity, " + STATS + " FROM (SELECT DISTINCT category, kind, capacity FROM {m} WHERE kind = 'ring' AND capacity IS NOT NULL) k JOIN pe p ON p.category = k.category AND p.kind = k.kind AND abs(p.capacity - k.capacity) <= greatest(2, 0.2 * k.capacity) GROUP BY 1, 2, 3"
MODELS = """kn AS (SELECT brand, model_key, category, kind, row_number() OVER (PARTITION BY brand, model_key, category ORDER BY count(*) DESC, kind DESC) AS rn FROM po GROUP BY 1, 2, 3, 4),
    mf AS (SELECT brand, model_key, category, kind, count(*) AS offers, arg_min(unit, o) AS unit, arg_min(capacity, o) AS capacity, """ + ", ".join(f"coalesce(first({f} ORDER BY o), arg_min({f}, offer_id)) AS {f}" for f in ("range_m", "channels", "battery_h", "weight_g", "band")) + """, bool_or(two_way) AS two_way
        FROM (SELECT po.*, struct_pack(a := po.unit, b := offer_id) AS o FROM po JOIN kn USING (brand, model_key, category, kind) WHERE rn = 1) GROUP BY 1, 2, 3, 4)"""


@query("justify_model", "{catalog offers} , " + PEERS + ", " + PRICED + ", " + MODELS + ", st AS (SELECT category, kind, " + STATS + " FROM pe p GROUP BY 1, 2), nr AS (" + NEAR.format(m="mf") + """), j AS (SELECT mf.*, coalesce(st.peers, 0) AS peers, """ + reasons_sql("mf", "st", "CASE WHEN mf.kind = 'ring' THEN nr.b_unit ELSE st.b_unit END") + """ AS reasons
    FROM mf LEFT JOIN st USING (category, kind) LEFT JOIN nr ON nr.category = mf.category AND nr.kind = mf.kind AND nr.capacity = mf.capacity) SELECT brand, model_key, category, kind, peers::BIGINT AS peers, reasons, CASE WHEN len(reasons) > 0 THEN 'consider' WHEN peers = 0 THEN 'nothing to compare' ELSE 'no advantage' END AS verdict FROM j""")
def justify_model(spark, d):
    m = O.model_facts(priced_offers(spark, d), ["brand", "model_key", "category"], unit())
    return O.justify_model(m, peers_of(spark, d).withColumn("unit", unit())).select("brand", "model_key", "category", "kind", "peers", "reasons", "verdict")


BARE = "(SELECT * REPLACE (CASE WHEN offer_id % 3 > 0 THEN model_key END AS model_key, CASE WHEN item_id % 10 <> 0 THEN lower(brand) END AS brand, CASE WHEN item_id % 4 = 0 THEN category || '2' ELSE category END AS category) FROM po JOIN sellers USING (seller_id) WHERE price >= 10)"
CAND = """g AS (SELECT brand, coalesce(model_key, lower(name)) AS model, category, kind, count(DISTINCT seller_group) AS sellers, count(*) AS offers, min(price) AS least, median(price) AS median, max(price) AS most, arg_min(capacity, struct_pack(price, offer_id)) AS capacity, min(unit) AS unit, max(range_m) AS range_m, max(channels) AS channels,
        max(battery_h) AS battery_h, min(weight_g) AS weight_g, bool_or(two_way) AS two_way, arg_min(band, struct_pack(price, offer_id)) AS band, bool_or(model_key IS NOT NULL) AS coded FROM """ + BARE + """ GROUP BY 1, 2, 3, 4),
    nr AS (""" + NEAR.format(m="g") + """), sk AS (SELECT category, kind, """ + STATS + """ FROM pe p GROUP BY 1, 2), sc AS (SELECT category, """ + STATS + """ FROM pe p GROUP BY 1), sa AS (SELECT kind, """ + STATS + """ FROM pe p GROUP BY 1),
    x AS (SELECT g.*, sc.peers IS NOT NULL AS in_category, g.kind = 'ring' AND g.capacity IS NOT NULL AS sized, sk.peers IS NULL AND sc.peers IS NOT NULL AND NOT (g.kind = 'ring' AND g.capacity IS NOT NULL) AS lacks, sk.peers AS kp, nr AS nr, sk AS sk, sc AS sc, sa AS sa, upper(model) IN (SELECT upper(model_key) FROM pe) AS own
        FROM g LEFT JOIN nr ON nr.category = g.category AND nr.kind = g.kind AND nr.capacity = g.capacity LEFT JOIN sk ON sk.category = g.category AND sk.kind = g.kind LEFT JOIN sc ON sc.category = g.category LEFT JOIN sa ON sa.kind = g.kind),
    y AS (SELECT *, CASE WHEN sized THEN kp IS NOT NULL AND nr.peers IS NULL ELSE lacks AND kind IN ('ring', 'gear') END AS gap, """ + ", ".join(
        f"CASE WHEN sized THEN nr.{f} WHEN NOT lacks THEN sk.{f} WHEN kind IN ('ring', 'gear') THEN NULL WHEN kind IN ('bolt', 'rod') THEN coalesce(sa.{f}, sc.{f}) ELSE sc.{f} END AS {f}" for f in ("peers", "b_unit", "b_range_m", "b_channels", "b_battery_h", "b_weight_g", "b_two_way", "b_digital", "best")) + """ FROM x),
    z AS (SELECT *, """ + reasons_sql("y", "y", "y.b_unit", "kind NOT IN ('bolt', 'rod')") + """ AS reasons FROM y), v AS (SELECT *, CASE WHEN NOT in_category OR gap THEN 'gap' WHEN peers IS NULL THEN 'no_data' WHEN own THEN 'covered' WHEN len(reasons) > 0 THEN 'consider' ELSE 'covered' END AS verdict FROM z)"""


@query("assortment_candidates", "{catalog sellers offers} , " + PEERS + ", " + PRICED + ", " + CAND + """ SELECT brand, model, category, kind, capacity, sellers, offers, least, median, most, best.item_id AS peer_id, round_even((unit - best.unit) / best.unit * 100, 2) AS unit_gap, reasons, verdict,
    round_even(CASE verdict WHEN 'gap' THEN 3 WHEN 'consider' THEN 2 WHEN 'no_data' THEN 0.5 ELSE 0 END + 0.5 * sellers + 0.3 * len(reasons) - CASE WHEN brand IS NULL AND NOT coded THEN 1 ELSE 0 END, 4)::DOUBLE AS score FROM v""")
def assortment_candidates(spark, d):
    i = F.col("item_id")
    o = priced_offers(spark, d).withColumns({
        "model_key": F.when(F.col("offer_id") % 3 > 0, F.col("model_key")), "brand": F.when(i % 10 != 0, F.col("brand")), "category": F.when(i % 4 == 0, F.concat("category", F.lit("2"))).otherwise(F.col("category"))})
    return O.assortment_candidates(o, sellers(spark, d), peers_of(spark, d), F.lower("name"), unit(), main=["gear"], accessories=["bolt", "rod"])


@query("category_position", """{catalog offers} , mine AS (SELECT category, kind, min(price) AS ol FROM catalog GROUP BY 1, 2), p AS (SELECT category, kind, count(*) AS n, round_even(avg((price < ol)::INT) * 100, 2) AS s FROM offers JOIN mine USING (category, kind) GROUP BY 1, 2)
    SELECT category, max(s) AS worst, arg_max(kind, struct_pack(s, kind)) AS worst_kind, sum(n)::BIGINT AS offers, CASE WHEN sum(n) < 3 THEN 'no_data' WHEN max(s) >= 50 THEN 'attention' WHEN max(s) >= 20 THEN 'watch' ELSE 'ok' END AS verdict FROM p GROUP BY 1""")
def category_position(spark, d):
    return O.category_position(A.position_share(offers(spark, d), catalog(spark, d), ["category", "kind"]))


@query("compare_table", """{catalog} , c AS (SELECT category, item_id, price::DOUBLE AS price, capacity::DOUBLE AS capacity, kind FROM (SELECT *, row_number() OVER (PARTITION BY category, brand, name, capacity ORDER BY item_id) AS rn FROM catalog) WHERE rn = 1), l AS (SELECT category, item_id, 'price' AS field, price AS value FROM c UNION ALL SELECT category, item_id, 'capacity', capacity FROM c)
    SELECT category, item_id, field, value, value = CASE WHEN field = 'price' THEN min(value) OVER w ELSE max(value) OVER w END AS best, NULL AS text FROM l WINDOW w AS (PARTITION BY category, field) UNION ALL SELECT category, item_id, 'kind', NULL, NULL, kind FROM c""")
def compare_table(spark, d):
    c = catalog(spark, d).withColumn("specs", F.create_map(F.lit("kind"), F.col("kind")))
    return O.compare_table(c, ["category"], "item_id", ["price", "capacity"], same=["brand", "name", "capacity"], raw="specs")


def detected(spark, d, o):
    """What the detectors find among stored offers, as the rules of actions and ideas take it."""
    multi = materialise(S.multi_models(spark, d, o).withColumn("confidence", F.lit(0.7)))
    growth = materialise(S.signal_category_growth(spark, d).withColumn("confidence", F.lit(0.5)))
    use = S.use_cases(spark, d)[2].select("term")
    drops = S.signal_price_change(spark, d, o).filter("change < 0").groupBy("offer_id").agg(F.max(F.when(F.col("severity") == "high", "high").otherwise("low")).alias("severity"), F.max(-F.col("change")).alias("confidence"))
    drops = drops.join(matches(spark, d, o).select("offer_id", "item_id"), "offer_id").join(catalog(spark, d).select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("model_key")).alias("model_key"), "kind"), "item_id")
    return multi, materialise(S.signal_new_category(spark, d, o).select("category", "seller_id")), growth, use, drops


DETECTED = ", ".join((MOVES, RECENT, S.REASONS, S.USE_CASES)) + """ , ml AS (""" + S.MULTI_REASONS + """), nc AS (SELECT DISTINCT category, seller_id FROM offers WHERE category NOT IN (SELECT category FROM catalog WHERE category > 'M')), gr AS (""" + S.GROWTH + """),
    dr AS (SELECT offer_id, CASE WHEN bool_or(severity <> 'high') THEN 'low' ELSE 'high' END AS severity, max(-change) AS confidence, item_id, CASE WHEN item_id % 2 = 0 THEN c.model_key || ':' || c.kind ELSE 'item:' || item_id END AS family FROM (""" + S.PRICE_SIG + """) JOIN matches USING (offer_id) JOIN catalog c USING (item_id) WHERE change < 0 GROUP BY offer_id, item_id, c.model_key, c.kind)"""
BEST = "list_transform(list_sort(list(struct_pack(a := -confidence, b := {id})))[1:{n}], lambda s: s.b::VARCHAR)"
ACTIONS = """ac AS (SELECT 'model:' || brand || ':' || model_key AS dedupe_key, 'purchasing' AS owner, 'P2' AS priority, sellers AS n, 0.7::DOUBLE AS confidence, reasons AS evidence FROM ml WHERE sellers >= 3 AND len(reasons) > 0
    UNION ALL SELECT 'category:' || category || ':' || count(*), 'product', 'P3', count(*), 0.6, list_transform(list_sort(list(seller_id))[1:8], lambda s: s::VARCHAR) FROM nc GROUP BY category HAVING count(*) >= 2
    UNION ALL SELECT 'growth:' || category, CASE WHEN kind = 'existing' THEN 'marketing' ELSE 'product' END, 'P2', terms, 0.5, [change::VARCHAR] FROM gr
    UNION ALL SELECT 'usecases', 'marketing', 'P2', count(*), 0.6, list_sort(list(term))[1:8] FROM g HAVING count(*) > 0
    UNION ALL SELECT 'drop:' || family, 'pricing', CASE WHEN bool_or(severity = 'high') THEN 'P2' ELSE 'P3' END, count(*), max(confidence), """ + BEST.format(id="offer_id", n=6) + """ FROM dr GROUP BY family)"""
NAMES = "list_sort(list_distinct(list(seller)))[1:8]"
IDEAS = """cats AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT category FROM catalog)), dm AS (SELECT term, cats.category, count(*) AS n FROM demand_obs JOIN cats ON k = right(term, 1)::INT % m GROUP BY 1, 2),
    tm AS (SELECT category, list(term ORDER BY n DESC, term)[1:5] AS terms FROM dm GROUP BY 1), id AS (SELECT 'category:' || category AS dedupe_key, findings, least, most, upper_median, coalesce(offers, 0) AS offers, coalesce(terms, []) AS terms, who AS sellers
        FROM (SELECT category, count(*) AS findings, """ + NAMES + """ AS who FROM nc JOIN sellers USING (seller_id) GROUP BY 1 HAVING count(*) >= 2) LEFT JOIN (SELECT category, min(price) AS least, max(price) AS most, list_sort(list(price))[(len(list(price)) // 2 + 1)::INT] AS upper_median, count(price) AS offers FROM offers GROUP BY 1) USING (category) LEFT JOIN tm USING (category)
    UNION ALL SELECT 'model:' || brand || ':' || model_key, ml.sellers, least, most, upper_median, offers, [], who FROM ml JOIN (SELECT brand, model_key, min(price) AS least, max(price) AS most, list_sort(list(price))[(len(list(price)) // 2 + 1)::INT] AS upper_median, count(price) AS offers, """ + NAMES + """ AS who FROM offers JOIN sellers USING (seller_id) GROUP BY 1, 2) USING (brand, model_key) WHERE ml.sellers >= 2 AND len(reasons) > 0
    UNION ALL SELECT 'growth:' || category, terms, NULL, NULL, NULL, 0, [], [] FROM gr WHERE kind = 'gap' UNION ALL SELECT 'substitutes', count(*), NULL, NULL, NULL, 0, [], """ + NAMES + """ FROM sellers WHERE tier = 'C' HAVING count(*) > 0)"""


def actions(found):
    return O.generate_actions(*found)


def ideas(spark, d, o, found):
    multi, new, growth, _, _ = found
    cats = catalog(spark, d).select("category").distinct()
    cats = cats.withColumn("k", F.row_number().over(Window.orderBy("category")) - 1).withColumn("m", F.count("*").over(Window.partitionBy(F.lit(1))))  # a few kinds of categories
    demand = demand_obs(spark, d).groupBy("term").agg(F.count("*").alias("n")).join(cats, F.substring("term", -1, 1).cast("int") % F.col("m") == F.col("k"))
    return O.generate_ideas(new, multi, growth, sellers(spark, d).filter("tier = 'C'"), o, sellers(spark, d), demand)


@query("generate_actions", "{catalog sellers offers price_obs demand_obs matches} , " + DETECTED + ", " + ACTIONS + " SELECT dedupe_key, owner, priority, n::BIGINT AS n, round_even(confidence, 6) AS confidence, CASE WHEN dedupe_key LIKE 'growth%' THEN [] ELSE evidence END AS evidence FROM ac")
def generate_actions(spark, d):
    return actions(detected(spark, d, stored_offers(spark, d))).select("dedupe_key", "owner", "priority", "n", F.bround("confidence", 6).alias("confidence"), F.when(F.col("dedupe_key").startswith("growth"), F.array()).otherwise(F.col("evidence")).alias("evidence"))


@query("generate_ideas", "{catalog sellers offers price_obs demand_obs matches} , " + DETECTED + ", " + IDEAS + " SELECT * REPLACE (findings::BIGINT AS findings) FROM id")
def generate_ideas(spark, d):
    o = stored_offers(spark, d)
    return ideas(spark, d, o, detected(spark, d, o))


KINDS = {"prices": ["URGENT"], "products": ["HIGH", "MEDIUM"], "demand": ["LOW"], "gaps": ["MEDIUM"], "errors": ["NOT SPECIFIED"]}
fs = lambda name, where, n: f"SELECT '{name}' AS section, row_number() OVER (ORDER BY w, confidence DESC, finding_id) AS rank, finding_id::VARCHAR AS key, confidence AS value, {n} AS most FROM cf WHERE {where}"
among = lambda name: "finding_type IN (" + ", ".join(f"'{k}'" for k in KINDS[name]) + ")"


@query("periodic_report", "{catalog sellers offers price_obs demand_obs matches findings} , " + REVIEW + ", " + DETECTED + ", " + ACTIONS + ", " + IDEAS + """, cf AS (SELECT *, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS w FROM findings WHERE created_at >= TIMESTAMP '1998-07-01' OR (SELECT max(created_at) FROM findings) < TIMESTAMP '1998-07-01')
    SELECT section, rank, key, round_even(value, 6) AS value FROM (""" + " UNION ALL ".join([
        fs("top", "NOT " + among("errors"), 5), fs("price changes", among("prices"), 15), fs("products", among("products"), 15), fs("demand", among("demand"), 15), fs("gaps", among("gaps"), 15), fs("risks", "severity = 'high'", 8),
        "SELECT 'own prices', row_number() OVER (ORDER BY CASE verdict WHEN 'lower' THEN 0 ELSE 1 END, item_id), item_id::VARCHAR, recommended, 10 FROM review WHERE verdict <> 'keep'", "SELECT 'ideas', row_number() OVER (ORDER BY findings DESC, dedupe_key), dedupe_key, findings, 8 FROM id",
        "SELECT 'owner decisions', row_number() OVER (ORDER BY priority, dedupe_key), dedupe_key, confidence, 8 FROM ac WHERE priority = 'P1' OR owner = 'purchasing'", "SELECT 'next', row_number() OVER (ORDER BY priority, dedupe_key), dedupe_key, confidence, 12 FROM ac"]) + ") WHERE rank <= most")
def periodic_report(spark, d):
    o = stored_offers(spark, d)
    found = detected(spark, d, o)
    s = O.report_sections(findings(spark, d), F.lit("1998-07-01").cast("timestamp"), KINDS, review(spark, d, o), materialise(actions(found)), ideas(spark, d, o, found))
    return O.periodic_report(s).withColumn("rank", F.col("rank").cast("long")).withColumn("value", F.bround("value", 6))


FEATURES = "ft AS (SELECT s_name AS seller, 'f' || (s_suppkey * k % 9) AS field, max(s_suppkey * k % 5)::VARCHAR AS value FROM supplier, (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1, 2)"


def features(spark, d):
    s = read(spark, d, "supplier").select("s_name", "s_suppkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    return s.groupBy(F.col("s_name").alias("seller"), F.concat(F.lit("f"), (F.col("s_suppkey") * F.col("k") % 9).cast("string")).alias("field")).agg(F.max(F.col("s_suppkey") * F.col("k") % 5).cast("string").alias("value"))


NAMES = [f"Supplier#{i:09d}" for i in range(4)]


@query("feature_comparison", "WITH " + FEATURES + " SELECT field, " + ", ".join(f"max(value) FILTER (seller = '{n}') AS \"{n}\"" for n in NAMES) + ", " + " + ".join(f"count(DISTINCT seller) FILTER (seller = '{n}')" for n in NAMES[1:]) + f" AS others, max(value) FILTER (seller = '{NAMES[0]}') IS NULL AND " + "(" + " + ".join(f"count(DISTINCT seller) FILTER (seller = '{n}')" for n in NAMES[1:]) + ") > 0 AS better FROM (SELECT seller, field, CASE WHEN field = 'f3' AND seller = 'Supplier#000000001' THEN 'manual' ELSE value END AS value FROM ft UNION ALL SELECT 'Supplier#000000001', 'f3', 'manual') GROUP BY field")
def feature_comparison(spark, d):
    manual = spark.createDataFrame([("Supplier#000000001", "f3", "manual")], "seller string, field string, value string")
    return O.feature_comparison(features(spark, d), manual, NAMES[0], NAMES[1:]).withColumn("others", F.col("others").cast("long"))


@query("feature_gaps", "WITH " + FEATURES + """, own AS (SELECT field FROM ft WHERE seller = 'Supplier#000000001'), c AS (SELECT field, count(DISTINCT seller) AS n, array_to_string(list_sort(list_distinct(list(seller))), ', ') AS sellers, list_sort(list_distinct(list(value)))[1:4] AS values FROM ft WHERE seller <> 'Supplier#000000001' GROUP BY 1),
    t AS (SELECT 'f' || (page_id % 12) AS field, count(*) AS tenders FROM pages GROUP BY 1), u AS (SELECT 'f' || unnest(range(0, 15)) AS field) SELECT field, coalesce(n, 0) AS n, sellers, values, coalesce(tenders, 0) AS tenders, coalesce(n, 0) = 0 AS unclaimed FROM u FULL JOIN c USING (field) FULL JOIN t USING (field) WHERE field NOT IN (SELECT field FROM own)""")
def feature_gaps(spark, d):
    tenders = read(spark, d, "pages").select(F.concat(F.lit("f"), (F.col("page_id") % 12).cast("string")).alias("field"))
    known = spark.range(15).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("field"))
    return O.feature_gaps(features(spark, d), "Supplier#000000001", tenders=tenders, fields=known)
