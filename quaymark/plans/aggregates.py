"""Queries of the aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as O
from ..operators.ranks import medians
from .bindings import catalog, demand_obs, findings, matches, offers, pages, price_obs, read, run_log, sellers
from .registry import query

CATS = ["ECONOMY", "PROMO", "STANDARD"]


def _cell(c: str) -> str:
    return (f"count(*) FILTER (category = '{c}') AS \"{c}_offers\", count(price) FILTER (category = '{c}') AS \"{c}_priced\", "
            f"count(DISTINCT brand || ':' || coalesce(model_key, name)) FILTER (category = '{c}') AS \"{c}_models\"")


@query("coverage_matrix", "{offers} SELECT seller_id, " + ", ".join(map(_cell, CATS)) + " FROM offers GROUP BY seller_id")
def coverage_matrix(spark, d):
    return O.coverage_matrix(offers(spark, d), "seller_id", "category", CATS)


@query("coverage_gaps", "{catalog offers} SELECT category, count(DISTINCT seller_id) AS sellers FROM offers WHERE category NOT IN (SELECT category FROM catalog WHERE capacity = 1 AND item_id % 3 = 0) GROUP BY category")
def coverage_gaps(spark, d):
    return O.coverage_gaps(offers(spark, d), catalog(spark, d).filter("capacity = 1 AND item_id % 3 = 0"), "category")


@query("seller_summary", """{offers matches} SELECT seller_id, count(*) AS n, count(price) AS priced, count(*) FILTER (is_active) AS active, count(hit) AS matched, count(DISTINCT category) AS categories, max(last_seen) AS last_seen, round_even(count(hit) * 100 / count(*)::DOUBLE, 2) AS matched_share
    FROM (SELECT o.*, m.offer_id AS hit FROM offers o LEFT JOIN (SELECT DISTINCT offer_id FROM matches WHERE confidence >= 0.7) m ON o.offer_id = m.offer_id) GROUP BY ROLLUP (seller_id)""")
def seller_summary(spark, d):
    return O.seller_summary(offers(spark, d), matches(spark, d).filter("confidence >= 0.7"))


@query("new_category_groups", """{catalog offers} SELECT category, seller_id, count(*) AS n, min(price) AS least, max(price) AS most, array_to_string(list_sort(list_distinct(list(name)))[1:5], ', ') AS names, min(offer_id) AS first_offer
    FROM offers WHERE category NOT IN (SELECT category FROM catalog WHERE category < 'M') GROUP BY category, seller_id""")
def new_category_groups(spark, d):
    own = catalog(spark, d).filter("category < 'M'").select("category").distinct()
    return O.groups_outside(offers(spark, d), own, ["category", "seller_id"], "name")


@query("multi_seller_models", """{catalog sellers offers} SELECT brand, model_key, count(DISTINCT seller_group) AS sellers, min(price) AS least, max(price) AS most, count(*) AS offers, CASE WHEN count(DISTINCT seller_group) >= 12 THEN 'high' ELSE 'medium' END AS severity
    FROM offers JOIN sellers USING (seller_id) WHERE (brand, model_key) NOT IN (SELECT brand, model_key FROM catalog WHERE item_id % 2 = 0) GROUP BY brand, model_key HAVING count(DISTINCT seller_group) >= 2""")
def multi_seller_models(spark, d):
    own = catalog(spark, d).filter("item_id % 2 = 0").select("brand", "model_key").distinct()
    return O.multi_seller_models(offers(spark, d), sellers(spark, d), own, high=12)


@query("median_market", "{sellers offers} SELECT item_id, round_even(median(price), 6) AS median, min(price) AS least, max(price) AS most, count(*) AS n, count(DISTINCT seller_group) AS sellers FROM offers JOIN sellers USING (seller_id) WHERE is_active GROUP BY item_id")
def median_market(spark, d):
    return O.market(offers(spark, d).filter("is_active").join(sellers(spark, d), "seller_id"), "item_id").withColumn("median", F.bround("median", 6))


@query("category_stats", "{catalog} SELECT category, brand, count(*) AS n, min(price) AS least, max(price) AS most FROM catalog GROUP BY category, brand")
def category_stats(spark, d):
    return catalog(spark, d).groupBy("category", "brand").agg(F.count("*").alias("n"), F.min("price").alias("least"), F.max("price").alias("most"))


@query("registry_stats", """{sellers offers run_log} , r AS (SELECT source_id, count(*) AS pages, count(*) FILTER (NOT ok) AS failing, max(finished_at) AS last_check FROM run_log GROUP BY 1),
    o AS (SELECT seller_id, count(*) AS offers, count(price) AS priced, count(*) FILTER (availability = 'InStock') AS in_stock, count(*) FILTER (availability <> 'InStock') AS out_of_stock FROM offers GROUP BY 1)
    SELECT s.seller_id, coalesce(offers, 0) AS offers, coalesce(priced, 0) AS priced, coalesce(in_stock, 0) AS in_stock, coalesce(out_of_stock, 0) AS out_of_stock, coalesce(pages, 0) AS pages, coalesce(failing, 0) AS failing, last_check,
        round_even(in_stock * 100 / (in_stock + out_of_stock)::DOUBLE, 2) AS stock_share FROM sellers s LEFT JOIN o USING (seller_id) LEFT JOIN r ON s.seller_id = r.source_id""")
def registry_stats(spark, d):
    o = offers(spark, d).groupBy("seller_id").agg(
        F.count("*").alias("offers"), F.count("price").alias("priced"), F.count_if(F.col("availability") == "InStock").alias("in_stock"), F.count_if(F.col("availability") != "InStock").alias("out_of_stock"))
    r = run_log(spark, d).groupBy(F.col("source_id").alias("seller_id")).agg(F.count("*").alias("pages"), F.count_if(~F.col("ok")).alias("failing"), F.max("finished_at").alias("last_check"))
    x = sellers(spark, d).select("seller_id").join(o, "seller_id", "left").join(r, "seller_id", "left")
    x = x.withColumn("stock_share", F.bround(F.col("in_stock") * 100 / (F.col("in_stock") + F.col("out_of_stock")), 2))
    return x.na.fill(0, ["offers", "priced", "in_stock", "out_of_stock", "pages", "failing"])


@query("position_share", """{catalog offers} , mine AS (SELECT category, kind, min(price) AS own_least FROM catalog GROUP BY 1, 2)
    SELECT category, kind, own_least, n, cheaper_share, least, round_even(median, 6) AS median, round_even((own_least / least - 1) * 100, 2) AS gap_least, round_even((own_least / median - 1) * 100, 2) AS gap_median
    FROM (SELECT category, kind, any_value(own_least) AS own_least, count(*) AS n, round_even(avg((price < own_least)::INT) * 100, 2) AS cheaper_share, min(price) AS least, median(price) AS median FROM offers JOIN mine USING (category, kind) GROUP BY 1, 2)""")
def position_share(spark, d):
    return O.position_share(offers(spark, d), catalog(spark, d), ["category", "kind"]).withColumn("median", F.bround("median", 6))


@query("entity_rollup", "SELECT entity, round_even(sum(c_acctbal), 2) AS balance, max(c_custkey) AS best, count(*) AS sites FROM (SELECT *, c_nationkey::VARCHAR || coalesce(nullif(left(c_mktsegment, 1), 'B'), '') AS entity FROM customer) GROUP BY ROLLUP (entity)")
def entity_rollup(spark, d):
    c = read(spark, d, "customer").select("c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("best"))
    e = F.concat(F.col("c_nationkey").cast("string"), F.coalesce(F.nullif(F.substring("c_mktsegment", 1, 1), F.lit("B")), F.lit("")))
    return O.entity_rollup(c, e, ["balance"], "best").withColumn("balance", F.bround("balance", 2))


@query("tender_segments", """SELECT segment, count(*) AS n, round_even(sum(c_acctbal), 2) AS revenue, min(c_name) AS first_name FROM (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN 'builder' WHEN c_acctbal >= 8000 THEN 'large' WHEN c_acctbal >= 3000 THEN 'middle' WHEN c_acctbal >= 0 THEN 'small' ELSE 'unknown' END AS segment FROM customer) GROUP BY segment""")
def tender_segments(spark, d):
    c = read(spark, d, "customer")
    seg = O.revenue_segment(F.col("c_acctbal"), F.col("c_mktsegment"), [(8000, "large"), (3000, "middle"), (0, "small")], "unknown", {"BUILDING": "builder"})
    return c.groupBy(seg.alias("segment")).agg(F.count("*").alias("n"), F.bround(F.sum("c_acctbal"), 2).alias("revenue"), F.min("c_name").alias("first_name"))


@query("role_share", """{offers} , x AS (SELECT *, substr(brand, 7)::INT <= 12 AS foreign_brand FROM offers), s AS (SELECT seller_id, count(*) AS n, round_even(avg(foreign_brand::INT), 4) AS share FROM x GROUP BY 1),
    t AS (SELECT seller_id, list(brand ORDER BY rn) AS top FROM (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY k DESC, brand) AS rn FROM (SELECT seller_id, brand, count(*) AS k FROM x WHERE foreign_brand GROUP BY 1, 2)) WHERE rn <= 3 GROUP BY 1)
    SELECT seller_id, n, share, top, CASE WHEN share >= 0.5 THEN 'reseller' WHEN share >= 0.45 THEN 'mixed' ELSE 'maker' END AS role FROM s LEFT JOIN t USING (seller_id)""")
def role_share(spark, d):
    return O.role_share(offers(spark, d), F.substring("brand", 7, 5).cast("int") <= 12, [(0.5, "reseller"), (0.45, "mixed")], "maker")


@query("page_health", "{run_log} SELECT source_id, count(*) AS runs, count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad, max(finished_at) FILTER (ok) AS last_good FROM run_log GROUP BY source_id")
def page_health(spark, d):
    return run_log(spark, d).groupBy("source_id").agg(F.count("*").alias("runs"), F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"), F.max(F.when(F.col("ok"), F.col("finished_at"))).alias("last_good"))


@query("dominant_spelling", """{catalog} , n AS (SELECT category, kind, brand, count(*) AS n FROM catalog GROUP BY 1, 2, 3) SELECT category, kind, brand, n, common, spellings, rows FROM (SELECT *, first_value(brand) OVER (PARTITION BY category, kind ORDER BY n DESC, brand DESC) AS common, count(*) OVER (PARTITION BY category, kind) AS spellings, sum(n) OVER (PARTITION BY category, kind)::BIGINT AS rows FROM n) WHERE spellings > 1 AND brand <> common""")
def dominant_spelling(spark, d):
    return O.dominant_spelling(catalog(spark, d), ["category", "kind"], "brand")


@query("term_variant_counts", r"""SELECT lower(v) AS variant, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+tion[a-z]*')) AS v FROM documents) GROUP BY 1""")
def term_variant_counts(spark, d):
    v = read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+tion[a-z]*"), F.lit(0))).alias("v"))
    return v.groupBy(F.lower("v").alias("variant")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("components_vs_bundle", """{catalog} SELECT item_id, price, least_part, CASE WHEN price < least_part THEN 'below part' WHEN price > 2 * least_part THEN 'above parts' ELSE 'ok' END AS verdict
    FROM (SELECT *, min(price) FILTER (capacity < 5) OVER (PARTITION BY category, brand) AS least_part FROM catalog) WHERE capacity >= 5 AND least_part IS NOT NULL""")
def components_vs_bundle(spark, d):
    return O.components_vs_bundle(catalog(spark, d), ["category", "brand"], F.col("capacity") < 5, F.col("capacity") >= 5).select("item_id", "price", "least_part", "verdict")


@query("list_of_names", "{offers} SELECT category, seller_id, array_to_string(list_sort(list_distinct(list(name)))[1:4], '; ') AS names, count(DISTINCT name) AS n FROM offers GROUP BY 1, 2")
def list_of_names(spark, d):
    return O.joined_names(offers(spark, d), ["category", "seller_id"], "name", 4)


@query("verdict_counts", """{findings} SELECT finding_type, severity, count(*) AS n, round_even(avg(confidence), 6) AS confidence FROM findings GROUP BY CUBE (finding_type, severity)""")
def verdict_counts(spark, d):
    return findings(spark, d).cube("finding_type", "severity").agg(F.count("*").alias("n"), F.bround(F.avg("confidence"), 6).alias("confidence"))


@query("dashboard_counters", """{catalog sellers offers matches findings} SELECT (SELECT count(*) FROM catalog) AS items, (SELECT count(*) FROM catalog WHERE price IS NULL) AS unpriced, (SELECT count(*) FROM sellers) AS sellers, (SELECT count(DISTINCT seller_group) FROM sellers) AS groups,
    (SELECT count(*) FROM offers) AS offers, (SELECT count(*) FROM offers WHERE is_active) AS active, (SELECT count(*) FROM matches WHERE confidence >= 0.7) AS firm, (SELECT count(*) FROM findings WHERE status = 'new') AS new_findings, (SELECT count(*) FROM findings WHERE severity = 'high' AND status <> 'done') AS high""")
def dashboard_counters(spark, d):
    one = [
        catalog(spark, d).agg(F.count("*").alias("items"), F.count_if(F.col("price").isNull()).alias("unpriced")),
        sellers(spark, d).agg(F.count("*").alias("sellers"), F.countDistinct("seller_group").alias("groups")),
        offers(spark, d).agg(F.count("*").alias("offers"), F.count_if("is_active").alias("active")),
        matches(spark, d).agg(F.count_if(F.col("confidence") >= 0.7).alias("firm")),
        findings(spark, d).agg(F.count_if(F.col("status") == "new").alias("new_findings"), F.count_if((F.col("severity") == "high") & (F.col("status") != "done")).alias("high")),
    ]
    out = one[0]
    for x in one[1:]:
        out = out.join(x)  # tables of one row each
    return out


@query("data_limits", "{price_obs demand_obs} SELECT 'prices' AS what, count(DISTINCT observed_at::DATE) AS days, min(observed_at::DATE)::VARCHAR AS first, max(observed_at::DATE)::VARCHAR AS last FROM price_obs UNION ALL SELECT 'demand', count(DISTINCT day), min(day)::VARCHAR, max(day)::VARCHAR FROM demand_obs")
def data_limits(spark, d):
    def limits(df, name, col):
        return df.agg(F.countDistinct(col).alias("days"), F.min(col).cast("string").alias("first"), F.max(col).cast("string").alias("last")).select(F.lit(name).alias("what"), "days", "first", "last")

    return limits(price_obs(spark, d), "prices", F.to_date("observed_at")).unionByName(limits(demand_obs(spark, d), "demand", F.col("day")))


@query("section_product_counts", r"""{page} , s AS (SELECT host, regexp_extract(url, '^[a-z]+://[^/]+/([^/?]+)', 1) AS section, url FROM page) SELECT host, section, count(DISTINCT url) AS n FROM s WHERE section <> '' GROUP BY 1, 2""")
def section_product_counts(spark, d):
    s = pages(spark, d).withColumn("section", F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?]+)", 1))
    return s.filter("section <> ''").groupBy("host", "section").agg(F.countDistinct("url").alias("n"))


@query("item_counters", """{catalog offers matches findings price_obs} SELECT item_id, coalesce(m.n, 0) AS matches, coalesce(f.n, 0) AS findings, coalesce(o.n, 0) AS observations FROM catalog LEFT JOIN (SELECT item_id, count(*) AS n FROM matches GROUP BY 1) m USING (item_id)
    LEFT JOIN (SELECT item_id, count(*) AS n FROM findings GROUP BY 1) f USING (item_id) LEFT JOIN (SELECT item_id, count(*) AS n FROM price_obs GROUP BY 1) o USING (item_id)""")
def item_counters(spark, d):
    out = catalog(spark, d).select("item_id")
    for name, df in (("matches", matches(spark, d)), ("findings", findings(spark, d)), ("observations", price_obs(spark, d))):
        out = out.join(df.groupBy("item_id").agg(F.count("*").alias(name)), "item_id", "left")
    return out.na.fill(0)


@query("upper_median", "{offers} SELECT item_id, list_sort(list(price))[(len(list(price)) // 2 + 1)::INT] AS price FROM offers GROUP BY item_id")
def upper_median(spark, d):
    return medians(offers(spark, d), ["item_id"], "price").select("item_id", F.col("upper_median").alias("price"))
