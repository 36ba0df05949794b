"""Queries of readers and importers; exported files go to the session's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators.text import Rule, first_label
from ..sources import imports as O
from ..shared import shared_folder
from . import decisions as D
from .bindings import catalog, demand_obs, findings, matches, offers, pages, price_obs, read, sellers, stored_offers
from .registry import query


@query("read_delimited", "SELECT p_partkey::VARCHAR AS item, p_name AS name, p_retailprice::VARCHAR AS price FROM part")
def read_delimited(spark, d):
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    x = read(spark, d, "part").select(F.col("p_partkey").alias(" Item"), F.col("p_name").alias("NAME"), F.col("p_retailprice").alias("Price "))
    O.write_delimited(x, path)
    return O.read_delimited(spark, path)


@query("alias_columns", "SELECT p_partkey AS sku, p_retailprice AS price, NULL AS stock FROM part")
def alias_columns(spark, d):
    return O.alias_columns(read(spark, d, "part"), {"sku": ["article", "partkey"], "price": ["price", "retail"], "stock": ["stock", "qty"]})


@query("import_term_volumes", """{demand_obs} , x AS (SELECT term, date_trunc('month', day)::DATE AS m, sum(value) AS v FROM demand_obs GROUP BY 1, 2) SELECT term, 'w' AS source, m AS period_start, m + 27 AS period_end, CASE WHEN term LIKE 'c%' THEN 0 ELSE v END::DOUBLE AS value, CASE WHEN term LIKE 'c%' THEN 'kept' ELSE 'inserted' END AS action FROM x""")
def import_term_volumes(spark, d):
    x = demand_obs(spark, d).groupBy("term", F.trunc("day", "month").alias("m")).agg(F.sum("value").alias("v"))
    stored = x.filter("term LIKE 'c%'").select("term", F.lit("w").alias("source"), F.col("m").alias("period_start"), F.date_add("m", 27).alias("period_end"), F.lit(0.0).alias("value"))
    raw = x.select(F.concat(F.lit(" "), F.upper("term")).alias("t"), F.when(F.col("term").startswith("c"), "n/a").otherwise(F.concat(F.col("v").cast("long").cast("string"), F.lit(" per month"))).alias("v"), F.date_format("m", "MM.yyyy").alias("m"))
    return O.import_term_volumes(raw, stored, "t", "v", "m", "w")[0]


@query("wide_series_to_long", "{demand_obs} SELECT day, term, CASE WHEN sum(value) < 2 THEN 1 ELSE sum(value) END::DOUBLE AS value FROM demand_obs GROUP BY 1, 2")
def wide_series_to_long(spark, d):
    obs = demand_obs(spark, d)
    terms = [r["term"] for r in obs.select("term").distinct().orderBy("term").collect()]  # the columns of the wide file
    w = obs.groupBy("day").pivot("term", terms).agg(F.sum("value"))
    w = w.select("day", *(F.when(F.col(f"`{c}`") < 2, "<1").otherwise(F.concat(F.col(f"`{c}`").cast("long").cast("string"), F.lit(" x"))).alias(c.capitalize()) for c in terms))
    return O.wide_series_to_long(w, "day")


@query("explode_registry", """WITH s AS (SELECT *, s_suppkey::VARCHAR AS i FROM supplier) SELECT 'sellers' AS "table", 'http://s' || i AS key, s_name AS value, NULL::DOUBLE AS price FROM s UNION ALL SELECT 'pages', 'http://s' || i || '/p1', 'product', NULL FROM s WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'pages', 'http://s' || i || '/catalog', 'catalog', NULL FROM s WHERE s_suppkey % 3 <> 0
    UNION ALL SELECT 'pages', 'http://s' || i || '/p3', 'catalog', NULL FROM s WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'offers', 'http://s' || i || u, n, s_suppkey + k + 0.5 FROM s, (VALUES ('/p1', 'n1', 1), ('/catalog', 'n2', 2), ('/p3', 'n3', 3), ('/p3', 'n4', 4)) v(u, n, k) WHERE s_suppkey % 3 <> 0
    UNION ALL SELECT 'observations', 'tender:T' || (s_suppkey % 50), 'buy', min(s_suppkey) FROM s GROUP BY 2 UNION ALL SELECT 'observations', 'mp:http://m/' || i, 'M: shop ' || i, 9 FROM s WHERE s_suppkey % 2 = 0""")
def explode_registry(spark, d):
    s, i = read(spark, d, "supplier"), F.col("s_suppkey").cast("string")
    site = F.concat(F.lit("http://s"), i)
    product = lambda k: F.struct(F.lit(f"n{k}").alias("name"), (F.col("s_suppkey") + k + 0.5).alias("price"))
    p = lambda path, *ks: F.struct(F.concat(site, F.lit(path)).alias("url"), F.array(*map(product, ks)).alias("products"))
    null = F.lit(None).cast("string")
    tender = F.struct(F.concat(F.lit("T"), (F.col("s_suppkey") % 50).cast("string")).alias("number"), F.lit("sale").alias("subject"), F.lit("buy").alias("customer"), F.col("s_suppkey").cast("double").alias("price"), null.alias("day"), null.alias("url"))
    listing = F.struct(F.lit("kit").alias("product"), F.lit("M").alias("marketplace"), F.concat(F.lit("shop "), i).alias("seller"), F.lit(9.0).alias("price"), F.concat(F.lit("http://m/"), i).alias("url"))
    raw = s.select(
        F.col("s_name").alias("name"), site.alias("website"), F.array(F.lit("shop")).alias("types"), F.when(F.col("s_suppkey") % 3 != 0, F.array(p("/p1", 1), p("/catalog", 2), p("/p3", 3, 4))).alias("pages"), F.array(tender).alias("tenders"),
        F.when(F.col("s_suppkey") % 2 == 0, F.array(listing)).alias("listings"))
    path = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    raw.write.json(path)
    t = O.registry_tables(spark.read.schema(O.REGISTRY).json(path))
    form = lambda name, key, value, price=None: t[name].select(F.lit(name).alias("table"), F.col(key).alias("key"), F.col(value).alias("value"), (F.col(price) if price else F.lit(None).cast("double")).alias("price"))
    return form("sellers", "website", "name").unionByName(form("pages", "url", "page_kind")).unionByName(form("offers", "url", "name", "price")).unionByName(form("observations", "key", "party", "price"))


@query("page_kind_from_multiplicity", "SELECT page_id, url2 AS url, CASE WHEN count(*) OVER (PARTITION BY url2) > 1 OR url2 LIKE '%/7' THEN 'catalog' ELSE 'product' END AS page_kind FROM (SELECT page_id, 'http://h/' || (CASE WHEN page_id < 100 THEN page_id ELSE page_id % 50 + 60 END) AS url2 FROM pages)")
def page_kind_from_multiplicity(spark, d):
    x = read(spark, d, "pages").select("page_id", F.concat(F.lit("http://h/"), F.when(F.col("page_id") < 100, F.col("page_id")).otherwise(F.col("page_id") % 50 + 60).cast("string")).alias("url"))
    return O.page_kind_from_multiplicity(x, "url", "/7$")


@query("import_terms", "{demand_obs} SELECT DISTINCT term, CASE WHEN category = 'click' THEN 'given' WHEN term LIKE 'view%' THEN 'seen' END AS category, true AS is_seed FROM demand_obs WHERE term NOT LIKE '%3'")
def import_terms(spark, d):
    x = demand_obs(spark, d).select(F.concat(F.lit("  "), F.upper("term")).alias("term"), F.when(F.col("category") == "click", "given").alias("category"))
    known = demand_obs(spark, d).filter("term LIKE '%3'").select("term").distinct()
    return O.import_terms(x, known, first_label([Rule("term", "^view", "seen")]))


@query("import_sellers_table", "SELECT 'http://s' || s_suppkey AS website, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN ['maker', 'retail'] ELSE ['retail'] END AS types FROM supplier WHERE s_suppkey % 4 > 0")
def import_sellers_table(spark, d):
    s = read(spark, d, "supplier")
    site = F.concat(F.lit("http://s"), F.col("s_suppkey").cast("string"))
    x = s.select(F.col("s_name").alias("name"), F.concat(site, F.lit("/shop?x=1")).alias("website"), F.when(F.col("s_suppkey") % 2 == 0, "Shop | factory;what").otherwise("shop").alias("types"))
    return O.import_sellers(x, s.filter("s_suppkey % 4 = 0").select(site.alias("website")), {"shop": "retail", "factory": "maker"})


@query("import_offer_prices", "SELECT l_orderkey * 10 + l_linenumber AS row_id, l_quantity AS q, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey::VARCHAR ELSE 'manual://supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') END AS seller_key FROM lineitem")
def import_offer_prices(spark, d):
    li = read(spark, d, "lineitem")
    x = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("l_quantity").alias("q"), F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("seller_name"))
    return O.import_offer_prices(x, sellers(spark, d).filter("seller_id % 3 = 0"))[0].select("row_id", "q", "seller_key")


@query("merge_source_registry", """SELECT coalesce(a.k, b.k) AS source_key, CASE WHEN a.status = 'ok' THEN 'ok' ELSE coalesce(b.status, a.status) END AS status FROM (SELECT 'supplier-' || lpad(s_suppkey::VARCHAR, 9, '0') AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'ok' ELSE 'bad' END AS status FROM supplier WHERE s_suppkey % 3 > 0)  a
    FULL JOIN (SELECT DISTINCT CASE WHEN s_suppkey % 10 = 5 THEN 'five' ELSE 'supplier-' || lpad(s_suppkey::VARCHAR, 9, '0') END AS k, 'fine' AS status FROM supplier WHERE s_suppkey % 5 < 2 OR s_suppkey % 10 = 5) b ON a.k = b.k""")
def merge_source_registry(spark, d):
    s = read(spark, d, "supplier")
    slug = F.concat(F.lit("supplier-"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))
    stored = s.filter("s_suppkey % 3 > 0").select(slug.alias("source_key"), F.when(F.col("s_suppkey") % 2 == 0, "ok").otherwise("bad").alias("status"))
    audit = s.filter("s_suppkey % 5 < 2 OR s_suppkey % 10 = 5").select(F.when(F.col("s_suppkey") % 10 == 5, F.concat(F.lit("Fifth "), "s_name")).otherwise(F.col("s_name")).alias("name"), F.lit("fine").alias("status"))
    return O.merge_source_registry(stored, audit, [("fifth", "five")])


@query("flatten_marketplace_json", "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, (CASE p_partkey % 3 WHEN 0 THEN 12345 WHEN 1 THEN p_size * 100 ELSE p_size * 10 END)::DOUBLE / 100 AS price, p_size > 10 AS in_stock FROM part WHERE p_brand <> 'Brand#1'")
def flatten_marketplace_json(spark, d):
    p = read(spark, d, "part")
    k = F.col("p_partkey") % 3
    one = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.when(k == 1, F.col("p_size") * 100).alias("salePriceU"), (F.col("p_size") * 10).alias("priceU"), F.when(F.col("p_size") > 10, 1).otherwise(0).alias("totalQuantity"),
                   F.when(k == 0, F.array(F.struct(F.struct(F.lit(12345).alias("total")).alias("price")))).alias("sizes"))
    return O.flatten_marketplace(p.select(F.to_json(F.struct(F.array(one).alias("products"))).alias("body")), "body", ["BRAND#1"])


@query("latest_page_copy", "SELECT page_id, day FROM (SELECT page_id, day, row_number() OVER (PARTITION BY page_id ORDER BY day DESC) AS rn FROM (SELECT page_id % 90 AS page_id, DATE '2024-01-01' + (page_id % 17)::INT + (page_id // 90)::INT * 17 AS day FROM pages)) WHERE rn = 1")
def latest_page_copy(spark, d):
    x = read(spark, d, "pages").select((F.col("page_id") % 90).alias("page_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 17 + F.floor(F.col("page_id") / 90) * 17).cast("int")).alias("day"))
    return O.latest_page_copy(x, ["page_id"], "day")


@query("sitemap_urls", """{page} , u AS (SELECT DISTINCT host, 'http://' || host || '/item/' || page_id AS url FROM page WHERE page_id % 4 > 0 UNION SELECT DISTINCT host, 'http://' || host || '/deep/item/' || page_id FROM page WHERE page_id % 2 = 0) SELECT host, url, rn FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url) AS rn FROM u WHERE url NOT LIKE '%9') WHERE rn <= 3""")
def sitemap_urls(spark, d):
    p = pages(spark, d)
    i = F.col("page_id").cast("string")
    loc = lambda *x: F.concat(F.lit("<url><loc> http://"), "host", *x, F.lit("</loc></url>"))
    top = p.select("host", F.concat(loc(F.when(F.col("page_id") % 4 > 0, "/item/").otherwise("/about/"), i), loc(F.lit("/deep-"), i, F.lit(".xml")), F.lit("<loc>http://other/item/1</loc>")).alias("xml"))
    fetched = p.filter("page_id % 2 = 0").select(F.concat(F.lit("http://"), "host", F.lit("/deep-"), i, F.lit(".xml")).alias("url"), loc(F.lit("/deep/item/"), i).alias("xml"))
    known = p.filter("page_id % 10 = 9").select(F.concat(F.lit("http://"), "host", F.lit("/item/"), i).alias("url"))
    return O.sitemap_urls(O.nested_sitemaps(top, fetched, 2), "host", "/item/", "9$", known, 3).select("host", "url", F.col("rn").cast("long").alias("rn"))


@query("write_delimited", "{offers} SELECT offer_id::VARCHAR AS offer_id, name, category FROM offers")
def write_delimited(spark, d):
    path = f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"
    O.write_delimited(offers(spark, d).select("offer_id", "name", "category"), path)
    return spark.read.option("sep", ";").option("header", True).csv(path)


EXPORTS = {"competitor_matrix": 3, "site_audit": 6, "signals": 12, "recommendations": 6, "matrix": 8, "competitors": 5, "competitor_products": 15, "matches": 8, "queries": 2, "demand": 4, "hypotheses": 8, "price_history": 5}


@query("export_views", "{catalog sellers offers price_obs demand_obs matches findings} , " + D.DETECTED + ", " + D.ACTIONS + ", " + D.IDEAS + ", ex AS (SELECT 'competitor_matrix' AS view, count(*) AS n FROM (SELECT DISTINCT seller_id, category FROM offers) UNION ALL SELECT 'site_audit', count(*) FROM catalog WHERE length(name) < 12 UNION ALL SELECT 'signals', count(*) FROM findings UNION ALL SELECT 'recommendations', count(*) FROM ac UNION ALL SELECT 'matrix', count(*) FROM catalog UNION ALL SELECT 'competitors', count(*) FROM sellers UNION ALL SELECT 'competitor_products', count(*) FROM offers UNION ALL SELECT 'matches', count(*) FROM matches UNION ALL SELECT 'queries', count(DISTINCT term) FROM demand_obs UNION ALL SELECT 'demand', count(*) FROM demand_obs UNION ALL SELECT 'hypotheses', count(*) FROM id UNION ALL SELECT 'price_history', count(*) FROM price_obs) SELECT view, n, CASE view " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EXPORTS.items()) + " END::BIGINT AS columns FROM ex")
def export_views(spark, d):
    c, o = catalog(spark, d), stored_offers(spark, d)
    found = D.detected(spark, d, o)
    matrix = o.groupBy("seller_id", "category").agg(F.count("*").alias("n"))
    audit = A.issues(c.withColumn("site", F.lit("one")), "cards", [("short name", "P3", F.length("name") < 12)]).withColumn("n", F.lit(1))
    views = O.export_views(c, sellers(spark, d), o, matches(spark, d, o), findings(spark, d), D.actions(found), D.ideas(spark, d, o, found), demand_obs(spark, d), price_obs(spark, d), matrix, audit)
    out = None
    for name, df in views.items():
        x = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("view"), "n", F.lit(len(df.columns)).cast("long").alias("columns"))
        out = x if out is None else out.unionByName(x)
    return out


@query("dump_load_tables", "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'inserted' WHEN s_suppkey % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS action, count(*) AS n FROM supplier GROUP BY 1")
def dump_load_tables(spark, d):
    path = f"{shared_folder(spark)}/dump-{uuid.uuid4().hex}"
    s = sellers(spark, d)
    O.dump_tables({"sellers": (s, ["seller_id"])}, path)
    loaded = spark.read.schema("seller string, seller_group string, tier string, balance double").json(f"{path}/sellers")
    stored = s.filter("seller_id % 3 > 0").withColumn("tier", F.when(F.col("seller_id") % 5 == 0, "Z").otherwise(F.col("tier"))).drop("seller_id")
    return O.load_counts(stored, loaded, ["seller"])


@query("ranked_suggestions", "SELECT event_type AS seed, event_type || '-' || k AS term, k + 1 AS value, 'rank' AS unit, DATE '2024-02-01' AS period_start FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest([0, 1, 2]) AS k)")
def ranked_suggestions(spark, d):
    e = read(spark, d, "events").select("event_type").distinct()
    x = e.withColumn("s", F.array(*(F.concat("event_type", F.lit(f"-{k} ")) for k in range(3)), F.lit(" ")))
    return O.ranked_suggestions(x, e.select(F.col("event_type").alias("term")), "event_type", "s", F.lit("2024-02-01").cast("date"))[1]
