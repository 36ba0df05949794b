"""Queries of the filter operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import filters as O
from .bindings import catalog, findings, offers, read, sellers
from .registry import query

AS_OF = date(2000, 1, 1)


@query("filter_findings", """{findings} SELECT finding_id, finding_type, severity, confidence, status FROM findings WHERE created_at >= DATE '2000-01-01' - 900
    AND finding_type IN ('URGENT', 'HIGH') AND severity IN ('high', 'medium') AND confidence >= 0.5 AND status IN ('new', 'seen')""")
def filter_findings(spark, d):
    out = O.filter_findings(findings(spark, d), as_of=AS_OF, days=900, types=["URGENT", "HIGH"], severities=["high", "medium"], statuses=["new", "seen"], least_confidence=0.5)
    return out.select("finding_id", "finding_type", "severity", "confidence", "status")


@query("active_in_scope", "{offers} SELECT offer_id, category, price FROM offers WHERE is_active AND price IS NOT NULL AND category IS NOT NULL")
def active_in_scope(spark, d):
    return O.active_in_scope(offers(spark, d)).select("offer_id", "category", "price")


@query("text_search", "{catalog} SELECT item_id, name, brand FROM catalog WHERE name ILIKE '%Ring%' OR brand ILIKE '%#17%'")
def text_search(spark, d):
    c = catalog(spark, d)
    return c.filter(O.matches_text("rING", ["name"]) | O.matches_text("#17", ["brand"])).select("item_id", "name", "brand")


@query("in_list", "{catalog, offers} SELECT offer_id, category FROM offers WHERE category IN ('ECONOMY', 'PROMO') AND item_id IN (SELECT item_id FROM catalog WHERE capacity < 10)".replace("{catalog, offers}", "{catalog offers}"))
def in_list(spark, d):
    few = catalog(spark, d).filter("capacity < 10").select("item_id")
    return O.in_list(O.in_list(offers(spark, d), "category", ["ECONOMY", "PROMO"]), "item_id", few).select("offer_id", "category")


@query("seller_or_group", "{sellers offers} SELECT offer_id, seller_id FROM offers WHERE seller_id IN (SELECT seller_id FROM sellers WHERE seller_group IN (SELECT seller_group FROM sellers WHERE seller_id IN (3, 7)))")
def seller_or_group(spark, d):
    return O.seller_or_group(offers(spark, d), sellers(spark, d), [3, 7]).select("offer_id", "seller_id")


@query("drop_bad_urls", r"SELECT page_id, url FROM pages WHERE replace(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '/', '') <> '' AND NOT contains(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '/cart')")
def drop_bad_urls(spark, d):
    return read(spark, d, "pages").filter(O.usable_url(F.col("url"))).select("page_id", "url")


@query("distinctive_key", """SELECT p_partkey AS item_id, k, coalesce(regexp_matches(k, '^[A-Za-z]{2,}') AND length(k) >= 4, false) AS distinctive
    FROM (SELECT p_partkey, substr(p_name, 1, 1 + p_partkey % 6) || p_size AS k FROM part)""")
def distinctive_key(spark, d):
    p = read(spark, d, "part")
    k = F.concat(F.substring(F.col("p_name"), F.lit(1), (1 + F.col("p_partkey") % 6).cast("int")), F.col("p_size").cast("string"))
    return p.select(F.col("p_partkey").alias("item_id"), k.alias("k")).withColumn("distinctive", O.distinctive_key(F.col("k")))


@query("in_scope_flag", "{catalog} SELECT item_id, CASE WHEN category = 'STANDARD' THEN true ELSE NOT regexp_matches(lower(name), 'red|small') END AS in_scope FROM catalog")
def in_scope_flag(spark, d):
    return catalog(spark, d).select("item_id", O.in_scope_flag(F.col("name"), F.col("category"), ["STANDARD"], "red|small").alias("in_scope"))


@query("array_membership", """SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::INT % 7 = 3""")
def array_membership(spark, d):
    e = read(spark, d, "events").withColumn("tags", F.to_json(F.array((F.get_json_object("props", "$.k").cast("int") % 7).cast("string"))))
    return e.filter(O.has_member(F.col("tags"), "3")).select("event_id")


@query("valid_listing", """{offers} SELECT offer_id, name FROM (SELECT *, CASE WHEN seller_id % 3 = 0 THEN NULL ELSE price END AS p FROM offers)
    WHERE NOT regexp_matches(lower(name), 'blue') AND NOT regexp_matches(lower(name), '^green') AND NOT (p IS NULL AND regexp_matches(lower(name), 'gear$|ring$'))""")
def valid_listing(spark, d):
    o = offers(spark, d).withColumn("p", F.when(F.col("seller_id") % 3 != 0, F.col("price")))
    return O.valid_listing(o, "name", "p", "blue", "^green", "gear$|ring$").select("offer_id", "name")


@query("good_title", """SELECT page_id, title, length(trim(title, ' ')) >= 6 AND lower(trim(title, ' ')) NOT IN ('about us', 'contact') AND NOT regexp_matches(lower(trim(title, ' ')), '[0-9]+ ?(eur|usd)') AND NOT regexp_matches(lower(trim(title, ' ')), '^(buy|order) ') AS good
    FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title FROM pages)""")
def good_title(spark, d):
    p = read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"))
    return p.withColumn("good", O.good_title(F.col("title"), ["about us", "contact"], "[0-9]+ ?(eur|usd)", "^(buy|order) "))


@query("project_wide_matrix", """{sellers offers} SELECT o.offer_id, s.seller, s.seller_group, o.name, o.price, o.price / nullif(o.capacity, 0) AS price_per_unit, CASE WHEN NOT is_active THEN 'gone' WHEN first_seen = last_seen THEN 'new' ELSE 'ok' END AS state
    FROM offers o JOIN sellers s USING (seller_id)""")
def project_wide_matrix(spark, d):
    o, s = offers(spark, d), sellers(spark, d)
    return o.join(s, "seller_id").select(
        "offer_id", "seller", "seller_group", "name", "price", F.try_divide("price", "capacity").alias("price_per_unit"),
        F.when(~F.col("is_active"), "gone").when(F.col("first_seen") == F.col("last_seen"), "new").otherwise("ok").alias("state"))


@query("null_safe_lookup", """WITH l AS (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 5 END AS k FROM events), r AS (SELECT k, count(*) AS n FROM l GROUP BY k) SELECT l.event_id, l.k, r.n FROM l LEFT JOIN r ON l.k IS NOT DISTINCT FROM r.k""")
def null_safe_lookup(spark, d):
    left = read(spark, d, "events").select("event_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 5).alias("k"))
    return O.null_safe_lookup(left, left.groupBy("k").agg(F.count("*").alias("n")), ["k"])
