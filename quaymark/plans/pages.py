"""Queries of the web-page jobs; pages without prices get them as tags that SQL and Spark add alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as O
from .bindings import pages, read
from .registry import query

BLOCKS = "p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|article|nav|section|header|footer|title"
LINES = rf"""ln AS (SELECT page_id, host, list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?i)</?({BLOCKS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')), lambda x: length(x) BETWEEN 2 AND 199) AS lines FROM page)"""
LINKS = r"""lk AS (SELECT page_id, host, url, min(text) AS text FROM (SELECT page_id, host, CASE WHEN href LIKE '/%' THEN scheme || '://' || host || href ELSE href END AS url, text FROM (SELECT page_id, host, scheme, regexp_extract(a, '(?is)href="([^"#]+)', 1) AS href, trim(regexp_replace(a, '<[^>]*>', '', 'g'), ' ') AS text FROM (SELECT page_id, host, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref="([^"#]+)[^"]*"[^>]*>.*?</a>')) AS a FROM page)))
    WHERE regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) = host GROUP BY 1, 2, 3)"""


def links(spark, d):
    return O.page_links(pages(spark, d))


@query("page_lines", "{page} , " + LINES + " SELECT page_id, lines FROM ln")
def page_lines(spark, d):
    return pages(spark, d).select("page_id", O.page_lines(F.col("html")).alias("lines"))


@query("page_links", "{page} , " + LINKS + " SELECT * FROM lk")
def page_links(spark, d):
    return links(spark, d)


@query("page_kind", r"""SELECT page_id, CASE WHEN replace(p, '/', '') = '' THEN 'home' WHEN contains(p, 'cat') THEN 'catalog' WHEN contains(p, 'new') THEN 'news' WHEN list_contains(string_split(p, '/'), 'de') THEN 'german' WHEN list_contains(string_split(p, '/'), 'en') THEN 'english' END AS kind FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS p FROM pages)""")
def page_kind(spark, d):
    return read(spark, d, "pages").select("page_id", O.page_kind(F.col("url"), [("cat", "catalog"), ("new", "news")], [("de", "german"), ("en", "english")]).alias("kind"))


def made_pages(spark, d):
    """Pages with noise, repeats and links that follow from their ids."""
    i = F.col("page_id").cast("string")
    html = F.concat(
        F.lit("<html><head><title>T "), i, F.lit('</title><meta name="description" content="About '), i, F.lit('"></head><body><nav><a href="/m">Menu link</a></nav><main><h1>Head '), i, F.lit("</h1><p>Line <b>one</b> of "), i,
        F.lit("</p><p>Line one of "), i, F.lit("</p><p>At 12:30 page "), i, F.lit(' opened 01.02.2024</p><div class="counter">5 guests</div><p>Views: 17</p><p>We use cookie files</p><a href="/p/'), i, F.lit('#top">Model '), i,
        F.lit('</a><a href="/cart">Go there</a><a href="http://other.example/x">Other site</a><a href="/p/'), i, F.lit('">Same again</a></main><footer>Foot line</footer></body></html>'))
    return pages(spark, d).withColumn("html", html)


@query("normalise_page", r"""SELECT page_id, 'T ' || page_id AS title, concat_ws(chr(10), 'Head ' || page_id, 'Line one of ' || page_id, 'At page ' || page_id || ' opened', 'Model ' || page_id, 'Go there', 'Other site', 'Same again') AS text, 1 AS links,
    'Model ' || page_id AS t, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/p/' || page_id AS u FROM pages""")
def normalise_page(spark, d):
    return O.normalise_page(made_pages(spark, d)).select("page_id", "title", "text", F.size("items").alias("links"), F.col("items")[0]["t"].alias("t"), F.col("items")[0]["u"].alias("u"))


@query("site_lines", "{page} , " + LINES + """ , x AS (SELECT page_id, host, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS at FROM ln), n AS (SELECT host, count(*) AS pages FROM page GROUP BY 1 HAVING count(*) >= 3), c AS (SELECT host, line FROM x JOIN n USING (host) GROUP BY host, line, pages HAVING count(DISTINCT page_id) > 0.3 * pages)
    SELECT ln.page_id, coalesce(string_agg(x.line, chr(10) ORDER BY x.at), '') AS text FROM ln LEFT JOIN (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.host = x.host AND c.line = x.line)) x USING (page_id) GROUP BY 1""")
def site_lines(spark, d):
    p = pages(spark, d).select("page_id", "host", F.array_join(O.page_lines(F.col("html")), "\n").alias("text"))
    return O.drop_site_lines(p, least=3, share=0.3).select("page_id", "text")


@query("page_hash", "{page} , " + LINES + ", " + LINKS + " SELECT page_id, sha1(array_to_string(list_sort(list_distinct(lines)), chr(10)) || chr(1) || array_to_string(list_sort(list_distinct(us)), chr(10))) AS hash FROM ln JOIN (SELECT page_id, list(url) AS us FROM lk GROUP BY 1) USING (page_id)".replace("sha1(", "sha1("))
def page_hash(spark, d):
    p = pages(spark, d).select("page_id", O.page_lines(F.col("html")).alias("lines"))
    us = links(spark, d).groupBy("page_id").agg(F.collect_list("url").alias("us"))
    return p.join(us, "page_id").select("page_id", O.page_hash(F.col("lines"), F.col("us")).alias("hash"))


def shop_pages(spark, d):
    """Pages with a product, specs, crumbs and cards that follow from their ids."""
    i = F.col("page_id").cast("string")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"item '), i, F.lit('","sku":"s'), i, F.lit('","brand":{"name":"B"},"offers":{"price":"'), (F.col("page_id") * 10 + 5).cast("string"), F.lit('.50","priceCurrency":"EUR","availability":"https://schema.org/InStock"}}]}</script>'))
    meta = F.concat(F.lit('<span itemprop="price" content="'), (F.col("page_id") + 1).cast("string"), F.lit('">x</span>'))
    price = F.when(F.col("page_id") % 3 == 0, ld).when(F.col("page_id") % 3 == 1, meta).otherwise("")
    more = F.concat(F.lit('<table><tr><th>range</th><td>'), i, F.lit(' m</td></tr></table><div class="breadcrumb"><a href="/">Home</a><a href="/c">Cat '), (F.col("page_id") % 5).cast("string"), F.lit('</a><span>this</span></div><div><a href="/p1">thing '), i, F.lit("</a> <b>"), i, F.lit('0 EUR</b></div><div><img data-src="/i.jpg" src="/lazy.gif"><a href="/p2">other thing</a> <b>25</b> <b>EUR</b></div><div><b>9 EUR delivery</b><a href="/d">by post</a></div><a href="/">home</a> 5 EUR<div class="card"><b class="number">N'), i, F.lit('</b><i class="subject">S</i><i class="price">1 000</i><i class="status">open</i><div class="title">Placed</div><div class="value">'), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit(".01.2024</div></div>"))
    config = F.when(F.col("page_id") % 7 == 0, F.create_map(F.lit("name"), F.lit("div.card .subject"), F.lit("price"), F.lit("div.card i[class=price]")))
    return pages(spark, d).withColumn("html", F.concat(price, "html", more)).withColumn("parser", config)


@query("jsonld_products", "SELECT page_id, 'item ' || page_id AS name, page_id * 10 + 5.5::DOUBLE AS price, 'EUR' AS currency, 'InStock' AS availability, NULL AS image, 'B' AS brand, 's' || page_id AS sku FROM pages WHERE page_id % 3 = 0")
def jsonld_products(spark, d):
    return O.jsonld_products(shop_pages(spark, d))


@query("product_page_offers", "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 1000 ELSE CASE page_id % 3 WHEN 0 THEN page_id * 10 + 5.5 WHEN 1 THEN page_id + 1 ELSE page_id * 10 END END::DOUBLE AS price, CASE WHEN page_id % 7 = 0 THEN 'selector' ELSE ['jsonld', 'microdata', 'text'][(page_id % 3 + 1)::INT] END AS how FROM pages")
def product_page_offers(spark, d):
    return O.product_page_offers(shop_pages(spark, d), selectors="parser").select("page_id", "price", "how")


@query("catalog_page_offers", "SELECT page_id, 'thing ' || page_id AS name, '/p1' AS url, page_id * 10::DOUBLE AS price, NULL AS image FROM pages UNION ALL SELECT page_id, 'other thing', '/p2', 25, '/i.jpg' FROM pages")
def catalog_page_offers(spark, d):
    return O.catalog_page_offers(shop_pages(spark, d))


@query("page_specs_structured", "SELECT page_id, 'range' AS key, page_id || ' m' AS value FROM pages")
def page_specs_structured(spark, d):
    return O.structured_specs(shop_pages(spark, d)).filter("key = 'range'")


@query("page_specs_labels", "SELECT page_id, 'Receiver · Range' AS key, page_id || ' m' AS value FROM pages UNION ALL SELECT page_id, 'Receiver · Weight', (page_id * 2) || ' g' FROM pages UNION ALL SELECT page_id, 'Battery', (page_id % 9) || ' h' FROM pages UNION ALL SELECT page_id, 'Channels', '16' FROM pages WHERE page_id % 2 = 0")
def page_specs_labels(spark, d):
    i = F.col("page_id").cast("string")
    lines = F.array(
        F.concat(F.lit("It works "), (F.col("page_id") % 9).cast("string"), F.lit(" hours")), F.when(F.col("page_id") % 2 == 0, "Channels - 16").otherwise("Channels: many"), F.lit("Receiver"),
        F.concat(F.lit("Range: "), i, F.lit(" m")), F.lit("Weight"), F.concat((F.col("page_id") * 2).cast("string"), F.lit(" g")), F.lit("Related products"), F.lit("Channels: 99"))
    labels = [("Range", "range"), ("Weight", "weight"), ("Channels", "channels"), ("Battery", "battery")]
    x = O.label_specs(pages(spark, d).select("page_id", lines.alias("lines")), labels, "^(Receiver|Transmitter)", [("Battery", "works ([0-9]+) hours", " h"), ("Range", "reaches ([0-9]+)", " m")], "^Related")
    return x.select("page_id", F.explode("specs").alias("key", "value"))


@query("merge_specs", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'new' ELSE 'old' END AS a, 'x' AS b, CASE WHEN page_id % 2 = 0 THEN 'y' END AS c FROM pages")
def merge_specs(spark, d):
    m = O.merge_specs(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("x")), F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.lit("y"))))
    return read(spark, d, "pages").select("page_id", m.alias("m")).select("page_id", *(F.element_at("m", k).alias(k) for k in "abc"))


@query("breadcrumb_path", "SELECT page_id, ['Cat ' || (page_id % 5)] AS path FROM pages")
def breadcrumb_path(spark, d):
    return O.breadcrumb_path(shop_pages(spark, d))


MENU = r"""mn AS (SELECT DISTINCT host, 'http://' || host || '/' || section || CASE WHEN page_id % 2 = 0 THEN '' ELSE '/' || (page_id % 7) END AS url FROM (SELECT page_id, host, regexp_extract(url, '^[a-z]+://[^/]+/([^/?]+)', 1) AS section FROM page))"""


@query("menu_categories", "{page} , " + MENU + " , j AS (SELECT a.host, a.url, b.url AS parent FROM mn a LEFT JOIN mn b ON a.host = b.host AND starts_with(a.url, b.url || '/')) SELECT host, url, arg_max(parent, length(parent)) AS parent, count(parent) + 1 AS level FROM j GROUP BY 1, 2")
def menu_categories(spark, d):
    p = pages(spark, d).withColumn("section", F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?]+)", 1))
    m = p.select("host", F.concat(F.lit("http://"), "host", F.lit("/"), "section", F.when(F.col("page_id") % 2 == 0, "").otherwise(F.concat(F.lit("/"), (F.col("page_id") % 7).cast("string")))).alias("url"))
    return O.menu_categories(m, F.length("url") > 0)


@query("crumb_categories", "{page} SELECT host, name, min(level)::INT AS level, min(parent) AS parent, count(*) AS n FROM (SELECT host, 'top' AS name, 1 AS level, NULL AS parent FROM page UNION ALL SELECT host, 'c' || (page_id % 4), 2, 'top' FROM page) WHERE name <> 'c2' GROUP BY 1, 2")
def crumb_categories(spark, d):
    p = pages(spark, d).select("host", F.array(F.lit("top"), F.concat(F.lit("c"), (F.col("page_id") % 4).cast("string"))).alias("path"))
    return O.crumb_categories(p, p.select("host", F.lit("c2").alias("name")).distinct())


FEATURE_RULES = [("warranty", r"([0-9]+) years"), ("delivery", "(?i)delivery"), ("use", r"for (museums|tours|plants)")]
FEAT = """ft AS (SELECT page_id, host, page_id % 5 <> 0 AS own, greatest(page_id % 9, page_id % 4) AS years, page_id % 3 = 0 AS m, page_id % 2 = 0 AS d, 'We give ' || (page_id % 9) || ' years, once ' || (page_id % 4) || ' years' || CASE WHEN page_id % 2 = 0 THEN ' and Delivery' ELSE '' END || ' for tours' || CASE WHEN page_id % 3 = 0 THEN ' for museums for tours' ELSE '' END AS t FROM page),
    fs AS (SELECT page_id, host, own, 'warranty' AS field, years::VARCHAR AS value, substr(t, 1, 180) AS snippet FROM ft UNION ALL SELECT page_id, host, own, 'delivery', 'yes', substr(t, 1, 180) FROM ft WHERE d UNION ALL SELECT page_id, host, own, 'use', 'tours', substr(t, 1, 180) FROM ft UNION ALL SELECT page_id, host, own, 'use', 'museums', substr(t, 1, 180) FROM ft WHERE m)"""


def featured(spark, d):
    i = F.col("page_id")
    t = F.concat(F.lit("We give "), (i % 9).cast("string"), F.lit(" years, once "), (i % 4).cast("string"), F.lit(" years"), F.when(i % 2 == 0, " and Delivery").otherwise(""), F.lit(" for tours"), F.when(i % 3 == 0, " for museums for tours").otherwise(""))
    return pages(spark, d).select("page_id", "host", t.alias("t"), (i % 5 != 0).alias("own_domain"))


def found_features(spark, d):
    return O.page_features(featured(spark, d), FEATURE_RULES, "t", numeric=["warranty"], many=["use"])


@query("page_features", "{page} , " + FEAT + " SELECT page_id, field, value, snippet FROM fs")
def page_features(spark, d):
    return found_features(spark, d)


@query("merge_features", "{page} , " + FEAT + " SELECT host, field, CASE WHEN field = 'warranty' THEN max(value::INT) END::DOUBLE AS number, CASE field WHEN 'delivery' THEN 'yes' WHEN 'use' THEN array_to_string(list_sort(list_distinct(list(value))), '; ') END AS value, count(DISTINCT page_id) AS pages FROM (SELECT page_id, host, own, field, CASE WHEN field = 'warranty' THEN value ELSE NULL END AS w, value FROM fs) WHERE own GROUP BY host, field".replace("max(value::INT)", "max(w::INT)"))
def merge_features(spark, d):
    return O.merge_features(found_features(spark, d).join(featured(spark, d).select("page_id", "host", "own_domain"), "page_id"), "host", ["warranty"], ["use"])


@query("page_summary", "SELECT page_id, 'About ' || page_id AS description, ['Head ' || page_id] AS headings FROM pages")
def page_summary(spark, d):
    return O.page_summary(made_pages(spark, d))


@query("image_candidates", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/img/' || page_id || '.jpg' WHEN 1 THEN '/og/' || page_id || '.jpg' WHEN 2 THEN '/lazy.jpg' ELSE '/x.png' END AS image FROM pages")
def image_candidates(spark, d):
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    src = F.when(k == 0, F.concat(F.lit('src="/img/'), i, F.lit('.jpg"'))).when(k == 2, 'src="/tiny.gif" data-src="/lazy.jpg"').otherwise('src="/x.png"')
    meta = F.when(k == 1, F.concat(F.lit('<meta content="/og/'), i, F.lit('.jpg" property="og:image">'))).otherwise('<meta property="og:image" content="/site-logo.png">')
    made = F.concat(F.lit('<img src="/logo.svg"><img width="20" src="/dot.png"><img alt="a" '), src, F.lit('><img src="/y.jpg">'), meta)
    return pages(spark, d).select("page_id", O.image_candidate(F.concat(made, "html"), "logo|sprite").alias("image"))


@query("tender_cards", "SELECT page_id, 'N' || page_id AS number, 'S' AS subject, NULL AS customer, 1000::DOUBLE AS price, 'open' AS status, '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS date FROM pages")
def tender_cards(spark, d):
    return O.tender_cards(shop_pages(spark, d))
