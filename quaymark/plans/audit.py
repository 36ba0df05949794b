"""Queries of the catalogue audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as O
from ..operators.aggregates import dominant_spelling
from ..operators.joins import twins
from .bindings import catalog, price_obs, read
from .joins import SITES, sites
from .registry import query


def spec_map(i):
    """Specs that follow from an id, one name written in two ways and one with a foreign letter."""
    of = lambda n: (i % n).cast("string")
    return F.map_concat(
        F.create_map(F.when(i % 5 == 0, "Power ").otherwise("power"), of(3), F.lit("ports"), of(2), F.lit("size"), (F.floor(i / 500) % 3).cast("string"), F.lit("colour"), i.cast("string")),
        F.when(i % 70 == 1, F.create_map(F.lit("LСD"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>")))


SPEC_ROWS = """sr AS (SELECT item_id, site, name, unnest([CASE WHEN item_id % 5 = 0 THEN 'Power ' ELSE 'power' END, 'ports', 'size', 'colour', CASE WHEN item_id % 70 = 1 THEN 'LСD' END]) AS key, unnest([(item_id % 3)::VARCHAR, (item_id % 2)::VARCHAR, (item_id // 500 % 3)::VARCHAR, item_id::VARCHAR, '1']) AS value FROM cards WHERE item_id % 6 <> 0)"""


def cards(spark, d):
    """Own items on two sites with old prices, images, specs and descriptions that depend on the id."""
    c, i = catalog(spark, d), F.col("item_id")
    return c.withColumns({
        "site": F.when(i % 2 == 0, "one").otherwise("two"), "price": F.when(i % 41 != 0, F.col("price")), "old_price": F.when(i % 5 == 0, F.floor(F.col("price") * (1.2 - (i % 3) / F.lit(5.0)))).cast("double"),
        "images": F.when(i % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a.jpg"))), "specs": F.when(i % 6 == 0, F.create_map().cast("map<string,string>")).otherwise(spec_map(i)),
        "description": F.repeat(F.col("name"), (i % 5).cast("int")), "sku": F.when(i % 4 != 0, F.col("model_key")), "brand": F.when(i % 8 == 0, F.upper("brand")).otherwise(F.col("brand")),
    })


CARDS = """cards AS (SELECT item_id, name, CASE WHEN item_id % 8 = 0 THEN upper(brand) ELSE brand END AS brand, category, kind, capacity, model_key, CASE WHEN item_id % 2 = 0 THEN 'one' ELSE 'two' END AS site, CASE WHEN item_id % 41 <> 0 THEN price END AS price,
    CASE WHEN item_id % 5 = 0 THEN floor(price * (1.2::DOUBLE - (item_id % 3) / 5.0::DOUBLE)) END::DOUBLE AS old_price, CASE WHEN item_id % 9 = 0 THEN 0 ELSE 1 END AS images, CASE WHEN item_id % 6 = 0 THEN 0 ELSE 1 END AS specs,
    repeat(name, (item_id % 5)::INT) AS description, CASE WHEN item_id % 4 <> 0 THEN model_key END AS sku FROM catalog)"""


def issue_sql(area: str, source: str, tests: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT item_id, site, '{area}' AS area, '{n}' AS issue, '{p}' AS priority FROM {source} WHERE {c}" for n, p, c in tests)


PRICES = issue_sql("prices", "(SELECT *, min(price) FILTER (capacity < 10) OVER (PARTITION BY site, model_key) AS part FROM cards)", [
    ("no price", "P1", "price IS NULL"), ("old price is not higher", "P2", "old_price <= price"), ("old price is not a multiple of ten", "P3", "old_price % 10 <> 0"), ("bundle is cheaper than a part", "P1", "kind = 'ring' AND price < part")])
COMPLETE = issue_sql("cards", "cards", [("no image", "P1", "images = 0"), ("no specs", "P2", "specs = 0"), ("short description", "P3", "length(description) < 20"), ("no sku", "P2", "sku IS NULL"), ("no section", "P2", "category IS NULL"), ("brand spelling", "P3", "brand <> upper(left(brand, 1)) || lower(substr(brand, 2))")])


@query("audit_prices", "{catalog} , " + CARDS + " " + PRICES)
def audit_prices(spark, d):
    return O.audit_prices(cards(spark, d), F.col("capacity") < 10, F.col("kind") == "ring")


@query("audit_cross_site", "{catalog} , " + SITES + """ SELECT item_id, 'one' AS site, 'sites' AS area, 'only on one site' AS issue, 'P2' AS priority FROM one WHERE item_id NOT IN (SELECT item_id FROM two) UNION ALL SELECT item_id, 'two', 'sites', 'only on one site', 'P2' FROM two WHERE item_id NOT IN (SELECT item_id FROM one)
    UNION ALL SELECT item_id, 'both', 'sites', 'price differs', 'P1' FROM one o JOIN two t USING (item_id) WHERE abs(o.price - t.price) >= 1""")
def audit_cross_site(spark, d):
    return O.audit_cross_site(*sites(spark, d), "item_id")


@query("audit_duplicates", "{catalog} , " + CARDS + ", " + SPEC_ROWS + """ , g AS (SELECT site, name, count(*) AS n, count(DISTINCT price) AS prices, min(item_id) AS item_id FROM cards GROUP BY 1, 2 HAVING count(*) > 1), p AS (SELECT site, name, key, count(*) AS have, count(DISTINCT value) AS vals FROM sr WHERE key IS NOT NULL GROUP BY 1, 2, 3),
    e AS (SELECT g.*, (SELECT count(*) FROM p WHERE p.site = g.site AND p.name = g.name AND key <> 'colour' AND (have < n OR vals > 1)) AS differ, coalesce((SELECT bool_or(vals = n) FROM p WHERE p.site = g.site AND p.name = g.name AND key = 'colour'), false) AS coloured FROM g),
    k AS (SELECT *, CASE WHEN coloured AND differ <= 2 THEN 'colour variants' WHEN differ >= 3 THEN 'different goods' WHEN prices > 1 THEN 'price conflict' ELSE 'duplicate' END AS issue FROM e) SELECT item_id, site, 'duplicates' AS area, issue, CASE WHEN issue IN ('different goods', 'price conflict') THEN 'P1' ELSE 'P2' END AS priority, n, differ FROM k""")
def audit_duplicates(spark, d):
    return O.audit_duplicates(cards(spark, d), "name")


@query("audit_series_specs", """{catalog} , x AS (SELECT DISTINCT kind, category, brand, capacity % 6 AS k FROM catalog), e AS (SELECT kind, category, list_distinct(list(k)) AS ks FROM x GROUP BY 1, 2), m AS (SELECT x.kind, x.category, x.brand, list(k) AS own, any_value(ks) AS ks FROM x JOIN e USING (kind, category) GROUP BY 1, 2, 3)
    SELECT kind, category, brand, list_sort(list_filter(ks, lambda k: NOT list_contains(own, k))) AS missing FROM m WHERE len(list_filter(ks, lambda k: NOT list_contains(own, k))) BETWEEN 1 AND greatest(3, len(ks) / 3)""")
def audit_series_specs(spark, d):
    from ..operators.sets import missing_in_members

    return missing_in_members(catalog(spark, d).withColumn("k", F.col("capacity") % 6), ["kind", "category"], "brand", "k")


@query("audit_completeness", "{catalog} , " + CARDS + " " + COMPLETE)
def audit_completeness(spark, d):
    return O.audit_completeness(cards(spark, d), 20)


@query("brand_spelling", "{catalog} , " + CARDS + " , n AS (SELECT lower(brand) AS key, brand, count(*) AS n FROM cards GROUP BY 1, 2) SELECT key, brand, n, common FROM (SELECT *, first_value(brand) OVER (PARTITION BY key ORDER BY n DESC, brand DESC) AS common, count(*) OVER (PARTITION BY key) AS s FROM n) WHERE s > 1 AND brand <> common")
def brand_spelling(spark, d):
    return dominant_spelling(cards(spark, d).withColumn("key", F.lower("brand")), ["key"], "brand").select("key", "brand", "n", "common")


NAMED = """nm AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'one' ELSE 'two' END AS site, CASE WHEN item_id % 13 = 0 THEN item_id - 1 END AS parent, name || CASE WHEN item_id % 9 = 0 THEN ' AX-' WHEN item_id % 9 < 3 THEN ' AX ' ELSE ' AX' END || (capacity % 10) || ' for ' || capacity || ' ' || ['persons', 'slots', 'pcs'][(item_id % 3 + 1)::INT] || CASE WHEN item_id % 13 = 0 THEN ' — RTK' || (10000 + item_id) ELSE '' END AS name,
    CASE WHEN item_id % 4 = 0 THEN 'a two way system' WHEN item_id % 4 = 1 THEN 'two-way systems' ELSE 'plain' END AS description FROM catalog),
    f AS (SELECT 'code' AS "check", 'AX' || (capacity % 10) AS key, 'AX' || CASE WHEN item_id % 9 = 0 THEN '-' WHEN item_id % 9 < 3 THEN ' ' ELSE '' END || (capacity % 10) AS form, item_id FROM nm JOIN (SELECT item_id, capacity FROM catalog) USING (item_id) WHERE parent IS NULL
        UNION ALL SELECT 'term', 'two-way', CASE WHEN item_id % 4 = 0 THEN 'two way' ELSE 'two-way' END, item_id FROM nm WHERE parent IS NULL AND item_id % 4 < 2 UNION ALL SELECT 'term', 'system', 'system', item_id FROM nm WHERE parent IS NULL AND item_id % 4 < 2
        UNION ALL SELECT 'unit', 'unit', ['persons', 'slots', 'pcs'][(item_id % 3 + 1)::INT], item_id FROM nm WHERE parent IS NULL),
    m AS (SELECT "check", key, form, count(*) AS n, min(item_id) AS item_id FROM f GROUP BY 1, 2, 3), c AS (SELECT *, first_value(form) OVER (PARTITION BY "check", key ORDER BY n DESC, form DESC) AS common FROM m)"""


@query("audit_naming", "{catalog} , " + NAMED + """ SELECT "check", key, form, n, common, item_id FROM c WHERE form <> common UNION ALL SELECT 'variant', site, arg_min(name, item_id), count(*), NULL, min(item_id) FROM nm WHERE parent IS NOT NULL GROUP BY site""")
def audit_naming(spark, d):
    i, cap = F.col("item_id"), F.col("capacity")
    name = F.concat("name", F.when(i % 9 == 0, " AX-").when(i % 9 < 3, " AX ").otherwise(" AX"), (cap % 10).cast("string"), F.lit(" for "), cap.cast("string"), F.lit(" "),
                    F.element_at(F.array(F.lit("persons"), F.lit("slots"), F.lit("pcs")), (i % 3 + 1).cast("int")), F.when(i % 13 == 0, F.concat(F.lit(" — RTK"), (i + 10000).cast("string"))).otherwise(""))
    c = catalog(spark, d).withColumns({
        "site": F.when(i % 2 == 0, "one").otherwise("two"), "parent": F.when(i % 13 == 0, i - 1), "name": name, "description": F.when(i % 4 == 0, "a two way system").when(i % 4 == 1, "two-way systems").otherwise("plain")})
    return O.audit_naming(c, "name", "description", r"\bAX[ -]?[0-9]+", [("two-way", r"two[ -]way", "$^"), ("system", r"systems?", "s$")], r"[0-9]+ (persons|slots|pcs)", " — [A-Z0-9]{5,}$")


@query("audit_spec_keys", "{catalog} , " + CARDS + ", " + SPEC_ROWS + """ , n AS (SELECT trim(lower(key), ' ') AS k, key, count(*) AS n, min(struct_pack(item_id, site)) AS x FROM sr WHERE key IS NOT NULL GROUP BY 1, 2), c AS (SELECT *, first_value(key) OVER (PARTITION BY k ORDER BY n DESC, key DESC) AS common FROM n)
    SELECT x.item_id AS item_id, x.site AS site, 'structure' AS area, 'spec ' || key || ' is usually ' || common AS issue, 'P3' AS priority FROM c WHERE key <> common UNION ALL SELECT x.item_id, x.site, 'structure', 'mixed alphabets in spec ' || key, 'P2' FROM n WHERE key = 'LСD'""")
def audit_spec_keys(spark, d):
    return O.audit_spec_keys(cards(spark, d), "specs", [("ё", "е")])


TYPO = issue_sql("typography", "(SELECT doc_id AS item_id, source AS site, text FROM documents)", [
    ("double space", "P3", "contains(text, '  ')"), ("space before punctuation", "P3", "regexp_matches(text, ' [,.;:!?]')"), ("no space after a comma", "P3", "regexp_matches(text, ',[A-Za-z]')"),
    ("unbalanced brackets", "P3", "length(text) - length(replace(text, '(', '')) <> length(text) - length(replace(text, ')', ''))"), ("mixed alphabets", "P2", "regexp_matches(text, '[A-Za-z][а-яА-Я]|[а-яА-Я][A-Za-z]')"), ("shouting", "P3", "contains(text, '!!')")])


def texts(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("site"), "text")


@query("audit_typography", TYPO)
def audit_typography(spark, d):
    return O.audit_typography(texts(spark, d), "text")


@query("audit_glued_words", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents), v AS (SELECT word FROM w WHERE length(word) >= 3 GROUP BY 1 HAVING count(*) >= 400), l AS (SELECT DISTINCT word FROM w WHERE length(word) >= 14),
    c AS (SELECT word, unnest(range(3, length(word) - 2)) AS pos FROM l), o AS (SELECT word, pos FROM c WHERE substr(word, 1, pos) IN (SELECT word FROM v) AND substr(word, pos + 1) IN (SELECT word FROM v)), b AS (SELECT word, min(pos) AS pos FROM o GROUP BY 1)
    SELECT DISTINCT doc_id, word, substr(word, 1, pos) AS head, substr(word, pos + 1) AS tail FROM w JOIN b USING (word)""")
def audit_glued_words(spark, d):
    return O.glued_words(read(spark, d, "documents"), "doc_id", "text", 14, 400)


STRUCT = """n AS (SELECT kind, brand, category, count(*) AS n FROM sc GROUP BY 1, 2, 3), x AS (SELECT *, first_value(category) OVER (PARTITION BY kind, brand ORDER BY n DESC, category DESC) AS usual, max(n) OVER (PARTITION BY kind, brand) / (sum(n) OVER (PARTITION BY kind, brand))::DOUBLE AS share FROM n)"""


@query("audit_structure", "{catalog} , sc AS (SELECT item_id, 'one' AS site, kind, brand, CASE WHEN item_id % 4 > 0 THEN 'MAIN' ELSE category END AS category FROM catalog), " + STRUCT + " SELECT item_id, site, 'structure' AS area, 'usually in ' || usual AS issue, 'P3' AS priority FROM sc JOIN x USING (kind, brand, category) WHERE category <> usual AND share >= 0.5")
def audit_structure(spark, d):
    c = catalog(spark, d).withColumn("site", F.lit("one")).withColumn("category", F.when(F.col("item_id") % 4 > 0, "MAIN").otherwise(F.col("category")))
    return O.audit_structure(c, ["kind", "brand"], "category")


RUN = """e AS (""" + PRICES + " UNION ALL " + COMPLETE + """), x AS (SELECT *, count(*) OVER (PARTITION BY site, area, issue, priority) AS n FROM e), r AS (SELECT min(item_id) AS item_id, site, area, issue, priority, count(*) AS n FROM x WHERE priority = 'P3' AND n >= 6 GROUP BY 2, 3, 4, 5 UNION ALL SELECT item_id, site, area, issue, priority, 1 FROM x WHERE NOT (priority = 'P3' AND n >= 6)),
    run AS (SELECT r.*, item_id % 10 = 0 AND issue = 'no sku' AS dismissed, CASE WHEN item_id % 7 = 0 THEN 'none' ELSE category END AS category FROM r JOIN catalog USING (item_id))"""


def the_run(spark, d):
    c = cards(spark, d)
    gone = c.filter("item_id % 10 = 0").select("item_id", F.lit("no sku").alias("issue"))
    named = catalog(spark, d).select("item_id", F.when(F.col("item_id") % 7 != 0, F.col("category")).alias("category"))
    return O.audit_run([O.audit_prices(c, F.col("capacity") < 10, F.col("kind") == "ring"), O.audit_completeness(c, 20)], gone, items=named)


@query("audit_run", "{catalog} , " + CARDS + " , " + RUN + " SELECT * FROM run")
def audit_run(spark, d):
    return the_run(spark, d)


@query("audit_counts", "{catalog} , " + CARDS + " , " + RUN + " SELECT site, area, category, count(*) AS n, count(*) FILTER (priority = 'P1') AS \"P1\", count(*) FILTER (priority = 'P2') AS \"P2\", count(*) FILTER (priority = 'P3') AS \"P3\" FROM run WHERE NOT dismissed GROUP BY GROUPING SETS ((site), (area), (category), ())")
def audit_counts(spark, d):
    return O.audit_counts(the_run(spark, d))


STOCK = """l AS (SELECT item_id, max(observed_at::DATE) FILTER (availability = 'InStock') AS last_in_stock, arg_max(availability, struct_pack(observed_at, seq, qty, price)) AS status FROM price_obs GROUP BY 1), c AS (SELECT *, NULL::VARCHAR AS sku FROM catalog),
    t AS (SELECT a.item_id, min(b.item_id) AS twin_id FROM c a JOIN c b ON a.model_key = b.model_key AND a.capacity IS NOT DISTINCT FROM b.capacity AND a.kind = b.kind AND a.item_id <> b.item_id GROUP BY 1), sr AS (SELECT item_id, category, status, last_in_stock, twin_id FROM catalog JOIN l USING (item_id) LEFT JOIN t USING (item_id) WHERE status <> 'InStock')"""


def report(spark, d):
    c = catalog(spark, d)
    return O.stock_report(c, price_obs(spark, d), twins(c.withColumn("sku", F.lit(None).cast("string"))))


@query("stock_report", "{catalog price_obs} , " + STOCK + " SELECT * FROM sr")
def stock_report(spark, d):
    return report(spark, d)


@query("stock_totals", "{catalog price_obs} , " + STOCK + " SELECT category, items, coalesce(missing, 0) AS missing, coalesce(never, 0) AS never, coalesce(replaced, 0) AS replaced, last FROM (SELECT category, count(*) AS items FROM catalog GROUP BY 1) LEFT JOIN (SELECT category, count(*) AS missing, count(*) FILTER (last_in_stock IS NULL) AS never, count(twin_id) AS replaced, max(last_in_stock) AS last FROM sr GROUP BY 1) USING (category)")
def stock_totals(spark, d):
    return O.stock_totals(report(spark, d), catalog(spark, d))
