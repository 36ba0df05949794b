"""Queries of the text and number operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as O
from ..operators.joins import band_class as _band_class
from ..operators.joins import price_ratio as _price_ratio
from .bindings import catalog, offers, read
from .registry import query


@query("clean_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(left(text, 100000), '[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\x{3164}\x{115f}\x{1160}]', '', 'g'), '[ \t\n\r\f\v\x{00a0}\x{2002}\x{2003}\x{2007}\x{2009}\x{202f}]+', ' ', 'g'), ' ') AS text FROM documents".replace("left(text, 100000)", "text"))
def clean_text(spark, d):
    return read(spark, d, "documents").select("doc_id", O.clean_text(F.col("text")).alias("text"))


PRICE_TEXT = "CASE p_partkey % 4 WHEN 0 THEN 'from ' || p_size || ' 500 eur each' WHEN 1 THEN p_size || '.250 usd' WHEN 2 THEN 'only ' || p_size || ',50' ELSE 'none' END"


def price_texts(spark, d):
    p = read(spark, d, "part")
    s = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 4
    return p.select(F.col("p_partkey").alias("item_id"), F.when(k == 0, F.concat(F.lit("from "), s, F.lit(" 500 eur each"))).when(k == 1, F.concat(s, F.lit(".250 usd"))).when(k == 2, F.concat(F.lit("only "), s, F.lit(",50"))).otherwise("none").alias("price_text"))


@query("parse_price", f"SELECT p_partkey AS item_id, {PRICE_TEXT} AS price_text, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000 + 500 WHEN 1 THEN p_size * 1000 + 250 WHEN 2 THEN p_size + 0.5 END::DOUBLE AS price FROM part")
def parse_price(spark, d):
    return price_texts(spark, d).withColumn("price", O.parse_price(F.col("price_text")))


@query("detect_brand", "SELECT p_partkey AS item_id, coalesce(CASE WHEN p_partkey % 10 = 0 THEN p_brand END, CASE WHEN contains(p_name, 'red') THEN 'Red' WHEN contains(p_name, 'ring') THEN 'Ring' WHEN contains(p_name, 'blue') THEN 'Blue' END) AS brand FROM part")
def detect_brand(spark, d):
    p = read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("item_id"), O.detect_brand(F.col("p_name"), ["Red", "Ring", "Blue"], F.when(F.col("p_partkey") % 10 == 0, F.col("p_brand"))).alias("brand"))


@query("model_key", """SELECT p_partkey AS item_id, CASE p_partkey % 4 WHEN 0 THEN 'AB' || p_size || 'X' WHEN 1 THEN 'TT' || (100 + p_size) WHEN 2 THEN 'BRAND#' || substr(p_brand, 7) ELSE NULL END AS code FROM part""")
def model_key(spark, d):
    p = read(spark, d, "part")
    k, s = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    name = F.when(k == 0, F.concat_ws("-", F.concat(F.col("p_name"), F.lit(" AB")), F.concat(s, F.lit("x")))).when(k == 1, F.concat(F.lit("gear ТТ"), (F.col("p_size") + 100).cast("string"), F.lit(" big"))).when(k == 2, F.concat(F.lit("no code USB"), s)).otherwise("plain")
    x = p.select(F.col("p_partkey").alias("item_id"), name.alias("name"), F.when(k == 2, F.col("p_brand")).alias("sku"))
    return x.select("item_id", O.model_key(F.col("name"), F.col("sku"), [r"\b([A-Z]{2,4}-?[0-9]+[A-Z]?)\b"], "^USB").alias("code"))


RULES = [O.Rule("name", "^red", "hot"), O.Rule("brand", "#1[0-9]", "tens"), O.Rule("name", "ring|gear", "round"), O.Rule("category", "promo", "sale")]
RULE_SQL = "CASE WHEN regexp_matches(lower(name), '^red') THEN 'hot' WHEN regexp_matches(lower(brand), '#1[0-9]') THEN 'tens' WHEN regexp_matches(lower(name), 'ring|gear') THEN 'round' WHEN regexp_matches(lower(category), 'promo') THEN 'sale' END"


@query("classify_by_rules", "{catalog} SELECT item_id, " + RULE_SQL + " AS label FROM catalog")
def classify_by_rules(spark, d):
    return catalog(spark, d).select("item_id", O.first_label(RULES).alias("label"))


@query("classify_by_table", "SELECT doc_id, CASE WHEN contains(lower(text), 'stupid') THEN 'rude' WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(lower(text), 'the ') THEN 'plain' END AS label FROM documents")
def classify_by_table(spark, d):
    rules = spark.createDataFrame([(1, "stupid", "rude"), (2, "license", "legal"), (3, "the ", "plain")], "ord int, pattern string, label string")
    return O.first_label_by_table(read(spark, d, "documents").select("doc_id", "text"), rules, "doc_id", "text").select("doc_id", "label")


@query("model_hint", "{catalog} SELECT item_id, CASE WHEN NOT regexp_matches(name, 'small') THEN CASE WHEN regexp_matches(model_key, '^1[0-9]-') THEN 'system' WHEN regexp_matches(model_key, '-[1-5]$') THEN 'part' END END AS hint FROM catalog")
def model_hint(spark, d):
    hint = O.first_label([O.Rule("model_key", "^1[0-9]-", "system"), O.Rule("model_key", "-[1-5]$", "part")])
    return catalog(spark, d).select("item_id", F.when(~F.col("name").rlike("small"), hint).alias("hint"))


@query("detect_kind", "{catalog} SELECT item_id, CASE WHEN regexp_matches(head, 'ring') AND regexp_matches(head, 'red|blue') THEN 'kit' WHEN regexp_matches(head, 'ring') THEN 'ring' WHEN regexp_matches(head, 'gear') THEN 'gear' ELSE 'other' END AS kind FROM (SELECT item_id, split_part(lower(name || ' for ' || category), ' for ', 1) AS head FROM catalog)")
def detect_kind(spark, d):
    x = catalog(spark, d).withColumn("head", F.split_part(F.lower(F.concat_ws(" for ", "name", "category")), F.lit(" for "), F.lit(1)))
    both = F.when(F.col("head").rlike("ring") & F.col("head").rlike("red|blue"), "kit")
    return x.select("item_id", F.coalesce(both, O.first_label([O.Rule("head", "ring", "ring"), O.Rule("head", "gear", "gear")]), F.lit("other")).alias("kind"))


@query("detect_capacity", "SELECT p_partkey AS item_id, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size + 1 WHEN 2 THEN NULL ELSE NULL END AS capacity FROM part")
def detect_capacity(spark, d):
    p = read(spark, d, "part")
    k, s = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    more = (F.col("p_size") + 1).cast("string")
    x = p.select(F.col("p_partkey").alias("item_id"), F.when(k == 0, F.concat(F.lit("set of "), s, F.lit(" units"))).otherwise("set").alias("name"),
                 F.when(k == 1, F.concat(F.lit("has "), more, F.lit(" units"))).when(k == 2, F.concat(F.lit("5 units or "), more, F.lit("0 units"))).otherwise("variants: 5 units").alias("description"))
    return x.select("item_id", O.detect_capacity(F.col("name"), [F.col("description")], [r"([0-9]+) units"], "variants").alias("capacity"))


@query("pack_qty", "SELECT p_partkey AS item_id, CASE WHEN p_size >= 2 AND p_partkey % 2 = 0 THEN p_size END AS pack FROM part")
def pack_qty(spark, d):
    p = read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("item_id"), O.pack_qty(F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.lit("pcs"))).otherwise(F.col("p_name"))).alias("pack"))


@query("unit_price", """{catalog} SELECT item_id, CASE WHEN kind = 'ring' THEN CASE WHEN capacity >= 2 THEN round_even(price / capacity, 2) END WHEN category = 'PROMO' THEN CASE WHEN item_id % 2 = 0 THEN round_even(price / 3, 2) WHEN price <= 1000 THEN price END ELSE price END AS unit_price FROM catalog""")
def unit_price(spark, d):
    c = catalog(spark, d).withColumn("pack", F.when(F.col("item_id") % 2 == 0, 3))
    return c.select("item_id", O.unit_price(F.col("price"), F.col("capacity"), F.col("pack"), F.col("kind") == "ring", F.col("category") == "PROMO", 1000).alias("unit_price"))


RETAIL = "round_even({0} / CASE WHEN {0} < 1000 THEN 10 WHEN {0} < 10000 THEN 50 ELSE 100 END, 0) * CASE WHEN {0} < 1000 THEN 10 WHEN {0} < 10000 THEN 50 ELSE 100 END"


@query("round_retail_price", "{catalog} SELECT item_id, " + RETAIL.format("price") + " AS retail FROM catalog")
def round_retail_price(spark, d):
    return catalog(spark, d).select("item_id", O.round_retail_price(F.col("price")).alias("retail"))


@query("name_key", """{catalog} SELECT item_id, substr(regexp_replace(trim(regexp_replace(regexp_replace(lower(n), '[^a-zа-я0-9]+', ' ', 'g'), '\\b(?:small|red)\\b', ' ', 'g'), ' '), ' +', ' ', 'g'), 1, 60) AS words, upper(n) AS folded, substr(regexp_replace(lower(n), '[^a-zа-я0-9]', '', 'g'), 1, 80) AS alnum,
    regexp_replace(lower(n), '\\s+', '', 'g') AS tight FROM (SELECT item_id, name || ', ' || brand AS n FROM catalog)""".replace("\\\\", "\\"))
def name_key(spark, d):
    x = catalog(spark, d).select("item_id", F.concat_ws(", ", "name", "brand").alias("n"))
    return x.select("item_id", *(c.alias(k) for k, c in O.name_keys(F.col("n"), "small|red").items()))


@query("content_hash", "SELECT a.p_partkey AS item_id, count(*) AS same FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_size = b.p_size GROUP BY 1")
def content_hash(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("item_id"), O.content_hash(F.col("p_name"), F.col("p_size")).alias("h"))
    return p.join(p.groupBy("h").agg(F.count("*").alias("same")), "h").select("item_id", "same")


@query("flatten_specs", "SELECT event_id, json_extract_string(props, '$.k') AS k, (event_id % 10)::VARCHAR AS deep, CASE WHEN event_id % 2 = 0 THEN 'late' ELSE 'early' END AS both FROM events")
def flatten_specs(spark, d):
    e = read(spark, d, "events")
    last = F.when(F.col("event_id") % 2 == 0, F.lit(', "both": "late"')).otherwise("")
    text = F.concat(F.lit('{"k": "'), F.get_json_object("props", "$.k"), F.lit('", "both": "early", "group": {"deep": "'), (F.col("event_id") % 10).cast("string"), F.lit('"'), last, F.lit("}}"))
    m = e.select("event_id", O.flatten_specs(text).alias("m"))
    return m.select("event_id", F.col("m.k").alias("k"), F.col("m.deep").alias("deep"), F.col("m.both").alias("both"))


BANDS = [(r"2[.,]4", "2.4 GHz"), ("uhf", "UHF"), (r"\bir\b", "IR")]


def spec_texts(spark, d):
    p = read(spark, d, "part")
    s = F.col("p_size")
    return p.select(F.col("p_partkey").alias("item_id"), F.concat_ws(" ", F.col("p_name"), (s * 10).cast("string"), F.lit("m,"), s.cast("string"), F.lit("ch"), (s + 0.5).cast("string"), F.lit("h"), (s * 20).cast("string"), F.lit("g"),
        F.element_at(F.array(F.lit("2.4"), F.lit("UHF two-way"), F.lit("wired")), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("text"), F.when(s % 2 == 0, F.create_map(F.lit("seats"), F.concat(s.cast("string"), F.lit(" persons")))).alias("specs"))


SPEC_SQL = """spec AS (SELECT p_partkey AS item_id, CASE WHEN p_size * 10 >= 20 THEN p_size * 10 END::DOUBLE AS range_m, CASE WHEN p_size > 1 THEN p_size END::DOUBLE AS channels, (p_size + 0.5)::DOUBLE AS battery_h,
    CASE WHEN p_size * 20 <= 500 THEN p_size * 20 END::DOUBLE AS weight_g, [ '2.4 GHz', 'UHF', NULL][(p_partkey % 3 + 1)::INT] AS band, p_partkey % 3 = 1 AS two_way, false AS display, CASE WHEN p_size % 2 = 0 THEN p_size END::INT AS capacity FROM part)"""


@query("typed_specs", "WITH " + SPEC_SQL + " SELECT * FROM spec")
def typed_specs(spark, d):
    return spec_texts(spark, d).select("item_id", O.typed_specs(F.col("text"), BANDS, F.col("specs")).alias("s")).select("item_id", "s.*")


@query("spec_summary", "WITH " + SPEC_SQL + " SELECT item_id, concat_ws(', ', range_m::INT || ' m', channels::INT || ' ch', round_even(battery_h, 0)::INT || ' h', weight_g::INT || ' g', band, CASE WHEN two_way THEN 'two-way' END) AS summary FROM spec")
def spec_summary(spark, d):
    return spec_texts(spark, d).select("item_id", O.spec_summary(O.typed_specs(F.col("text"), BANDS)).alias("summary"))


@query("better_value", "{catalog} SELECT a.item_id, b.item_id AS other_id, sign(b.price - a.price)::INT AS price, sign(a.capacity - b.capacity)::INT AS capacity FROM catalog a JOIN catalog b ON b.item_id = a.item_id + 1")
def better_value(spark, d):
    c = catalog(spark, d)
    o = c.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other_id"), F.col("price").alias("p2"), F.col("capacity").alias("c2"))
    return c.join(o, "item_id").select("item_id", "other_id", O.better_value("price", F.col("price"), F.col("p2")).alias("price"), O.better_value("capacity", F.col("capacity"), F.col("c2")).alias("capacity"))


@query("domain_of", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z]+://)?([^/?#:]+)', 1)), '^www\.', '') AS domain, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS root FROM pages")
def domain_of(spark, d):
    return read(spark, d, "pages").select("page_id", O.domain_of(F.col("url")).alias("domain"), O.root_url(F.col("url")).alias("root"))


@query("map_labels", "SELECT c_custkey AS id, CASE WHEN contains(lower(c_mktsegment), 'build') THEN 'maker' WHEN contains(lower(c_mktsegment), 'auto') THEN 'shop' WHEN contains(lower(c_mktsegment), 'house') THEN 'shop' ELSE 'other' END AS kind FROM customer")
def map_labels(spark, d):
    rules = [O.Rule("c_mktsegment", "build", "maker"), O.Rule("c_mktsegment", "auto", "shop"), O.Rule("c_mktsegment", "house", "shop")]
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), O.first_label(rules, F.lit("other")).alias("kind"))


@query("parse_month", "SELECT o_orderkey AS id, date_trunc('month', o_orderdate)::DATE AS start, date_trunc('month', o_orderdate)::DATE + 27 AS \"end\" FROM orders WHERE o_orderkey % 6 <> 5 UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 6 = 5")
def parse_month(spark, d):
    o = read(spark, d, "orders")
    k = F.col("o_orderkey") % 6
    t = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, F.date_format("o_orderdate", "MM.yyyy")).when(
        k < 5, F.concat_ws(" ", F.element_at(F.array(*(F.lit(m.capitalize()) for m in O.MONTHS)), F.month("o_orderdate")), F.year("o_orderdate").cast("string"))).otherwise("soon")
    return o.select(F.col("o_orderkey").alias("id"), O.parse_month(t).alias("m")).select("id", "m.start", "m.end")


@query("format_money", """{catalog} SELECT item_id, replace(format('{:,}', round_even(price * 100, 0)::BIGINT), ',', ' ') AS money FROM catalog""".replace("{:,}", "{:,}"))
def format_money(spark, d):
    return catalog(spark, d).select("item_id", O.format_money(F.col("price") * 100).alias("money"))


@query("json_get_list", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN [] ELSE [json_extract_string(props, '$.k'), event_type] END AS items FROM events")
def json_get_list(spark, d):
    t = F.when(F.col("event_id") % 3 == 0, F.lit("oops")).otherwise(F.to_json(F.array(F.get_json_object("props", "$.k"), F.col("event_type"))))
    return read(spark, d, "events").select("event_id", O.json_list(t).alias("items"))


@query("band_class", "SELECT p_partkey AS item_id, ['digital', 'ir', 'analog', NULL][(p_partkey % 4 + 1)::INT] AS band FROM part")
def band_class(spark, d):
    b = F.element_at(F.array(F.lit("2.4 GHz"), F.lit("Infrared"), F.lit("VHF"), F.lit(None)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("item_id"), _band_class(b).alias("band"))


@query("price_ratio", "{catalog offers} SELECT offer_id, greatest(o.price, c.price) / nullif(least(o.price, c.price), 0) AS ratio FROM offers o JOIN catalog c USING (item_id)")
def price_ratio(spark, d):
    o = offers(spark, d).select("offer_id", "item_id", F.col("price").alias("p2"))
    return o.join(catalog(spark, d), "item_id").select("offer_id", _price_ratio(F.col("price"), F.col("p2")).alias("ratio"))


@query("model_spellings", r"""SELECT p_partkey AS item_id, upper(replace(replace(raw, '-', ''), ' ', '')) AS key, raw FROM (SELECT p_partkey, unnest(regexp_extract_all('kit ' || CASE WHEN p_partkey % 2 = 0 THEN 'AX-' ELSE 'AX ' END || p_size || ' and BX' || p_partkey, '[A-Z]{2}[ -]?[0-9]+')) AS raw FROM part)""")
def model_spellings(spark, d):
    name = F.concat(F.lit("kit "), F.when(F.col("p_partkey") % 2 == 0, "AX-").otherwise("AX "), F.col("p_size").cast("string"), F.lit(" and BX"), F.col("p_partkey").cast("string"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.explode(O.model_spellings(name, "[A-Z]{2}[ -]?[0-9]+")).alias("s")).select("item_id", "s.*")


@query("spec_key_norm", "SELECT DISTINCT p_brand AS raw, replace(trim(lower(p_brand), ' '), 'brand#', 'maker ') AS key FROM part")
def spec_key_norm(spark, d):
    return read(spark, d, "part").select(F.col("p_brand").alias("raw"), O.spec_key(F.col("p_brand"), [("brand#", "maker ")]).alias("key")).distinct()


RULES_SQL = "nullif(list_distinct(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({r.field}), '{r.pattern}') THEN '{r.label}' END" for r in RULES) + "], lambda x: x IS NOT NULL)), [])"


@query("label_sections", "{catalog} SELECT item_id, list_sort(CASE WHEN category = 'PROMO' AND item_id % 2 = 0 THEN ['sale', 'new'] ELSE " + RULES_SQL + " END) AS labels FROM catalog")
def label_sections(spark, d):
    over = spark.createDataFrame([(0, "Promo", "sale,new")], "site long, section string, labels string")
    x = catalog(spark, d).withColumn("site", F.col("item_id") % 2)
    return O.label_sections(x, over, RULES, "site", "category").select("item_id", F.array_sort("labels").alias("labels"))


@query("rental_and_default_category", "SELECT page_id, page_id % 5 = 0 OR contains(lower(url), '/de/') AS rental, coalesce(CASE WHEN page_id % 3 = 0 THEN 'own' END, 'page') AS category FROM pages")
def rental_and_default_category(spark, d):
    kind = F.when(F.col("page_id") % 5 == 0, "rental").otherwise("sale")
    rental, category = O.rental_and_category(kind, F.col("url"), F.when(F.col("page_id") % 3 == 0, "own"), F.lit("page"), "/de/")
    return read(spark, d, "pages").select("page_id", rental.alias("rental"), category.alias("category"))


@query("normalize_offers", "{catalog} , x AS (SELECT c.*, p.price_text, p.price AS pp FROM catalog c JOIN (SELECT p_partkey AS item_id, " + PRICE_TEXT + " AS price_text, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000 + 500 WHEN 1 THEN p_size * 1000 + 250 WHEN 2 THEN p_size + 0.5 END::DOUBLE AS price FROM part) p USING (item_id)) SELECT item_id, name AS clean_name, pp AS price, upper(model_key) AS code, " + RULE_SQL + " AS label FROM x")
def normalize_offers(spark, d):
    x = catalog(spark, d).drop("price").join(price_texts(spark, d), "item_id").withColumn("sku", F.col("model_key"))
    return O.normalise_offers(x, RULES, ["Red"], [r"\b([A-Z]{2,4}-?[0-9]+)\b"], "^USB").select("item_id", "clean_name", "price", "code", "label")
