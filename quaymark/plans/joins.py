"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as O
from ..operators.names import reconcile_by_similarity as by_similarity
from ..operators.signatures import signature_levels
from ..shared import materialise, stored
from .bindings import catalog, findings, matches, offers, read, run_log, sellers, signatures
from .registry import query


def sites(spark, d):
    """Two sites of the own catalogue: ids under and over a remainder, the second with moved prices."""
    c = catalog(spark, d).withColumn("sku", F.concat(F.lit(" sku"), F.col("item_id").cast("string")))
    one = c.filter("item_id % 10 < 8")
    two = c.filter("item_id % 10 >= 2").withColumn("price", F.col("price") * (1 + (F.col("item_id") % 7 - 3) / F.lit(100.0)))
    return one, two


SITES = """one AS (SELECT *, ' sku' || item_id AS sku FROM catalog WHERE item_id % 10 < 8), two AS (SELECT * REPLACE (price * (1 + (item_id % 7 - 3) / 100.0::DOUBLE) AS price), ' sku' || item_id AS sku FROM catalog WHERE item_id % 10 >= 2)"""


@query("offers_with_seller", "{sellers offers} SELECT offer_id, seller_id, coalesce(seller_group, seller_id::VARCHAR) AS seller_key, price FROM offers JOIN sellers USING (seller_id)")
def offers_with_seller(spark, d):
    return O.offers_with_seller(offers(spark, d), sellers(spark, d)).select("offer_id", "seller_id", "seller_key", "price")


@query("findings_with_context", "{catalog sellers findings} SELECT finding_id, f.item_id, c.name, s.seller FROM findings f LEFT JOIN catalog c USING (item_id) LEFT JOIN sellers s USING (seller_id)")
def findings_with_context(spark, d):
    c, s = catalog(spark, d).select("item_id", "name"), sellers(spark, d).select("seller_id", "seller")
    return findings(spark, d).join(c, "item_id", "left").join(s, "seller_id", "left").select("finding_id", "item_id", "name", "seller")


def aliases(spark, d):
    return read(spark, d, "part").filter("p_partkey % 100 = 0").select(F.concat(F.lit("X"), F.substring("p_brand", 7, 10)).alias("alias_code"), F.concat(F.substring("p_brand", 7, 10), F.lit("-"), F.col("p_size").cast("string")).alias("own_code")).distinct()


def market_offers(spark, d):
    """Active offers whose code is an alias for some sellers, with moved capacities and brands."""
    return offers(spark, d).filter("is_active").withColumns({
        "model_key": F.when(F.col("seller_id") % 10 == 0, F.concat(F.lit("X"), F.substring("brand", 7, 10))).otherwise(F.col("model_key")),
        "capacity": F.when(F.col("offer_id") % 3 == 0, F.col("capacity") + 1).otherwise(F.col("capacity")),
        "brand": F.when(F.col("offer_id") % 4 == 0, F.lit("Brand#1")).otherwise(F.col("brand")),
    })


MARKET = """aliases AS (SELECT DISTINCT 'X' || substr(p_brand, 7, 10) AS alias_code, substr(p_brand, 7, 10) || '-' || p_size AS own_code FROM part WHERE p_partkey % 100 = 0),
    mo AS (SELECT * REPLACE (CASE WHEN seller_id % 10 = 0 THEN 'X' || substr(brand, 7, 10) ELSE model_key END AS model_key, CASE WHEN offer_id % 3 = 0 THEN capacity + 1 ELSE capacity END AS capacity,
        CASE WHEN offer_id % 4 = 0 THEN 'Brand#1' ELSE brand END AS brand) FROM offers WHERE is_active)"""

EXACT = """keys AS (SELECT offer_id, model_key AS code, false AS alias FROM mo WHERE length(model_key) >= 4 UNION ALL SELECT offer_id, own_code, true FROM mo JOIN aliases ON model_key = alias_code),
    sc AS (SELECT k.offer_id, c.item_id, c.kind <> o.kind AS ok, coalesce(c.capacity <> o.capacity, true) AS os,
        CASE WHEN alias THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END + CASE WHEN c.brand = o.brand THEN 0.1::DOUBLE ELSE -0.25::DOUBLE END + CASE WHEN c.capacity = o.capacity THEN 0.05::DOUBLE ELSE -0.15::DOUBLE END AS s
        FROM keys k JOIN catalog c ON c.model_key = k.code JOIN mo o ON o.offer_id = k.offer_id),
    ex0 AS (SELECT offer_id, item_id, max(struct_pack(confidence := round_even(least(greatest(CASE WHEN ok THEN least(s, 0.4::DOUBLE) WHEN os THEN least(s, 0.55::DOUBLE) ELSE s END, 0.2::DOUBLE), 0.98::DOUBLE), 4), match_type := CASE WHEN ok THEN 'functional' WHEN os THEN 'kit' ELSE 'exact' END)) AS m FROM sc GROUP BY 1, 2),
    ex AS (SELECT * FROM (SELECT offer_id, item_id, m.confidence AS confidence, m.match_type AS match_type, row_number() OVER (PARTITION BY offer_id ORDER BY m.confidence DESC, item_id) AS rn FROM ex0) WHERE rn <= 3)"""


@query("match_exact_model", "{catalog offers} , " + MARKET + ", " + EXACT + " SELECT offer_id, item_id, confidence, match_type, rn FROM ex")
def match_exact_model(spark, d):
    return O.match_exact_model(market_offers(spark, d), catalog(spark, d), aliases(spark, d)).withColumn("rn", F.col("rn").cast("long"))


SPEC_SQL = "CASE WHEN c.item_id % 2 = 0 AND o.offer_id % 2 <> 0 THEN 0.35::DOUBLE WHEN c.item_id % 2 <> 0 AND o.offer_id % 2 = 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN c.item_id % 3 <> o.offer_id % 3 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN greatest(c.capacity * 10, o.capacity * 12) / least(c.capacity * 10, o.capacity * 12) > 2 THEN 0.1::DOUBLE ELSE 0 END"
ANALOG = """an0 AS (SELECT o.offer_id, c.item_id, c.kind, round_even(CASE WHEN c.kind = 'ring' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END + CASE WHEN o.capacity = c.capacity THEN 0.25::DOUBLE WHEN abs(c.capacity - o.capacity) <= greatest(2, 0.2::DOUBLE * c.capacity) THEN 0.1::DOUBLE ELSE -0.15::DOUBLE END
        + CASE WHEN c.kind = 'ring' THEN CASE WHEN r <= 1.3 THEN 0.15::DOUBLE WHEN r <= 2 THEN 0.05::DOUBLE WHEN r > 2 THEN -0.1::DOUBLE ELSE 0 END WHEN r > 3 THEN -0.15::DOUBLE ELSE 0 END - (""" + SPEC_SQL + """), 4) AS s
        FROM (SELECT * FROM mo WHERE offer_id NOT IN (SELECT offer_id FROM ex)) o JOIN catalog c ON o.category = c.category AND o.kind = c.kind, LATERAL (SELECT greatest(o.price, c.price) / nullif(least(o.price, c.price), 0) AS r)),
    an AS (SELECT offer_id, item_id, least(greatest(s, 0.2::DOUBLE), 0.8::DOUBLE) AS confidence, CASE WHEN kind = 'bolt' AND s >= 0.55 THEN 'accessory' WHEN s >= 0.6 THEN 'direct' ELSE 'functional' END AS match_type, rn
        FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY s DESC, item_id) AS rn, max(s) OVER (PARTITION BY offer_id) AS top FROM an0)
        WHERE CASE WHEN kind = 'ring' THEN rn <= 2 AND top - s <= 0.15::DOUBLE + 1e-9 ELSE rn <= 3 AND s >= 0.55 END)"""


def with_spec(df, id_col, reach):
    """Rows with a spec struct that follows from their ids."""
    i = F.col(id_col)
    return df.withColumn("spec", F.struct((i % 2 == 0).alias("two_way"), F.element_at(F.array(F.lit("2.4 GHz"), F.lit("IR"), F.lit("VHF")), (i % 3 + 1).cast("int")).alias("band"), (F.col("capacity") * reach).alias("range_m")))


@query("match_analogs", "{catalog offers} , " + MARKET + ", " + EXACT + ", " + ANALOG + " SELECT offer_id, item_id, confidence, match_type, rn FROM an")
def match_analogs(spark, d):
    o, c = stored(market_offers(spark, d).select("offer_id", "model_key", "brand", "category", "kind", "capacity", "price")), catalog(spark, d)  # read for profiles and for analogs
    rest = O.without_exact_match(o, c, aliases(spark, d))
    return O.match_analogs(with_spec(rest, "offer_id", 12), with_spec(c, "item_id", 10), None, "ring", spec="spec", accessories=["bolt"]).withColumn("rn", F.col("rn").cast("long"))


@query("match_fallbacks", "{catalog offers} , " + MARKET + """ , i AS (SELECT * FROM catalog WHERE category NOT IN ('PROMO', 'SMALL') AND NOT (category = 'LARGE' AND kind = 'ring')), x AS (SELECT mo.*, EXISTS (SELECT 1 FROM i WHERE i.category = mo.category) AS hc, EXISTS (SELECT 1 FROM i WHERE i.category = mo.category AND i.kind = mo.kind) AS hk FROM mo WHERE offer_id % 2 = 1 AND brand <> 'Brand#9')
    SELECT offer_id, match_type, confidence FROM (SELECT offer_id, CASE WHEN brand = 'Brand#1' THEN 'adjacent' WHEN category = 'SMALL' THEN 'substitute' WHEN NOT hc THEN 'new_category' WHEN NOT hk THEN 'adjacent' END AS match_type, CASE WHEN brand = 'Brand#1' THEN 0.3::DOUBLE WHEN category = 'SMALL' THEN 0.6::DOUBLE WHEN NOT hc THEN 0.7::DOUBLE WHEN NOT hk THEN 0.5::DOUBLE END AS confidence FROM x) WHERE match_type IS NOT NULL""")
def match_fallbacks(spark, d):
    o = market_offers(spark, d)
    i = catalog(spark, d).filter("category NOT IN ('PROMO', 'SMALL') AND NOT (category = 'LARGE' AND kind = 'ring')")
    return O.match_fallbacks(o, i, o.filter("offer_id % 2 = 0"), F.col("brand") == "Brand#1", F.col("brand") == "Brand#9", ["SMALL"])


@query("spec_compat", """{catalog} , s AS (SELECT item_id, brand, category, item_id % 2 = 0 AS tw, ['digital', 'ir', 'analog'][(item_id % 3 + 1)::INT] AS b, capacity * 10 AS r FROM catalog),
    x AS (SELECT l.item_id, r.item_id AS other_id, CASE WHEN l.tw AND NOT r.tw THEN 0.35::DOUBLE WHEN NOT l.tw AND r.tw THEN 0.25::DOUBLE ELSE 0 END AS p1, CASE WHEN l.b <> r.b THEN 0.2::DOUBLE ELSE 0 END AS p2, CASE WHEN greatest(l.r, r.r) / least(l.r, r.r) > 2 THEN 0.1::DOUBLE ELSE 0 END AS p3 FROM s l JOIN s r USING (brand, category) WHERE l.item_id < r.item_id)
    SELECT item_id, other_id, round_even(p1 + p2 + p3, 4) AS penalty, list_filter([CASE WHEN p1 > 0 THEN 'two-way differs' END, CASE WHEN p2 > 0 THEN 'band differs' END, CASE WHEN p3 > 0 THEN 'range differs' END], lambda v: v IS NOT NULL) AS reasons FROM x""")
def spec_compat(spark, d):
    return O.spec_pairs(with_spec(catalog(spark, d), "item_id", 10), ["brand", "category"], "spec")


@query("capacity_range_join", "{catalog} SELECT a.item_id, b.item_id AS peer_id FROM catalog a JOIN catalog b USING (category, brand) WHERE a.item_id <> b.item_id AND abs(a.capacity - b.capacity) <= greatest(2, 0.2 * a.capacity)")
def capacity_range_join(spark, d):
    c = catalog(spark, d).select("item_id", "category", "brand", "capacity")
    peer = c.select("category", "brand", F.col("item_id").alias("peer_id"), F.col("capacity").alias("peer_capacity"))
    return O.near_capacity(c, peer, ["category", "brand"], other="peer_capacity").filter("item_id <> peer_id").select("item_id", "peer_id")


@query("reconcile_by_key", "{catalog} , " + SITES + """ SELECT upper(trim(o.sku, ' ')) AS k, 'kind' AS field, o.kind AS "left", t.kind || CASE WHEN t.item_id % 9 = 0 THEN '!' ELSE '' END AS "right" FROM one o JOIN two t USING (sku) WHERE t.item_id % 9 = 0
    UNION ALL SELECT upper(trim(o.sku, ' ')), 'capacity', o.capacity::VARCHAR, (t.capacity + 1)::VARCHAR FROM one o JOIN two t USING (sku) WHERE t.item_id % 11 = 0""")
def reconcile_by_key(spark, d):
    one, two = sites(spark, d)
    two = two.withColumn("kind", F.when(F.col("item_id") % 9 == 0, F.concat("kind", F.lit("!"))).otherwise(F.col("kind"))).withColumn("capacity", F.when(F.col("item_id") % 11 == 0, F.col("capacity") + 1).otherwise(F.col("capacity")))
    return O.reconcile_by_key(one, two, "sku", ["kind", "capacity"])


@query("reconcile_by_similarity", "{catalog} , " + SITES + """ , x AS (SELECT o.item_id, t.item_id AS other_id, abs(o.price - t.price) < 0.01 AS eq, len(list_intersect(list_distinct(string_split(lower(o.name), ' ')), list_distinct(string_split(lower(t.name), ' '))))::DOUBLE / len(list_distinct(list_concat(string_split(lower(o.name), ' '), string_split(lower(t.name), ' ')))) AS similarity
    FROM one o JOIN two t USING (brand, capacity, kind)) SELECT item_id, other_id, round_even(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, other_id) AS rn FROM (SELECT *, bool_or(eq) OVER (PARTITION BY item_id) AS twin FROM x) WHERE NOT twin AND similarity >= 0.5) WHERE rn = 1""")
def reconcile_by_similarity(spark, d):
    one, two = sites(spark, d)
    return by_similarity(one, two, ["brand", "capacity", "kind"]).select("item_id", "other_id", F.bround("similarity", 6).alias("similarity"))


@query("price_gap_rules", "{catalog} , " + SITES + """ SELECT item_id, round_even(abs(o.price - t.price), 6) AS gap, CASE WHEN abs(o.price - t.price) / least(o.price, t.price) >= 0.03 THEN 'medium' ELSE 'low' END AS severity FROM one o JOIN two t USING (item_id)
    WHERE abs(o.price - t.price) >= 1 AND NOT (abs(o.price - t.price) < 500 AND abs(o.price - t.price) / least(o.price, t.price) < 0.01) AND greatest(o.price, t.price) / least(o.price, t.price) <= 5""")
def price_gap_rules(spark, d):
    one, two = sites(spark, d)
    pairs = one.select("item_id", F.col("price").alias("a")).join(two.select("item_id", F.col("price").alias("b")), "item_id")
    return O.price_gaps(pairs, "a", "b").select("item_id", F.bround("gap", 6).alias("gap"), "severity")


@query("only_on_one_side", "{catalog} , " + SITES + " SELECT sku, 'left' AS side FROM one WHERE sku NOT IN (SELECT sku FROM two) UNION ALL SELECT sku, 'right' FROM two WHERE sku NOT IN (SELECT sku FROM one)")
def only_on_one_side(spark, d):
    one, two = sites(spark, d)
    return O.only_on_one_side(one, two, "sku")


LEVELS = "lv AS (SELECT * FROM (SELECT a.vec_id AS id, b.vec_id AS id2, bit_count(xor(a.sig, b.sig))::INT AS distance, bit_count(xor(a.step, b.step))::INT AS distance2, CASE WHEN bit_count(xor(a.sig, b.sig)) <= 17 AND bit_count(xor(a.step, b.step)) <= 26 THEN 'same' WHEN bit_count(xor(a.sig, b.sig)) <= 19 AND bit_count(xor(a.step, b.step)) <= 30 THEN 'similar' END AS level FROM sigs a JOIN sigs b ON a.side = 0 AND b.side = 1) WHERE level IS NOT NULL)"


def levels(spark, d):
    s = signatures(spark, d)
    return signature_levels(s.filter("side = 0"), s.filter("side = 1"), same=(17, 26), similar=(19, 30))


def signature_pairs(spark, d, ids):
    """The levels of those left signatures that ``ids`` (id) ask for: no others are compared."""
    s = signatures(spark, d)
    asked = s.filter("side = 0").join(materialise(ids.distinct()), F.col("vec_id") == F.col("id"), "left_semi")
    return signature_levels(asked, s.filter("side = 1"), same=(17, 26), similar=(19, 30))


@query("hamming_join", "{sigs} , " + LEVELS + " SELECT * FROM lv")
def hamming_join(spark, d):
    return levels(spark, d)


@query("signature_from_vector", """SELECT vec_id, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > 0 AND i <= 62 THEN 1::HUGEINT << (i - 1)::INT ELSE 0 END))::BIGINT AS sign_bits,
    list_sum(list_transform(range(1, 63), lambda i: CASE WHEN embedding[i + 1] - embedding[i] > 0 THEN 1::HUGEINT << (i - 1)::INT ELSE 0 END))::BIGINT AS step_bits FROM embeddings""")
def signature_from_vector(spark, d):
    e = read(spark, d, "embeddings")
    return e.select("vec_id", O.sign_signature(F.col("embedding"), 62).alias("sign_bits"), O.step_signature(F.col("embedding"), 62).alias("step_bits"))


@query("reuse_by_url", """WITH l AS (SELECT page_id AS id, 'u' || (page_id % 40) AS url, page_id * 3 AS h FROM pages), done AS (SELECT * FROM l WHERE id % 5 = 0) SELECT l.id, l.url, d.h FROM (SELECT id, url FROM l WHERE id % 5 <> 0) l LEFT JOIN (SELECT url, min(h) AS h FROM done GROUP BY url) d USING (url)""")
def reuse_by_url(spark, d):
    x = read(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("u"), (F.col("page_id") % 40).cast("string")).alias("url"), (F.col("page_id") * 3).alias("h"))
    return O.reuse_by_url(x.drop("h"), x.filter("id % 5 = 0"), "url", "h").select("id", "url", "h")


@query("apply_signature_matches", """{offers matches sigs} , """ + LEVELS + """ , m AS (SELECT offer_id, item_id, confidence, match_type, CASE WHEN offer_id % 2 = 0 THEN ['code'] END AS reasons, CASE WHEN offer_id % 11 = 0 THEN 'rejected' END AS review FROM matches),
    p AS (SELECT o.offer_id, o.item_id + o.offer_id % 2 AS item_id, min(level) AS level FROM offers o JOIN lv ON o.offer_id % 500 = lv.id AND o.item_id % 5 = lv.id2 % 5 GROUP BY 1, 2)
    SELECT offer_id, item_id, CASE WHEN live AND level = 'same' THEN greatest(coalesce(confidence, 0), 0.9::DOUBLE) ELSE confidence END AS confidence, CASE WHEN match_type IS NULL THEN 'photo' WHEN live AND level = 'same' AND match_type IN ('functional', 'adjacent') THEN 'identical' ELSE match_type END AS match_type,
    CASE WHEN live AND level IS NOT NULL THEN list_concat(coalesce(reasons, []), ['signature ' || level]) ELSE reasons END AS reasons, review
    FROM (SELECT offer_id, item_id, confidence, match_type, reasons, review, level, coalesce(review, '') <> 'rejected' AS live FROM m FULL JOIN p USING (offer_id, item_id)) WHERE confidence IS NOT NULL OR level = 'same'""")
def apply_signature_matches(spark, d):
    m = matches(spark, d).withColumn("reasons", F.when(F.col("offer_id") % 2 == 0, F.array(F.lit("code")))).withColumn("review", F.when(F.col("offer_id") % 11 == 0, "rejected"))
    o = offers(spark, d).select("offer_id", "item_id", (F.col("offer_id") % 500).alias("id"), (F.col("item_id") % 5).alias("k"))
    p = O.offers_by_level(o, signature_pairs(spark, d, o.select("id")).withColumn("k", F.col("id2") % 5), ["id", "k"])
    p = p.groupBy("offer_id", (F.col("item_id") + F.col("offer_id") % 2).alias("item_id")).agg(F.min("level").alias("level"))
    return O.apply_signature_matches(m, p)


@query("best_match_per_offer", "{catalog offers} , " + MARKET + ", " + EXACT + " SELECT offer_id, item_id, confidence FROM ex WHERE rn = 1")
def best_match_per_offer(spark, d):
    return O.best_match(O.match_exact_model(market_offers(spark, d), catalog(spark, d), aliases(spark, d), best=1), ranked=True).select("offer_id", "item_id", "confidence")


@query("comparables", "{sellers offers matches} SELECT m.item_id, offer_id, seller_group, price, confidence FROM matches m JOIN offers o USING (offer_id) JOIN sellers USING (seller_id) WHERE is_active AND price >= 10 AND confidence >= 0.7 AND match_type IN ('exact', 'identical', 'direct')")
def comparables(spark, d):
    return O.comparables(offers(spark, d), matches(spark, d), sellers(spark, d), 0.7).select("item_id", "offer_id", "seller_group", "price", "confidence")


@query("twins", """{catalog} , c AS (SELECT *, CASE WHEN item_id % 2 = 0 THEN 's' || (item_id % 400) END AS sku FROM catalog) SELECT a.item_id, b.item_id AS twin_id FROM c a JOIN c b ON a.sku = b.sku AND a.item_id <> b.item_id
    UNION SELECT a.item_id, b.item_id FROM c a JOIN c b ON a.model_key = b.model_key AND a.capacity IS NOT DISTINCT FROM b.capacity AND a.kind = b.kind AND a.item_id <> b.item_id""")
def twins(spark, d):
    return O.twins(catalog(spark, d).withColumn("sku", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("s"), (F.col("item_id") % 400).cast("string")))))


@query("inherit_from_twin", """{catalog} SELECT a.item_id, coalesce(CASE WHEN a.item_id % 3 <> 0 THEN a.capacity END, b.capacity) AS capacity FROM catalog a LEFT JOIN (SELECT model_key, arg_min(capacity, item_id) AS capacity FROM catalog WHERE item_id % 2 = 1 GROUP BY 1) b USING (model_key)""")
def inherit_from_twin(spark, d):
    c = catalog(spark, d)
    return O.inherit_from_twin(c.withColumn("capacity", F.when(F.col("item_id") % 3 != 0, F.col("capacity"))), c.filter("item_id % 2 = 1"), "model_key", ["capacity"]).select("item_id", "capacity")


@query("previous_ok_run", "{run_log} SELECT run_id, source_id, last_value(CASE WHEN ok THEN finished_at END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY finished_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_ok FROM run_log")
def previous_ok_run(spark, d):
    return O.previous_ok_run(run_log(spark, d)).select("run_id", "source_id", "previous_ok")


@query("sellers_with_category", "{sellers offers} SELECT seller_id, seller FROM sellers WHERE seller_id IN (SELECT seller_id FROM offers WHERE category = 'PROMO' AND price > 1500)")
def sellers_with_category(spark, d):
    return sellers(spark, d).join(offers(spark, d).filter("category = 'PROMO' AND price > 1500"), "seller_id", "left_semi").select("seller_id", "seller")


@query("mentions_gap", """WITH t AS (SELECT DISTINCT lower(split_part(text, ' ', 2)) AS term FROM benchmark WHERE length(split_part(text, ' ', 2)) >= 6), d AS (SELECT * FROM documents), h AS (SELECT term, count(DISTINCT source) AS sellers, count(*) AS texts FROM d JOIN t ON contains(lower(text), term) WHERE source <> 'src3' GROUP BY 1)
    SELECT * FROM h WHERE sellers >= 2 AND term NOT IN (SELECT term FROM d JOIN t ON contains(lower(text), term) WHERE source = 'src3')""")
def mentions_gap(spark, d):
    docs = read(spark, d, "documents")
    t = read(spark, d, "benchmark").select(F.lower(F.split_part("text", F.lit(" "), F.lit(2))).alias("term")).filter(F.length("term") >= 6)
    return O.mentions_gap(docs.filter("source <> 'src3'"), docs.filter("source = 'src3'"), t, "text", "source")


@query("signature_pairs_listing", "{sellers sigs} , " + LEVELS + " SELECT id, id2, s.seller, level, distance FROM lv JOIN sellers s ON s.seller_id = id2 % 100")
def signature_pairs_listing(spark, d):
    return levels(spark, d).join(sellers(spark, d), F.col("id2") % 100 == F.col("seller_id")).select("id", "id2", "seller", "level", "distance").orderBy("distance", "id", "id2")


@query("offers_with_own_page", "{offers} SELECT offer_id FROM offers WHERE item_id % 77 NOT IN (SELECT page_id FROM pages WHERE page_id % 3 = 0)")
def offers_with_own_page(spark, d):
    return offers(spark, d).withColumn("page_id", F.col("item_id") % 77).join(read(spark, d, "pages").filter("page_id % 3 = 0").select("page_id"), "page_id", "left_anti").select("offer_id")


@query("fill_from_detail_page", """{offers catalog} , l AS (SELECT offer_id, item_id, seller_id AS page_id, CASE WHEN offer_id % 3 = 0 THEN name END AS name, row_number() OVER (PARTITION BY seller_id ORDER BY offer_id) AS rn FROM offers) SELECT offer_id, CASE WHEN rn <= 40 THEN coalesce(l.name, c.brand) ELSE l.name END AS name FROM l LEFT JOIN catalog c USING (item_id)""")
def fill_from_detail_page(spark, d):
    listing = offers(spark, d).select("offer_id", "item_id", F.col("seller_id").alias("page_id"), F.when(F.col("offer_id") % 3 == 0, F.col("name")).alias("name"))
    detail = catalog(spark, d).select("item_id", F.col("brand").alias("name"))
    return O.fill_from_detail(listing, detail, "item_id", ["name"]).select("offer_id", "name")


@query("seller_from_title", """SELECT c_custkey AS id, min(s_suppkey) AS seller_id FROM (SELECT c_custkey, 'offer by ' || CASE WHEN c_custkey % 2 = 0 THEN 'Supplier' ELSE lpad((c_custkey % 150)::VARCHAR, 9, '0') END AS title FROM customer) JOIN supplier ON regexp_extract(lower(title), 'by ([a-z0-9]+)', 1) IN (lower(split_part(s_name, '#', 1)), split_part(s_name, '#', 2)) GROUP BY 1""")
def seller_from_title(spark, d):
    t = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("offer by "), F.when(F.col("c_custkey") % 2 == 0, "Supplier").otherwise(F.lpad((F.col("c_custkey") % 150).cast("string"), 9, "0"))).alias("title"))
    return O.seller_from_title(t, sellers(spark, d), "by ([A-Za-z0-9]+)").select("id", "seller_id")
